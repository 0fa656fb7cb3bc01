"""Running sums, ranks and quantiles over sorted ranges: no task holds a whole group, and rows are exchanged once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.states import group_numbers
from tallyweave.sources.shared import written

#: The largest running sum of a range, in units of the last decimal place.
MOST = 2**62


def running_before(df: DataFrame, by: list[str], order: list[str], amount: Column, out: str = "before_") -> DataFrame:
    """Adds ``out``, the sum of ``amount`` (whole or decimal) over the group's rows before this one in the order of the columns, and ``total_``, over all its rows.

    Rows are cut into ranges of (by, order) by a sample, so a group with many
    rows spans many ranges, ties included as far as ``order`` tells them apart.
    Each range is sorted where it lies and summed as it streams by; the ranges
    are written, as another run would cut them elsewhere.  A table of one row
    per group and range has the sums before it; it is written too, so that
    Spark broadcasts it if it is small by its size on disk, and joins it by key
    if not.  Nulls come first; a null amount counts as 0; a null group is a group.
    """
    kind = df.select(amount).schema[0].dataType
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        raise TypeError("sums of doubles depend on their order: cast the amount to a decimal")
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    whole = (amount.cast(f"decimal(38,{scale})") * F.lit(10**scale)).cast("bigint") if scale else amount.cast("bigint")
    rows = df.withColumn("amount_", F.coalesce(whole, F.lit(0).cast("bigint"))).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = rows.withColumn("part_", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("inside_", T.LongType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.table([batch.column(names.index(b)) for b in by], names=[f"k{i}" for i in range(len(by))]) if by else None
            group = group_numbers(keys) if by else np.zeros(batch.num_rows, np.int64)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            goes_on = last is not None and (not by or len(set(group_numbers(pa.concat_tables([last, keys.slice(0, 1)])).tolist())) == 1)
            amounts = batch.column(names.index("amount_")).to_numpy()
            if amounts.astype(float).sum() + carried > MOST:
                raise OverflowError("the amounts of one range pass 64 bits: give them fewer decimal places")
            before = np.append(0, np.cumsum(amounts))
            first = before[starts]
            if goes_on:
                first[0] -= carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[:-1] - np.repeat(first, np.diff(np.append(starts, len(group)))))], names=schema.names)
            carried = int(before[-1] - first[-1])
            last = keys.slice(len(group) - 1, 1) if by else True

    rows = written(rows.mapInArrow(run, schema), "ranges")
    big = F.col("amount_").cast("decimal(20,0)")
    parts = rows.groupBy("part_", *by).agg(F.sum(big).alias("sum_"))
    past = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select(
        F.col("part_").alias("p_"), *[F.col(b).alias(f"by{i}_") for i, b in enumerate(by)],
        F.coalesce(F.sum("sum_").over(past), F.lit(0)).cast("decimal(30,0)").alias("earlier_"), F.sum("sum_").over(Window.partitionBy(*by)).cast("decimal(30,0)").alias("all_"),
    ), "range_sums")
    same = F.col("part_") == F.col("p_")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"by{i}_"))
    plain = lambda c: (c * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})") if scale else c.cast("bigint")
    return rows.join(parts, same).select(*df.columns, plain(F.col("earlier_") + F.col("inside_")).alias(out), plain(F.col("all_")).alias("total_"))


def ordinal_ranks(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``, the rank from 1 in the order of the columns within the group, and ``total_``, the group's rows."""
    return running_before(df, by, order, F.lit(1), out).withColumn(out, F.col(out) + 1)


def average_value_ranks(counts: DataFrame, by: list[str], x: str, n: str, out: str) -> DataFrame:
    """(by, x, out): the rank of each distinct value, ties at their mean; ``counts`` has rows with ``n`` rows of a value each."""
    values = counts.groupBy(*by, x).agg(F.sum(n).alias("n_"))
    ranked = running_before(values, by, [x], F.col("n_"))
    return ranked.select(*by, x, (F.col("before_") + (F.col("n_") + 1) / 2).alias(out))


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``points``): exact quantiles, interpolated between neighbours, whatever the size of a group.

    Equal values are counted first; the distinct ones are counted through in
    sorted ranges, and only the two that a quantile lies between are gathered.
    Nulls don't count; a group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x_")).agg(F.count("*").alias("n_"))
    placed = running_before(counts, by, ["x_"], F.col("n_"))
    columns = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("total_") - 1)
        holds = lambda i: (F.col("before_") <= i) & (i < F.col("before_") + F.col("n_"))
        low, high = F.floor(at), F.ceil(at)
        columns += [F.max(F.when(holds(low), F.col("x_"))).alias(f"{name}_low_"), F.max(F.when(holds(high), F.col("x_"))).alias(f"{name}_high_"), F.max(at - low).alias(f"{name}_part_")]
    found = placed.groupBy(*by).agg(*columns)
    between = lambda n: F.col(f"{n}_low_") + F.col(f"{n}_part_") * (F.col(f"{n}_high_") - F.col(f"{n}_low_"))
    return found.select(*by, *[between(n).alias(n) for n in points]).where(F.col(next(iter(points))).isNotNull())
