"""Weighted moments as mergeable states: one pass, and a group's rows stay in the tasks that read them.

A state is (n, weight, mean, centred sum, least, largest).  A row is a state of
its own; states of a group merge into one, with deviations from the merged mean,
so nothing is lost to a large mean.  Tasks merge what they read and give a row a
group; only those rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = ("n_", "weight_", "mean_", "centred_", "least_", "largest_")
STATE_SCHEMA = "n_ bigint, weight_ double, mean_ double, centred_ double, least_ double, largest_ double"
#: States that a task holds before it merges them.
HELD = 1 << 17


def group_numbers(keys: pa.Table) -> np.ndarray:
    """The group of each row, numbered from 0; nulls are equal to nulls and differ from NaN."""
    out = np.zeros(keys.num_rows, np.int64)
    for column in keys.columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode")
        at = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (len(codes.dictionary) + 1) + at, return_inverse=True)[1]
    return out


def merged(states: pa.Table, by: list[str]) -> pa.Table:
    """One state a group; each group's key is that of its first row."""
    group = group_numbers(states.select(by))
    _, first = np.unique(group, return_index=True)
    k = len(first)
    n, weight, mean, centred, least, largest = (states[c].to_numpy() for c in STATE)
    total = np.bincount(group, weight, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Around a value of the group, so that a large common part cancels before it is summed.
        middle = mean[first] + np.bincount(group, weight * (mean - mean[first][group]), k) / total
    apart = mean - middle[group]
    low, high = np.full(k, np.inf), np.full(k, -np.inf)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, largest)
    values = [np.bincount(group, n, k).astype(np.int64), total, middle, np.bincount(group, centred + weight * apart * apart, k), low, high]
    keys = states.select(by).take(pa.array(first))
    return pa.table([*keys.columns, *[pa.array(v) for v in values]], names=[*by, *STATE])


def moment_states(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, the state): a row a group, of rows with a value and a positive weight."""
    names = [f"by{i}_" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    rows = rows.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(weight).cast("double").alias("weight_"), F.col(value).cast("double").alias("mean_"))
    schema = T.StructType([*rows.schema.fields[: len(by)], *T.StructType.fromDDL(STATE_SCHEMA).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w, count = batch.column("mean_"), batch.column("weight_"), pa.array(np.ones(batch.num_rows, np.int64))
            one = pa.table([*batch.columns[: len(names)], count, w, x, pa.array(np.zeros(batch.num_rows)), x, x], names=[*names, *STATE])
            held.append(merged(one, names))
            size += held[-1].num_rows
            if size > HELD:
                held = [merged(pa.concat_tables(held), names)]
                size = held[0].num_rows
                if size > HELD // 2:  # many groups: give them out
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged(pa.concat_tables(held), names).combine_chunks().to_batches()

    parts = rows.mapInArrow(read, schema)
    whole = parts.groupBy(*names).applyInArrow(lambda t: merged(t, names), schema) if names else parts.groupBy().applyInArrow(lambda t: merged(t, names), schema)
    return whole.withColumnsRenamed(dict(zip(names, by, strict=True)))


def standard_deviation() -> Column:
    """The population SD of a state."""
    return F.sqrt(F.try_divide("centred_", "weight_"))


def wide_states(df: DataFrame, columns: list[str], weight: str, part: str) -> DataFrame:
    """(variable, part, the state): for each of many columns and each value of ``part``, a state of rows with a value and a positive weight, in one pass.

    A task keeps one state a column and part, whatever its rows, and gives out
    no row a value: a table of thousands of columns isn't made long.
    ``part`` is an integer column of few values, such as a year; null is one.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w_"), F.col(part).cast("bigint").alias("part_"), *[F.col(c).cast("double").alias(f"v{i}_") for i, c in enumerate(columns)])
    schema = T.StructType.fromDDL(f"variable int, part bigint, {STATE_SCHEMA}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            w, part, found = batch.column(0).to_numpy(), batch.column(1), []
            for i in range(len(columns)):
                column = batch.column(2 + i)
                at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    x = pa.array(column.to_numpy(zero_copy_only=False)[at])
                    ones, zeros = np.ones(len(at), np.int64), np.zeros(len(at))
                    one = pa.table([pa.array(np.full(len(at), i, np.int32)), part.take(pa.array(at)), pa.array(ones), pa.array(w[at]), x, pa.array(zeros), x, x], names=["variable", "part", *STATE])
                    found.append(merged(one, ["variable", "part"]))
            held = [merged(pa.concat_tables(held + found), ["variable", "part"])] if held or found else []
        if held:
            yield from held[0].combine_chunks().to_batches()

    whole = rows.mapInArrow(read, schema).groupBy("variable", "part").applyInArrow(lambda t: merged(t, ["variable", "part"]), schema)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("variable") + 1) if columns else F.lit(None).cast("string")
    return whole.withColumn("variable", name).withColumnRenamed("part", part)


def wide_shares(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """(variable, cat string, weight, share): the weighted share of each value of many columns, in one pass.

    Tasks sum by column and value before anything is shuffled; a column with
    very many values gives as many rows as it has values in a task at most.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w_"), *[F.col(c).cast("string").alias(f"v{i}_") for i, c in enumerate(columns)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], float] = {}
        for batch in batches:
            w = batch.column(0).to_numpy()
            for i in range(len(columns)):
                codes = batch.column(1 + i).dictionary_encode()
                at = codes.indices.to_numpy(zero_copy_only=False)
                valid = codes.indices.is_valid().to_numpy(zero_copy_only=False)
                sums = np.bincount(at[valid].astype(np.int64), w[valid], len(codes.dictionary))
                for cat, s in zip(codes.dictionary.to_pylist(), sums.tolist(), strict=True):
                    held[i, cat] = held.get((i, cat), 0.0) + s
            if len(held) > HELD:
                yield given(held)
                held = {}
        if held:
            yield given(held)

    def given(held: dict[tuple[int, str], float]) -> pa.RecordBatch:
        frame = pd.DataFrame([(i, c, s) for (i, c), s in held.items()], columns=["variable", "cat", "weight"])
        return pa.RecordBatch.from_arrays([pa.array(frame["variable"], pa.int32()), pa.array(frame["cat"], pa.string()), pa.array(frame["weight"], pa.float64())], names=["variable", "cat", "weight"])

    sums = rows.mapInArrow(read, "variable int, cat string, weight double").groupBy("variable", "cat").agg(F.sum("weight").alias("weight"))
    totals = sums.groupBy("variable").agg(F.sum("weight").alias("total_"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("variable") + 1) if columns else F.lit(None).cast("string")
    return sums.join(totals, "variable").select(name.alias("variable"), "cat", "weight", F.try_divide("weight", "total_").alias("share"))
