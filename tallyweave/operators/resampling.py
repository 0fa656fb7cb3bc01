"""Bootstraps, subsamples and noise floors whose memory and shuffles don't grow with rows times repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.columns import curve, max_distance, mean_distance, scale_position
from tallyweave.functions.draws import NUMBER_BITS, base, numbers, poisson_limits, uniform
from tallyweave.operators.distributions import share_arrays, shape
from tallyweave.sources.shared import written

#: Draws that a task holds at once.
DRAWS_HELD = 1 << 21


def poisson_sums(rows: DataFrame, key: str, sums: dict[str, Column], repeats: int, seed: int = 0) -> DataFrame:
    """(repeat, the sums): each repeat's sums over the rows, a row as often as a Poisson number of rate 1 says.

    One pass: a task adds up its rows for all repeats and gives one row a
    repeat.  Rows of one key are drawn together, so a cluster's name as the key
    resamples clusters.  Null terms count as 0; rows with a null key are one
    cluster; no rows give no repeats.
    """
    names, limits = list(sums), np.array(poisson_limits(), np.uint64)
    streams = np.arange(repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            bases = batch.column(0).to_numpy(zero_copy_only=False)
            terms = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            step = max(1, DRAWS_HELD // repeats)
            total = np.zeros((repeats, len(names))) if total is None else total
            for low in range(0, len(bases), step):
                times = np.searchsorted(limits, numbers(bases[low : low + step], streams), "right")
                total += times.T @ terms[low : low + step]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(streams, pa.int32()), *[pa.array(c) for c in total.T]], names=["repeat", *names])

    terms = rows.select(base(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("base_"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"term{i}_") for i, c in enumerate(sums.values())])
    parts = terms.mapInArrow(run, ", ".join(["repeat int", *[f"`{n}` double" for n in names]]))
    return parts.groupBy("repeat").agg(*[F.sum(n).alias(n) for n in names])


def poisson_interval(rows: DataFrame, key: str, sums: dict[str, Column], stat: Column, repeats: int, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(value, ci_low, ci_high): ``stat``, an expression of the sums, over all rows and its resampled interval, in one pass over respondents.

    For a mean: ``{"sx": x, "n": 1}`` and sx / n.  Repeats whose ``stat`` is
    null (no row was drawn) are left out.
    """
    drawn = poisson_sums(rows, key, sums, repeats, seed).select(stat.alias("s"))
    ci = drawn.agg(F.percentile("s", F.lit(low)).alias("ci_low"), F.percentile("s", F.lit(high)).alias("ci_high"))
    whole = rows.agg(*[F.sum(c.cast("double")).alias(n) for n, c in sums.items()]).select(stat.alias("value"))
    return whole.crossJoin(ci)


def subsample_rows(values: DataFrame, key: str, keep: list[str], sizes: list[int], repeats: int, seed: int = 0) -> DataFrame:
    """(size, repeat, keep): for each size and repeat so many rows without replacement, or all, those with the smallest draws.

    A first pass keeps the rows whose draw is under a limit that leaves a small
    surplus, so what is shuffled is as large as the subsamples, not as the
    table; a limit that left too few is widened and the pass done again.  Keys
    tell rows apart (rows of one key are drawn alike, in the order of ``keep``).
    """
    plan = [(s, r) for s in sizes for r in range(repeats)]
    n, top = values.count(), 1 << NUMBER_BITS
    rows = values.select(base(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("base_"), F.col(key).alias("key_"), *[F.col(c).alias(c) for c in keep])
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("repeat", T.IntegerType()), T.StructField("draw_", T.LongType()), *rows.schema.fields[1:]])
    surplus = 8.0
    while True:
        limits = np.array([min(top, math.ceil((s + surplus * math.sqrt(s) + 5 * surplus) / max(n, 1) * top)) for s, _ in plan], np.uint64)

        def run(batches: Iterator[pa.RecordBatch], limits: np.ndarray = limits) -> Iterator[pa.RecordBatch]:
            streams, size, repeat = np.arange(len(plan)), *(np.array(x, np.int32) for x in zip(*plan, strict=True))
            for batch in batches:
                bases, step = batch.column(0).to_numpy(zero_copy_only=False), max(1, DRAWS_HELD // len(plan))
                for low in range(0, len(bases), step):
                    got = numbers(bases[low : low + step], streams)
                    at, which = np.nonzero(got < limits)
                    columns = [c.take(pa.array(at + low)) for c in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(size[which]), pa.array(repeat[which]), pa.array(got[at, which].astype(np.int64)), *columns], names=schema.names)

        kept = written(rows.mapInArrow(run, schema), "subsamples")
        counts = kept.groupBy("size", "repeat").count().where(F.col("count") < F.least("size", F.lit(n))).count() if n else 0
        found = kept.select("size", "repeat").distinct().count() if n else len(plan)
        if not counts and found == len(plan):
            break
        surplus *= 8
    order = Window.partitionBy("size", "repeat").orderBy("draw_", "key_", *keep)
    return kept.withColumn("n_", F.row_number().over(order)).where("n_ <= size").select("size", "repeat", *keep)


def subsample_noise(values: DataFrame, key: str, value: str, sizes: list[int], repeats: int, seed: int = 0) -> DataFrame:
    """(size, mean_noise): mean distance of subsample means from the whole mean, draws without replacement."""
    means = subsample_rows(values, key, [value], sizes, repeats, seed).groupBy("size", "repeat").agg(F.avg(value).alias("m"))
    whole = values.agg(F.avg(value).alias("whole"))
    return means.crossJoin(F.broadcast(whole)).groupBy("size").agg(F.avg(F.abs(F.col("m") - F.col("whole"))).alias("mean_noise"))


def subsample_curve_noise(values: DataFrame, key: str, value: str, sizes: list[int], repeats: int, seed: int = 0, points: int = 20) -> DataFrame:
    """(size, mean_noise): mean distance of the subsamples' cumulative curves from the curve of all values; sizes over the number of values are left out.

    Categories that a subsample lacks are no points of its curve.
    """
    rows = values.where(F.col(value).isNotNull())
    n = rows.count()
    sizes = [s for s in sizes if s <= n]
    whole = [F.lit("all").alias("all_")]
    shares = lambda df, by: share_arrays(df.groupBy(*by, F.col(value).alias("cat")).agg(F.count("*").cast("double").alias("share")), by)
    if not sizes:
        return values.sparkSession.createDataFrame([], "size int, mean_noise double")
    true = shares(rows.select(*whole, value), ["all_"]).select(curve("shares", points).alias("true_"))
    drawn = shares(subsample_rows(rows, key, [value], sizes, repeats, seed), ["size", "repeat"])
    each = drawn.crossJoin(F.broadcast(true)).select("size", mean_distance(curve("shares", points), "true_").alias("d"))
    return each.groupBy("size").agg(F.avg("d").alias("mean_noise"))


def binomial_numbers(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial numbers by inversion: how many k have a cumulative probability of at most u."""
    most = int(n.max(initial=0))
    logs = np.append(0.0, np.cumsum(np.log(np.arange(1, most + 1))))
    out, step = np.zeros(len(n), np.int64), max(1, DRAWS_HELD // (most + 1))
    k = np.arange(most + 1)
    for low in range(0, len(n), step):
        a, q = n[low : low + step, None], np.clip(p[low : low + step, None], 0.0, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = logs[a] - logs[k] - logs[np.maximum(a - k, 0)] + np.where(k > 0, k * np.log(q), 0.0) + np.where(a > k, (a - k) * np.log1p(-q), 0.0)
        total = np.cumsum(np.where(k <= a, np.exp(log), 0.0), axis=1)
        out[low : low + step] = np.minimum((total <= u[low : low + step, None]).sum(1), a[:, 0])
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def multinomial_counts(shares: pd.Series, n: pd.Series, draws: pd.Series) -> pd.Series:
    """Counts of n answers over the shares by successive binomials: as many draws as shares but one."""
    out: list = [None] * len(shares)
    width = shares.map(len).to_numpy()
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        share, u = np.stack(shares.iloc[at].to_list()), np.stack(draws.iloc[at].to_list()) if k > 1 else np.zeros((len(at), 0))
        left, mass, counts = n.iloc[at].to_numpy(), np.ones(len(at)), np.zeros((len(at), k), np.int64)
        for j in range(k - 1):
            counts[:, j] = binomial_numbers(left, np.divide(share[:, j], mass, out=np.zeros(len(at)), where=mass > 1e-15), u[:, j])
            left, mass = left - counts[:, j], mass - share[:, j]
        counts[:, k - 1 :] = left[:, None]
        for i, row in zip(at, counts, strict=True):
            out[i] = row
    return pd.Series(out)


def noise_floor(arrays: DataFrame, by: list[str], n: int, repeats: int, seed: int = 0, grid: int = 7) -> DataFrame:
    """(by, mean, sd, skewness, kurtosis, low, high, cdf, ks): the mean gap of each measure between two surveys of n answers by chance alone.

    ``arrays`` (by, shares) has one distribution an item, its categories placed
    from 1 to ``grid``.  A survey is drawn as its counts, one binomial number a
    category, so the work doesn't grow with n times repeats rows.  ``cdf`` is
    the mean and ``ks`` the largest gap of the cumulative shares at 1..grid.
    Skewness and kurtosis leave out pairs with a survey without spread.  Items
    with empty or null shares are left out.
    """
    k = F.size("shares")
    rows = arrays.where(F.coalesce(k, F.lit(0)) > 0).select(*by, "shares", F.transform(F.sequence(F.lit(0), k - 1), lambda j: scale_position(j, k, 1.0, float(grid))).alias("positions"))
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    # Both surveys' draws in one array: the key has the item, the repeat and the place.
    draws = F.transform(F.sequence(F.lit(1), 2 * k), lambda i: uniform(F.lit(seed), *by, "repeat", i))
    rows = rows.withColumn("draws_", draws)
    for side, first in (("a", F.lit(1)), ("b", k)):
        counts = multinomial_counts("shares", F.lit(n), F.slice("draws_", first, k - 1))
        rows = rows.withColumn(side, F.transform(counts, lambda c: c / F.lit(float(n))))
    for side in ("a", "b"):
        rows = rows.withColumn(side, shape(F.col(side), F.col("positions"), grid))
    gap = lambda m: F.avg(F.abs(F.col(f"a.{m}") - F.col(f"b.{m}"))).alias(m)
    return rows.groupBy(*by).agg(*[gap(m) for m in ("mean", "sd", "skewness", "kurtosis", "low", "high")], F.avg(mean_distance("a.cdf", "b.cdf")).alias("cdf"), F.avg(max_distance("a.cdf", "b.cdf")).alias("ks"))
