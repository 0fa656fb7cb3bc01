"""Distributions of ordered categories: cut points, curves, moments and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import array_sum, curve, ratio, running_sum, scale_position


def share_arrays(shares: DataFrame, by: list[str], excluded: str = "__other__") -> DataFrame:
    """(by, cats, shares): each variable's numeric categories in order and their shares renormalised; others are left out."""
    kept = shares.where((F.col("cat").cast("string") != excluded) & F.expr("try_cast(cat AS double)").isNotNull())
    pairs = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.expr("try_cast(cat AS double)").alias("c"), F.col("share").alias("s")))).alias("pairs"))
    plain = F.transform("pairs", lambda p: p["s"])
    return pairs.select(*by, F.transform("pairs", lambda p: p["c"]).alias("cats"), F.transform(plain, lambda s: s / array_sum(plain)).alias("shares"))


def cut_points(arrays: DataFrame, by: list[str]) -> DataFrame:
    """(by, cuts, k): cumulative shares; the last is 1."""
    cuts = running_sum("shares")
    return arrays.select(*by, F.when(F.size("shares") > 0, cuts).otherwise(F.array(F.lit(1.0))).alias("cuts"), F.greatest(F.size("shares"), F.lit(1)).alias("k"))


def curves(arrays: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """(by, curve): the cumulative curve at n points."""
    return arrays.select(*by, curve("shares", n).alias("curve"))


def mean_curve(points: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Positionwise (weighted) mean of ``curve`` over rows, as (by, pos, y)."""
    by, weight = by or [], F.lit(1.0) if weight is None else weight
    long = points.select(*by, weight.alias("w_"), F.posexplode("curve").alias("pos", "y"))
    return long.groupBy(*by, "pos").agg(ratio(F.sum(F.col("w_") * F.col("y")), F.sum("w_")).alias("y"))


def mean_rank(arrays: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean_rank): share-weighted mean of rank normalised to [0, 1]; one half for one category."""
    k = F.size("shares")
    total = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda acc, i: acc + i / F.greatest(k - 1, F.lit(1)) * F.element_at("shares", i + 1))
    return arrays.select(*by, F.when(k <= 1, F.lit(0.5)).otherwise(total).alias("mean_rank"))


def moments(positions: DataFrame, by: list[str], position: str = "position", share: str = "share") -> DataFrame:
    """(by, mean, sd, skewness, kurtosis): of a discrete distribution in rows; excess kurtosis; nulls where the SD is under 1e-9."""
    p, s = F.col(position).cast("double"), F.col(share)
    mean = positions.groupBy(*by).agg(F.sum(s * p).alias("mean"))
    d = p - F.col("mean")
    out = positions.join(mean, by).groupBy(*by).agg(F.first("mean").alias("mean"), *[F.sum(s * F.pow(d, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    sd = F.sqrt(F.greatest("m2", F.lit(0.0)))
    wide = sd > 1e-9
    return out.select(*by, "mean", sd.alias("sd"), F.when(wide, F.col("m3") / F.pow(sd, F.lit(3))).alias("skewness"), F.when(wide, F.col("m4") / F.pow(sd, F.lit(4)) - 3).alias("kurtosis"))


def tail_shares(positions: DataFrame, by: list[str], low: float = 2.0, high: float = 6.0, position: str = "position", share: str = "share") -> DataFrame:
    """(by, low_share, high_share): shares at or beyond the two positions, with a tolerance of 1e-9."""
    p = F.col(position)
    return positions.groupBy(*by).agg(
        F.sum(F.when(p <= low + 1e-9, F.col(share)).otherwise(0.0)).alias("low_share"), F.sum(F.when(p >= high - 1e-9, F.col(share)).otherwise(0.0)).alias("high_share")
    )


def histogram(df: DataFrame, by: list[str], level: str, levels: int) -> DataFrame:
    """(by, level, n, share): counts of the levels 1..levels, zero-filled."""
    grid = df.select(*by).distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    counts = df.where(F.col(level).between(1, levels)).groupBy(*by, F.col(level).cast("int").alias("level")).agg(F.count("*").alias("n"))
    filled = grid.join(counts, [*by, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("share", F.coalesce(ratio("n", F.sum("n").over(Window.partitionBy(*by))), F.lit(0.0)))


def share_vector(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, shares): the histogram's shares in the order of levels."""
    return hist.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "share"))), lambda p: p["share"]).alias("shares"))


def with_positions(arrays: DataFrame, by: list[str], low: float = 1.0, high: float = 7.0) -> DataFrame:
    """(by, position, share): k categories equally spaced onto [low, high]."""
    long = arrays.select(*by, F.size("shares").alias("k"), F.posexplode("shares").alias("j", "share"))
    return long.select(*by, scale_position("j", "k", low, high).alias("position"), "share")


def cdf_on_grid(positions: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """(by, cdf): cumulative share at each grid point."""
    values = [F.sum(F.when(F.col("position") <= g + 1e-9, F.col("share")).otherwise(0.0)) for g in grid]
    return positions.groupBy(*by).agg(F.array(*values).alias("cdf"))


def mean_over_repeats(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, share, n_repeats): the mean share of each level over the repeats of a zero-filled histogram."""
    return hist.groupBy(*by, "level").agg(F.avg("share").alias("share"), F.count("*").alias("n_repeats"))


def shape(shares: Column, positions: Column, grid: int = 7) -> Column:
    """A struct (mean, sd, skewness, kurtosis, low, high, cdf) of one distribution in two arrays, measured as ``moments``, ``tail_shares`` and ``cdf_on_grid`` do."""
    pairs = F.zip_with(shares, positions, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    total = lambda f: array_sum(F.transform(pairs, f))
    mean = total(lambda x: x["s"] * x["p"])
    moment = lambda k: total(lambda x: x["s"] * F.pow(x["p"] - mean, F.lit(k)))
    sd = F.sqrt(moment(2))
    wide = lambda c: F.when(sd > 1e-9, c)
    at_most = lambda g: array_sum(F.transform(pairs, lambda x: F.when(x["p"] <= g + 1e-9, x["s"]).otherwise(0.0)))
    high = total(lambda x: F.when(x["p"] >= grid - 1 - 1e-9, x["s"]).otherwise(0.0))
    return F.struct(
        mean.alias("mean"), sd.alias("sd"), wide(moment(3) / F.pow(sd, F.lit(3))).alias("skewness"), wide(moment(4) / F.pow(sd, F.lit(4)) - 3).alias("kurtosis"),
        at_most(F.lit(2.0)).alias("low"), high.alias("high"), F.transform(F.sequence(F.lit(1), F.lit(grid)), at_most).alias("cdf"),
    )


def empirical_curves(df: DataFrame, by: list[str], value: str, n: int = 20) -> DataFrame:
    """(by, curve, n_values): the cumulative curve of a sample's values, each value a category; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("cat")).agg(F.count("*").alias("c_"))
    arrays = share_arrays(counts.withColumn("share", F.col("c_").cast("double")), by)
    sizes = counts.groupBy(*by).agg(F.sum("c_").alias("n_values"))
    curves_ = arrays.select(*by, curve("shares", n).alias("curve"))
    return curves_.join(sizes, by) if by else curves_.crossJoin(sizes)
