"""The validation report: a table of items, statistics of marginals and correlations, and their resampled intervals from shared draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import max_distance, mean_distance, safe_corr, scale_position
from tallyweave.functions.draws import uniform
from tallyweave.operators.distributions import shape
from tallyweave.operators.validation import correlation_noise

MEASURES = ("mean", "sd", "skewness", "kurtosis", "low", "high")


def item_table(answers: DataFrame, coverage: DataFrame, real: DataFrame, grid: int = 7, fallback: str = "population") -> DataFrame:
    """A row per item that both sides have: what it is, what it rests on, and six measures and three distances of both distributions.

    ``answers`` (item, partition, shares) has the shares of 1..``grid`` of each
    repeat, which are averaged; ``coverage`` (item, partition, source, tier,
    method, matched, similarity) is taken from the first partition;
    ``n_sources`` over 1 tells that partitions rest on different sources.
    ``real`` (item, scale, reverse, shares) has k shares, placed from 1 to
    ``grid``.  ``spread`` is the largest distance of a partition's mean from the
    mean of all.  Items without shares on a side are left out.
    """
    level = range(1, grid + 1)
    own = reduce(lambda a, b: a + b, [F.element_at("shares", i) * i for i in level])
    whole = answers.where(F.size("shares") == grid).groupBy("item").agg(
        F.array(*[F.avg(F.element_at("shares", i)) for i in level]).alias("g_shares"), F.count("*").alias("partitions"), F.avg(own).alias("m_"), F.min(own).alias("lo_"), F.max(own).alias("hi_")
    )
    named = ["source", "tier", "method", "matched", "similarity"]
    first = coverage.groupBy("item").agg(F.min_by(F.struct(*named), "partition").alias("c_"), F.count_distinct("source").alias("n_sources"))
    k = F.size("shares")
    places = F.transform(F.sequence(F.lit(0), k - 1), lambda j: scale_position(j, k, 1.0, float(grid)))
    known = real.where(F.coalesce(k, F.lit(0)) > 0).select("item", "scale", "reverse", k.cast("bigint").alias("k"), shape(F.col("shares"), places, grid).alias("r"))
    steps = F.array(*[F.lit(float(i)) for i in level])
    rows = whole.join(first, "item", "left").join(known, "item").withColumn("g", shape(F.col("g_shares"), steps, grid)).withColumn("flipped", shape(F.reverse("g_shares"), steps, grid)["cdf"])
    return rows.select(
        "item", "scale", "reverse", "k", F.when(F.col("k") == grid, f"{grid}-point").otherwise(F.concat(F.col("k").cast("string"), F.lit("-point"))).alias("format"), *[F.col(f"c_.{c}").alias(c) for c in named], "n_sources",
        "partitions", F.greatest(F.col("hi_") - F.col("m_"), F.col("m_") - F.col("lo_")).alias("spread"), *[F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in ("r", "g") for m in MEASURES],
        mean_distance("g.cdf", "r.cdf").alias("cdf_distance"), max_distance("g.cdf", "r.cdf").alias("ks"), mean_distance("flipped", "r.cdf").alias("cdf_distance_flipped"),
        F.when(F.col("c_.source") == fallback, "no real anchor").otherwise("real anchor").alias("anchor"),
    )


def marginal_statistics() -> dict[str, Column]:
    """The seventeen statistics of an ``item_table``; nulls don't count."""
    gap = lambda m: F.col(f"g_{m}") - F.col(f"r_{m}")
    out = {}
    for m, name in (("mean", "mean"), ("sd", "sd"), ("skewness", "skewness"), ("kurtosis", "kurtosis"), ("low", "low"), ("high", "high")):
        out[f"{name}_gap"] = F.avg(gap(m))
        if m != "kurtosis":
            out[f"{name}_abs"] = F.avg(F.abs(gap(m)))
    return out | {
        "cdf_distance": F.avg("cdf_distance"), "ks": F.avg("ks"), "r_of_means": safe_corr("g_mean", "r_mean"), "r_of_sds": safe_corr("g_sd", "r_sd"),
        "sd_of_generated_means": F.stddev_pop("g_mean"), "sd_of_real_means": F.stddev_pop("r_mean"),
    }


def correlation_statistics(generated: str, real: str, shrink: float = 1.1, near: float = 0.1, strong: float = 0.3) -> dict[str, Column]:
    """The statistics of pairs of correlations that need no order of the pairs; null where the real ones don't vary."""
    g, r = F.col(generated).cast("double"), F.col(real).cast("double")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    pattern, varies = safe_corr(generated, real), F.stddev_pop(r) > 1e-12
    slope = F.when(varies, F.try_divide(F.covar_pop(r, g), F.var_pop(r)))
    return {
        "pairs": F.count(g - r).cast("double"), "real_mean": F.avg(r), "generated_mean": F.avg(g), "bias": F.avg(g - r), "mae": F.avg(F.abs(g - r)), "rmse": F.sqrt(F.avg((g - r) * (g - r))), "pattern_r": pattern,
        "slope": slope, "intercept": F.avg(g) - slope * F.avg(r), "r2": pattern * pattern, "real_sd": F.stddev_pop(r), "generated_sd": F.stddev_pop(g),
        "strong_real": share(F.abs(r) >= strong), "strong_generated": share(F.abs(g) >= strong), "within": share(F.abs(g - r) <= near),
        "mae_shrunk": F.avg(F.abs(r - g / shrink)), "improved": share(F.abs(r - g / shrink) < F.abs(r - g)),
    }


def in_blocks(rows: DataFrame, blocks: dict[str, Column], out: str = "block") -> DataFrame:
    """Each row once for every block whose condition it meets."""
    return rows.withColumn(out, F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in blocks.items()]))))


def interval_table(rows: DataFrame, by: list[str], unit: list[str], stats: dict[str, Column], repeats: int, seed: int = 0, least: int = 1, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, statistic, n, value, ci_low, ci_high): each statistic over the group's rows and its resampled interval; all of them from the same draws.

    Units (a row's key, or a cluster of rows such as a batch) are drawn with
    replacement as often as there are, within each group; a repeat aggregates
    the rows of its units once for all statistics.  Groups with fewer than
    ``least`` rows are left out; a statistic that is null in a repeat doesn't
    count there.  For tables of items, pairs or clusters.
    """
    names = list(stats)
    units = rows.select(*by, *unit).distinct().withColumn("no_", F.row_number().over(Window.partitionBy(*by).orderBy(*unit)) - 1)
    counts = units.groupBy(*by).agg(F.count("*").alias("units_"))
    joined = units.join(counts, by) if by else units.crossJoin(F.broadcast(counts))
    draws = joined.withColumn("repeat_", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draws = draws.select(*by, "repeat_", F.floor(uniform(seed, *by, "repeat_", "no_") * F.col("units_")).alias("no_"))
    drawn = draws.join(units, [*by, "no_"]).join(rows, [*by, *unit])
    each = drawn.groupBy(*by, "repeat_").agg(*[s.alias(n) for n, s in stats.items()])
    ends = each.groupBy(*by).agg(*[F.percentile(n, F.lit(p)).alias(f"{n}_{side}") for n in names for side, p in (("low", low), ("high", high))])
    whole = rows.groupBy(*by).agg(F.count("*").alias("rows_"), *[s.alias(n) for n, s in stats.items()]).where(F.col("rows_") >= least)
    wide = whole.join(ends, by) if by else whole.crossJoin(F.broadcast(ends))
    listed = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value"), F.col(f"{n}_low").alias("ci_low"), F.col(f"{n}_high").alias("ci_high")) for n in names])
    return wide.select(*by, F.col("rows_").alias("n"), F.explode(listed).alias("s")).select(*by, "s.statistic", "n", "s.value", "s.ci_low", "s.ci_high")


def with_noise(table: DataFrame, noise: DataFrame, by: list[str]) -> DataFrame:
    """Rows of an ``interval_table`` with ``noise`` (by, statistic, noise), null where chance has no figure."""
    return table.join(noise.select(*by, "statistic", "noise"), [*by, "statistic"], "left")


#: The statistics whose size by chance is a measure of ``resampling.noise_floor``.
NOISE_OF = {"mean_abs": "mean", "sd_abs": "sd", "skewness_abs": "skewness", "low_abs": "low", "high_abs": "high", "cdf_distance": "cdf", "ks": "ks"}


def marginal_noise(floor: DataFrame) -> DataFrame:
    """(statistic, noise): the mean over items of a ``noise_floor``."""
    means = floor.agg(*[F.avg(m).alias(s) for s, m in NOISE_OF.items()])
    return means.unpivot([], list(NOISE_OF), "statistic", "noise")


def correlation_blocks(pairs: DataFrame, scale_pairs: DataFrame) -> DataFrame:
    """(block, batch, key, real_r, gen_r): item pairs in the blocks all, different and same scale and by anchoring, and scale pairs."""
    blocks = {"items, all": F.lit(True), "items, different scales": ~F.col("same_scale"), "items, same scale": F.col("same_scale")}
    blocks |= {f"items, {i} of 2 anchored": F.col("anchors") == f"{i} of 2 anchored" for i in range(3)}
    columns = ["block", "batch", "real_r", "gen_r"]
    return in_blocks(pairs, blocks).select(*columns).unionByName(scale_pairs.withColumn("block", F.lit("scales")).select(*columns))


def correlation_report(pairs: DataFrame, scale_pairs: DataFrame, respondents: int, repeats: int, seed: int = 0, least: int = 10) -> DataFrame:
    """(block, statistic, n, value, ci_low, ci_high, noise) of the seven blocks: intervals over batches, noise of the MAE between two surveys of ``respondents``."""
    rows = correlation_blocks(pairs, scale_pairs).where(F.col("real_r").isNotNull() & F.col("gen_r").isNotNull())
    noise = rows.groupBy("block").agg(F.avg(correlation_noise(F.col("real_r"), respondents)).alias("noise")).withColumn("statistic", F.lit("mae"))
    return with_noise(interval_table(rows, ["block"], ["batch"], correlation_statistics("gen_r", "real_r"), repeats, seed, least), noise, ["block"])
