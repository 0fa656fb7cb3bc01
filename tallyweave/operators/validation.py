"""Validation statistics: errors, correlations, regressions, reliability, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import ratio, safe_corr
from tallyweave.functions.draws import uniform
from tallyweave.operators.ranks import average_value_ranks
from tallyweave.sources.shared import written


def error_stats(df: DataFrame, generated: str, real: str, by: list[str] | None = None, shrink: float = 1.1, near: float = 0.1) -> DataFrame:
    """bias, mae, rmse, share within ``near``, MAE after dividing by ``shrink``, share of |real| >= .3 and SDs (population)."""
    d = F.col(generated) - F.col(real)
    rows = df.where(F.col(generated).isNotNull() & F.col(real).isNotNull())
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.when(F.abs(d) <= near, 1.0).otherwise(0.0)).alias("within"), F.avg(F.abs(F.col(generated) / shrink - F.col(real))).alias("mae_shrunk"),
        F.avg(F.when(F.abs(F.col(real)) >= 0.3, 1.0).otherwise(0.0)).alias("strong"), F.stddev_pop(generated).alias("sd_generated"), F.stddev_pop(real).alias("sd_real"),
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): guarded correlations of all column pairs in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def average_ranks(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Adds ranks with ties at their mean."""
    values = average_value_ranks(df.groupBy(*by, x).agg(F.count("*").alias("n_")), by, x, "n_", out)
    return _looked_up(df, values, [*by, x], out)


def _looked_up(df: DataFrame, values: DataFrame, on: list[str], out: str) -> DataFrame:
    """Rows with ``out`` of their values; nulls are equal to nulls."""
    named = values.select(*[F.col(c).alias(f"on{i}_") for i, c in enumerate(on)], out)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"on{i}_")) for i, c in enumerate(on)])
    return df.join(named, same).select(*df.columns, out)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho): correlation of average ranks; null for under three pairs or a constant column.

    Equal pairs are counted first and only distinct values are ranked, in
    ranges, so neither a large group nor a frequent value meets in one task.
    Ranks are centred at (n + 1) / 2, their mean, and halves are exact, so sums
    of squares lose nothing to their mean.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n_"))
    pairs = written(pairs, "pairs")
    alike = pairs.schema[x].dataType == pairs.schema[y].dataType
    side = lambda c: pairs.select(*by, F.lit(c).alias("side_"), (F.col(c) if alike else F.col(c).cast("double")).alias("value_"), "n_")
    both = average_value_ranks(side(x).unionByName(side(y)), [*by, "side_"], "value_", "n_", "rank_")  # both columns in one pass
    ranked = pairs
    for value, out in ((x, "rx_"), (y, "ry_")):
        own = both.where(F.col("side_") == value).select(*by, F.col("value_").cast(pairs.schema[value].dataType).alias(value), F.col("rank_").alias(out))
        ranked = _looked_up(ranked, own, [*by, value], out)
    size = pairs.groupBy(*by).agg(F.sum("n_").alias("size_"))
    centred = _looked_up(ranked, size, by, "size_") if by else ranked.crossJoin(F.broadcast(size))
    dx, dy = (F.col(c) - (F.col("size_") + 1) / 2 for c in ("rx_", "ry_"))
    sums = centred.groupBy(*by).agg(F.first("size_").alias("size_"), *[F.sum(F.col("n_") * e).alias(n) for e, n in ((dx * dx, "xx_"), (dy * dy, "yy_"), (dx * dy, "xy_"))])
    rho = F.when((F.col("size_") >= 3) & (F.col("xx_") > 0) & (F.col("yy_") > 0), F.col("xy_") / F.sqrt(F.col("xx_")) / F.sqrt(F.col("yy_")))
    return sums.select(*by, rho.alias("rho"))


def simple_ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def two_predictor_ols(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """(by, b0, b1, b2, r2) from centred sums."""
    c = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    s = df.groupBy(*by).agg(
        c(x1, x1).alias("s11"), c(x2, x2).alias("s22"), c(x1, x2).alias("s12"), c(x1, y).alias("s1y"), c(x2, y).alias("s2y"), c(y, y).alias("syy"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det)
    b2 = F.try_divide(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det)
    s = s.withColumn("b1", b1).withColumn("b2", b2)
    return s.select(*by, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", F.try_divide(F.col("b1") * F.col("s1y") + F.col("b2") * F.col("s2y"), F.col("syy")).alias("r2"))


def cronbach_alpha(df: DataFrame, by: list[str], items: list[str]) -> DataFrame:
    """(by, n, alpha): complete rows only; null for under 2 items, under 3 rows or no variance of the total."""
    k = len(items)
    rows = df.dropna(subset=items)
    total = reduce(lambda a, b: a + b, [F.col(i).cast("double") for i in items])
    parts = reduce(lambda a, b: a + b, [F.var_samp(i) for i in items])
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(total).alias("whole"), parts.alias("parts"))
    alpha = F.when((F.lit(k) >= 2) & (F.col("n") >= 3) & (F.col("whole") > 0), F.lit(k / max(k - 1, 1)) * (1 - F.try_divide(F.col("parts"), F.col("whole"))))
    return stats.select(*by, "n", alpha.alias("alpha"))


def paired_t(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, mean_diff, t, wins): paired comparison a - b; wins counts a < b."""
    d = F.col(a) - F.col(b)
    s = df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.sum(F.when(d < 0, 1).otherwise(0)).alias("wins"))
    return s.select(*by, "n", "mean_diff", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n")).alias("t"), "wins")


def mismatch_rate(df: DataFrame, by: list[str], got: str, expected: str) -> DataFrame:
    """(by, n_trials, n_mismatches, mismatch_rate, avg_diff)."""
    d = F.col(got) - F.col(expected)
    return df.groupBy(*by).agg(F.count("*").alias("n_trials"), F.sum(F.when(d != 0, 1).otherwise(0)).alias("n_mismatches"), F.avg(F.when(d != 0, 1.0).otherwise(0.0)).alias("mismatch_rate"), F.avg(d).alias("avg_diff"))


def grid_search(df: DataFrame, similarity: str, n: str, extra: Column, error: str, sims: list[float], ns: list[int], least: int = 10) -> DataFrame:
    """One row per threshold pair that ``least`` rows pass: coverage and errors rounded to even, and the difference of the rounded ones."""
    grid = [F.struct(F.lit(float(s)).alias("sim_thresh"), F.lit(m).alias("n_thresh")) for s in sims for m in ns]
    rows = df.withColumn("g", F.explode(F.array(*grid))).select("g.*", similarity, n, error, extra.alias("extra_"))
    ok = (F.col(similarity) >= F.col("sim_thresh")) & (F.col(n) >= F.col("n_thresh")) & F.col("extra_")
    got = rows.groupBy("sim_thresh", "n_thresh").agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_passing"), F.bround(100 * F.avg(F.when(ok, 1.0).otherwise(0.0)), 1).alias("pct_coverage"),
        F.bround(F.avg(F.when(ok, F.col(error))), 4).alias("avg_error_passing"), F.bround(F.avg(F.when(~ok, F.col(error))), 4).alias("avg_error_failing"),
    )
    return got.where(F.col("n_passing") >= least).withColumn("error_reduction", F.col("avg_error_failing") - F.col("avg_error_passing"))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds no_, 0.. in key order: for tables of items or clusters, not of respondents."""
    return df.withColumn("no_", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)) - 1)


def bootstrap_draws(items: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """(repeat, no_): n-of-n index draws for each repeat; items has no_ from 0."""
    n = items.agg(F.count("*").alias("n_"))
    rep = items.select("no_").crossJoin(F.broadcast(n)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rep.select("repeat", F.floor(uniform(seed, "repeat", "no_") * F.col("n_")).alias("no_"))


def bootstrap_interval(items: DataFrame, repeats: int, stat: Column, low: float = 0.025, high: float = 0.975, seed: int = 0) -> DataFrame:
    """(value, ci_low, ci_high): the statistic over the items (or clusters with sufficient statistics) and its resampled interval.

    For tables of items; over respondents, ``resampling.poisson_interval`` needs one pass.
    """
    drawn = bootstrap_draws(items, repeats, seed).join(items, "no_").groupBy("repeat").agg(stat.alias("s"))
    ci = drawn.agg(F.percentile("s", F.lit(low)).alias("ci_low"), F.percentile("s", F.lit(high)).alias("ci_high"))
    return items.agg(stat.alias("value")).crossJoin(ci)


def correlation_noise(r: Column, n: int | Column) -> Column:
    """Mean absolute gap between two correlations of n rows by chance alone; null for one row."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.try_divide(F.lit(0.798 * 2**0.5) * (1 - r * r), F.sqrt((n - 1).cast("double")))


def balanced_batches(scales: list[tuple[str, int]], most: int = 30) -> list[list[str]]:
    """Scales (name, items) in the given order, each into the emptiest batch with room, else a new one: a small greedy design."""
    batches: list[tuple[int, list[str]]] = []
    for name, size in scales:
        room = [i for i, (n, _) in enumerate(batches) if n + size <= most]
        if room:
            i = min(room, key=lambda j: batches[j][0])
            batches[i] = (batches[i][0] + size, [*batches[i][1], name])
        else:
            batches.append((size, [name]))
    return [names for _, names in batches]
