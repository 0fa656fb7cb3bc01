"""Reports built from the other operators: code repair, confidence scores, comparisons, quota samples, tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.columns import clip, max_distance, ratio, running_sum, safe_corr
from tallyweave.functions.draws import uniform
from tallyweave.operators import distributions, sampling, validation

#: Code ranges of exports that shift a 1 to 7 scale, and the shift.  Fixed values.
SHIFTED_CODES = ((36, 42, 35), (8, 14, 7))


def repaired_codes(df: DataFrame, item: list[str], code: str) -> DataFrame:
    """Rows with ``code`` shifted back and ``shift`` (null if none) where all codes of the item lie in a shifted range.

    Null codes stay null and don't count for the range.
    """
    ranges = df.groupBy(*item).agg(F.min(code).alias("min_"), F.max(code).alias("max_"))
    shift = F.lit(None).cast("int")
    for low, high, by in reversed(SHIFTED_CODES):
        shift = F.when((F.col("min_") >= low) & (F.col("max_") <= high), by).otherwise(shift)
    joined = df.join(ranges.select(*item, shift.alias("shift")), item)
    return joined.withColumn(code, F.col(code) - F.coalesce("shift", F.lit(0)))


def items_in_range(shares: DataFrame, item: list[str], k: int, cat: str = "cat", weight: str = "weight") -> DataFrame:
    """(item, usable): false if a category lies outside 1..k or the weights don't sum to more than 0."""
    c = F.expr(f"try_cast({cat} AS double)")
    outside = F.coalesce(~c.between(1, k), F.lit(True))
    return shares.groupBy(*item).agg((~F.bool_or(outside) & (F.coalesce(F.sum(weight), F.lit(0.0)) > 0)).alias("usable"))


def confidence_model(cases: DataFrame, similarity: str, n_a: str, n_b: str, error: str) -> DataFrame:
    """One row b0, b1, b2, r2, low, high: error by similarity and ln of the lesser n (cases with both n > 0), and the range of errors."""
    rows = cases.where((F.col(n_a) > 0) & (F.col(n_b) > 0)).withColumn("ln_n_", F.ln(F.least(n_a, n_b)))
    fit = validation.two_predictor_ols(rows, [], error, similarity, "ln_n_")
    return fit.crossJoin(rows.agg(F.min(error).alias("low"), F.max(error).alias("high")))


def confidence_scores(df: DataFrame, model: DataFrame, similarity: str, n_a: str, n_b: str) -> DataFrame:
    """Rows with ``confidence``: 1 where the predicted error is the lowest seen, 0 where it is the highest."""
    joined = df.crossJoin(F.broadcast(model))
    predicted = F.col("b0") + F.col("b1") * F.col(similarity) + F.col("b2") * F.ln(F.greatest(F.least(n_a, n_b), F.lit(1)))
    held = F.least(F.greatest(predicted, F.col("low")), F.col("high"))
    score = clip(1 - ratio(held - F.col("low"), F.col("high") - F.col("low")), 0.0, 1.0)
    return joined.withColumn("confidence", score).drop("b0", "b1", "b2", "r2", "low", "high")


def paired_summary(df: DataFrame, generated: str, real: str, by: list[str] | None = None, reliable: float = 0.7) -> DataFrame:
    """Means, medians, differences and reliable counts of two values of each row; rows without both are left out."""
    d = F.col(generated) - F.col(real)
    count = lambda test: F.count(F.when(test, 1))
    return df.dropna(subset=[generated, real]).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(generated).alias("mean_generated"), F.avg(real).alias("mean_real"),
        F.percentile(generated, F.lit(0.5)).alias("median_generated"), F.percentile(real, F.lit(0.5)).alias("median_real"),
        count(d > 0).alias("n_higher"), F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"),
        count(F.col(generated) >= reliable).alias("reliable_generated"), count(F.col(real) >= reliable).alias("reliable_real"),
    )


def two_stage_mean(df: DataFrame, by: list[str], stage: str, value: str) -> DataFrame:
    """(by, n_stages, value): the mean over stages of each stage's mean, so that large stages don't weigh more."""
    first = df.groupBy(*by, stage).agg(F.avg(value).alias("m_"))
    return first.groupBy(*by).agg(F.count(stage).alias("n_stages"), F.avg("m_").alias(value))


def item_comparison(generated: DataFrame, real: DataFrame, by: list[str]) -> DataFrame:
    """A row per item that both have: means, SDs, tails of both, largest gap of the cumulative shares, and that gap with the real scale reversed.

    Both have ``shares``, an array of one length per item.
    """

    def side(arrays: DataFrame, suffix: str) -> DataFrame:
        positions = distributions.with_positions(arrays, by)
        stats = distributions.moments(positions, by).join(distributions.tail_shares(positions, by), by)
        return stats.join(arrays.select(*by, F.col("shares").alias("shares")), by).withColumnsRenamed({c: f"{c}_{suffix}" for c in [*stats.columns, "shares"] if c not in by})

    both = side(generated, "generated").join(side(real, "real"), by)
    both = both.withColumn("mean_diff", F.col("mean_generated") - F.col("mean_real"))
    both = both.withColumn("ks", max_distance(running_sum("shares_generated"), running_sum("shares_real")))
    both = both.withColumn("ks_reversed", max_distance(running_sum("shares_generated"), running_sum(F.reverse("shares_real"))))
    return both.drop("shares_generated", "shares_real")


def summary_blocks(pairs: DataFrame, blocks: dict[str, Column], generated: str, real: str, least: int = 10) -> DataFrame:
    """(block, error statistics, r) of the pairs that meet each block's condition, in one pass; blocks of fewer than ``least`` pairs are left out."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in blocks.items()]))
    rows = pairs.where(F.col(generated).isNotNull() & F.col(real).isNotNull()).withColumn("block", F.explode(names))
    r = rows.groupBy("block").agg(safe_corr(generated, real).alias("r"))
    return validation.error_stats(rows, generated, real, ["block"]).where(F.col("n") >= least).join(r, "block")


def quota_sample(people: DataFrame, cells: DataFrame, total: int, by: list[str], weight: str, key: str, seed: int = 0) -> DataFrame:
    """``total`` weighted draws with replacement: each cell's quota by largest remainder, then draws within the cell, in shuffled order.

    ``cells`` has the columns ``by`` and share, one row a cell; rows without a
    positive weight are never drawn; a cell without people gives none.
    """
    quotas = sampling.largest_remainder(cells, total, by).where("quota > 0")
    numbered = validation.numbered(quotas, by)
    draws = numbered.withColumn("i_", F.explode(F.sequence(F.lit(1), F.col("quota"))))
    number = F.col("no_") * F.lit(total) + F.col("i_")
    draws = draws.select(*by, number.alias("draw_no"), uniform(seed, number).alias("u"))
    drawn = sampling.draw(sampling.weight_slots(people, weight, key, by), draws, by)
    return drawn.withColumn("order_", shuffled(seed, "draw_no")).orderBy("order_", "draw_no").drop("order_")


def shuffled(seed: int, number: str) -> Column:
    """What a seeded shuffle orders rows by; ties by the number."""
    return uniform(seed, F.lit("order"), number)


def key_values(pairs: Column) -> Column:
    """A map as text: ``key = value`` in key order, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"].cast("string"), F.lit(" = "), e["value"].cast("string"))), "; ")


def signed_number(x: Column, places: int = 2) -> Column:
    """A number with its sign and fixed decimals; ``n/a`` for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%+.{places}f", x))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the density's tail in the angle atan(t / sqrt(df)), by Gauss-Legendre quadrature."""
    if not (df > 0) or t is None or math.isnan(t):
        return math.nan
    low = math.atan(abs(t) / math.sqrt(df))
    high = min(math.pi / 2, low + 40 / math.sqrt(df))
    x, w = np.polynomial.legendre.leggauss(200)
    phi = low + (high - low) * (x + 1) / 2
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(scale * (high - low) / 2 * (w * np.cos(phi) ** (df - 1)).sum())


def student_quantile(p: float, df: float) -> float:
    """The t whose two-sided p-value is ``p`` (0 < p < 1), by bisection."""
    if not (df > 0):
        return math.nan
    low, high = 0.0, 1.0
    while student_p(high, df) > p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if student_p(middle, df) > p else (low, middle)
    return high


@F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())]))
def _student(t: pd.Series, df: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"p": [student_p(a, b) for a, b in zip(t, df, strict=True)], "q": [student_quantile(0.05, b) for b in df]})


def paired_t_test(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """``paired_t`` with p (two-sided), ci_low and ci_high (95%); nulls where t is null (fewer than two rows or no spread)."""
    s = validation.paired_t(df, by, a, b)
    s = s.withColumn("s_", _student(F.coalesce("t", F.lit(0.0)), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    half = F.abs(F.try_divide("mean_diff", "t")) * F.col("s_.q")
    known = F.col("t").isNotNull()
    return s.select(*by, "n", "mean_diff", "t", "wins", F.when(known, F.col("s_.p")).alias("p"), F.when(known, F.col("mean_diff") - half).alias("ci_low"), F.when(known, F.col("mean_diff") + half).alias("ci_high"))


def matched_items(items: DataFrame, reference: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Items with their row of ``reference`` by lower-case name, and the items without one, by name; both sides have ``item``."""
    named = reference.withColumn("name_", F.lower(item)).drop(item)
    keyed = items.withColumn("name_", F.lower(item))
    return keyed.join(named, "name_").drop("name_"), keyed.join(named.select("name_"), "name_", "left_anti").drop("name_").orderBy(item)


def without_scale(items: DataFrame, scale: str, excluded: str) -> DataFrame:
    """Items of all scales but one; items without a scale stay."""
    return items.where(~F.col(scale).eqNullSafe(F.lit(excluded)))
