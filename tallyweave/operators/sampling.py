"""Label filters, quotas and weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.draws import uniform
from tallyweave.operators.ranks import running_before


def codes_matching(labels: DataFrame, variable: str, texts: list[str], how: str = "exact") -> DataFrame:
    """Codes of ``variable`` whose lower-case label equals or contains one of the texts; labels has variable, code, label."""
    label = F.lower(F.trim("label"))
    tests = [label == t.lower() if how == "exact" else F.contains(label, F.lit(t.lower())) for t in texts]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return labels.where((F.col("variable") == variable) & hit).select("code")


def filter_by_label(df: DataFrame, column: str, codes: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose code is (or is not) among the codes."""
    return df.join(codes.select(F.col("code").alias(column)).distinct(), column, "left_anti" if negate else "left_semi")


def largest_remainder(cells: DataFrame, total: int, by: list[str], share: str = "share") -> DataFrame:
    """Cells with ``quota``: whole numbers that sum to ``total``, remainders to the largest fractions, ties to the first cells.

    For cell tables: one row a cell.
    """
    exact = F.col(share) * total
    rows = cells.withColumn("floor_", F.floor(exact + 1e-9)).withColumn("part_", exact - F.col("floor_"))
    rows = rows.withColumn("n_", F.row_number().over(Window.orderBy(F.desc(F.round("part_", 9)), *by)))
    left = F.lit(total) - F.sum("floor_").over(Window.partitionBy())
    return rows.withColumn("quota", F.col("floor_") + F.when(F.col("n_") <= left, 1).otherwise(0)).drop("floor_", "part_", "n_")


def weight_slots(df: DataFrame, weight: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Rows of positive weight with lo_ and hi_, gapless slots of [0, 1) in the order of a key, within the strata ``by``.

    Weights are summed as decimals over sorted ranges, so no task sums a whole
    stratum and the slots do not depend on where the ranges are cut.
    """
    share = F.col(weight).cast("decimal(28,6)")
    rows = running_before(df.where(F.col(weight) > 0), by or [], [order], share)
    total = F.col("total_").cast("double")
    lo, hi = F.col("before_"), F.col("before_") + share
    return rows.withColumn("lo_", lo.cast("double") / total).withColumn("hi_", hi.cast("double") / total).drop("before_", "total_")


def draw(slots: DataFrame, draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Draws (draw_no, u and the strata) joined to the slot that u falls into.

    [0, 1) is cut into as many bins as there are draws; a slot stands in each
    bin that it touches, and only rows of one bin are tested, so the work is
    linear in slots and draws.
    """
    by = by or []
    bins = F.lit(max(draws.count(), 1))
    bin_of = lambda c: F.floor(F.col(c) * bins)
    touched = slots.withColumn("bin_", F.explode(F.sequence(bin_of("lo_"), bin_of("hi_"))))
    d = draws.select(*by, "draw_no", "u", bin_of("u").alias("bin_"))
    hit = touched.join(d, [*by, "bin_"]).where("u >= lo_ AND u < hi_")
    return hit.select(*[c for c in slots.columns if c not in ("lo_", "hi_")], "draw_no", "u")


def uniform_draws(spark, n: int, seed: int = 0) -> DataFrame:
    """(draw_no, u): n reproducible draws; another seed gives others."""
    return spark.range(n).select(F.col("id").alias("draw_no"), uniform(seed, "id").alias("u"))


def sample_without_replacement(df: DataFrame, n: int, key: str, order: Column) -> DataFrame:
    """n rows (or all) in the order of a seeded hash, ties to the smaller key."""
    return df.withColumn("o_", order).orderBy("o_", key).limit(n).drop("o_")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without nulls in the columns."""
    return df.dropna(subset=columns)
