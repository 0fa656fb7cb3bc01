"""Rank calibration of raw scores onto a target distribution, fallbacks and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import clip, left_rank, ratio, rescale_rank
from tallyweave.operators.ranks import ordinal_ranks


def percentiles(df: DataFrame, item: list[str], raw: str, tie: str) -> DataFrame:
    """Adds rank_ (first come, by ``tie``) and percentile = rank / n within the item; an item's rows are ranked in ranges."""
    ranked = ordinal_ranks(df, item, [raw, tie], "rank_")
    return ranked.withColumn("percentile", F.col("rank_") / F.col("total_")).drop("total_")


def calibrate(scored: DataFrame, m: int, cuts: str = "cuts") -> Column:
    """Scale value 1..m of ``percentile`` by the target's cut points."""
    return rescale_rank(left_rank(cuts, "percentile"), F.size(cuts), m)


def calibrated_batch(scores: DataFrame, target: DataFrame, item: list[str], raw: str, tie: str, m: int, on: list[str] | None = None) -> DataFrame:
    """Scores with ``response``: percentile ranks mapped onto the target's cut points.

    ``target`` has cuts, one row, or a row per item if ``on`` names the join columns.
    """
    ranked = percentiles(scores, item, raw, tie)
    joined = ranked.join(F.broadcast(target), on) if on else ranked.crossJoin(F.broadcast(target.limit(1)))
    return joined.withColumn("response", calibrate(joined, m)).drop("rank_")


def naive_bin(raw: Column, k: int) -> Column:
    """Equal-width bin 1..k of a raw score in [0, 1]."""
    return clip((raw * k).cast("int") + 1, 1, k)


def quality_flags(df: DataFrame, item: list[str], raw: str, least_sd: float = 0.06, most_tied: float = 0.8) -> DataFrame:
    """(item, n, raw_std, tie_concentration, low_variance, high_ties, degenerate): spread and ties of raw scores."""
    counts = df.groupBy(*item, F.col(raw).alias("raw_")).agg(F.count("*").alias("c"))
    n = F.sum("c")
    mean = ratio(F.sum(F.col("c") * F.col("raw_")), n)
    spread = counts.join(counts.groupBy(*item).agg(mean.alias("mean_")), item)
    out = spread.groupBy(*item).agg(
        F.sum("c").alias("n"),
        F.sqrt(ratio(F.sum(F.col("c") * (F.col("raw_") - F.col("mean_")) * (F.col("raw_") - F.col("mean_"))), F.sum("c"))).alias("raw_std"),
        ratio(F.max("c"), F.sum("c")).alias("tie_concentration"),
        (F.count("*") < 2).alias("degenerate"),
    )
    return out.withColumn("low_variance", F.col("raw_std") < least_sd).withColumn("high_ties", F.col("tie_concentration") > most_tied)


def confidence_tier(method: Column, forced: Column, n: Column, years: Column, least_n: int = 200) -> Column:
    """high, moderate or low by retrieval method and anchor quality."""
    weak = forced | F.coalesce(n < least_n, F.lit(True)) | F.coalesce(years <= 1, F.lit(True))
    return F.when(method == "ensemble", "moderate").when((method == "single_best") & ~weak, "high").otherwise("low")


def chosen_response(tier: Column, calibrated: Column, population: Column, degenerate: Column) -> Column:
    """The calibrated response unless the tier is low or the calibrated output is constant."""
    return F.when((tier == "low") | degenerate, population).otherwise(calibrated)
