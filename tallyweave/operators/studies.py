"""Studies over held-out cases: compared errors, the coverage gate, pair tables, spread of repeats, descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import mean_distance, ratio, safe_corr
from tallyweave.operators import ranks


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, proportion): rows of each combination and their share of all rows; nulls are a value of their own."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all_")))).select(*columns, "n", ratio("n", "all_").alias("proportion"))


def described(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, std, min, p25, p50, p75, max): sample SD and interpolated quartiles; nulls don't count."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    points = ["p25", "p50", "p75"]
    found = ranks.quantiles(df, by, value, {p: int(p[1:]) / 100 for p in points}).withColumnsRenamed({b: f"{b}_of" for b in by})
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"{b}_of")) for b in by], F.lit(True))
    return plain.join(found, same, "left").select(*by, "n", "mean", "std", "min", *points, "max")


def compared_errors(df: DataFrame, by: list[str], new: str, old: str) -> DataFrame:
    """(by, n, avg_new, avg_old, improvement, improvement_pct, better): two errors of each row; rows without both are left out.

    ``improvement_pct`` is the lowering of the mean in percent of the old one
    (null if that is 0), ``better`` the share of rows where the new error is
    the smaller.
    """
    rows = df.dropna(subset=[new, old])
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(new).alias("avg_new"), F.avg(old).alias("avg_old"), F.avg((F.col(new) < F.col(old)).cast("double")).alias("better"))
    gain = F.col("avg_old") - F.col("avg_new")
    return s.select(*by, "n", "avg_new", "avg_old", gain.alias("improvement"), (100 * ratio(gain, F.col("avg_old"))).alias("improvement_pct"), "better")


def errors_by_bin(cases: DataFrame, bins: DataFrame, similarity: str, new: str, old: str) -> DataFrame:
    """``compared_errors`` by right-closed similarity bin, for the bins that have cases."""
    s = F.col(similarity)
    return compared_errors(cases.join(F.broadcast(bins), (s > F.col("lo")) & (s <= F.col("hi"))), ["lo", "hi"], new, old)


def coverage_gate(candidates: DataFrame, error: str, high: float = 0.75, low: float = 0.5, most: int = 5, least: int = 2, gate: float = 0.12) -> DataFrame:
    """One row per query: method, top1, n_used, error, confident and the same gate for the best match alone.

    ``candidates`` has query_id, rank, similarity, quality and ``error``, each
    candidate's own error.  The first candidate is used from ``high`` on;
    between the limits the first ``most`` of quality, if there are ``least``,
    whose error is the mean weighted by similarity; else none.  A query is
    confident if a method applies, its candidates have quality and the error
    is at most ``gate``.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.withColumn("good_", F.when(F.col("quality"), F.sum(F.col("quality").cast("int")).over(order)))
    used = F.col("good_") <= most
    weight = F.greatest(F.col("similarity"), F.lit(0.0))
    item = rows.groupBy("query_id").agg(
        F.min_by(F.struct("similarity", "quality", F.col(error).alias("error")), "rank").alias("first"),
        F.count(F.when(used, 1)).alias("n_good"), F.sum(F.when(used, weight * F.col(error))).alias("sum_"), F.sum(F.when(used, weight)).alias("weight_"), F.avg(F.when(used, F.col(error))).alias("plain_"),
    )
    top1, own, quality = F.col("first.similarity"), F.col("first.error"), F.col("first.quality")
    method = F.when(top1 >= high, "single_best").when((top1 >= low) & (F.col("n_good") >= least), "ensemble").otherwise("none")
    blended = F.when(F.col("weight_") > 0, F.try_divide("sum_", "weight_")).otherwise(F.col("plain_"))
    item = item.withColumn("method", method).withColumn("error", F.when(F.col("method") == "ensemble", blended).otherwise(own))
    sound = F.when(F.col("method") == "ensemble", True).when(F.col("method") == "single_best", quality).otherwise(False)
    return item.select(
        "query_id", "method", top1.alias("top1"), F.when(F.col("method") == "ensemble", F.least("n_good", F.lit(most))).otherwise(1).cast("bigint").alias("n_used"), "error",
        (sound & (F.col("error") <= gate)).alias("confident"), own.alias("error_single"), ((top1 >= low) & quality & (own <= gate)).alias("confident_single"),
    )


def coverage_summary(cases: DataFrame) -> DataFrame:
    """One row of ``coverage_gate``: cases, coverage in percent of both rules, and mean errors inside and outside the gate."""
    share = lambda c: 100 * F.avg(F.col(c).cast("double"))
    return cases.agg(
        F.count("*").alias("n"), share("confident").alias("coverage"), share("confident_single").alias("coverage_single"), F.avg(F.when(F.col("confident"), F.col("error"))).alias("error_inside"),
        F.avg(F.when(F.col("confident_single"), F.col("error_single"))).alias("error_inside_single"), F.avg(F.when(~F.col("confident"), F.col("error"))).alias("error_outside"),
    )


def shape_study(curves: DataFrame, by: list[str], generic: DataFrame) -> DataFrame:
    """``curves`` (by, curve) with their mean distance from the generic curve (one row, ``generic``) and from the uniform line."""
    joined = curves.crossJoin(F.broadcast(generic.select("generic").limit(1)))
    line = F.transform(F.sequence(F.lit(0), F.size("curve") - 1), lambda i: i / F.greatest(F.size("curve") - 1, F.lit(1)))
    return joined.select(*by, mean_distance("curve", "generic").alias("error_generic"), mean_distance("curve", line).alias("error_uniform"))


def benefit_share(noise: DataFrame, benefits: DataFrame, run: list[str], before: str, after: str) -> DataFrame:
    """``noise`` (.., mean_noise) with ``share_of_benefit``: noise over the mean, across runs, of each run's mean lowering of the error."""
    each = benefits.dropna(subset=[before, after]).groupBy(*run).agg(F.avg(F.col(before) - F.col(after)).alias("b_"))
    return noise.crossJoin(F.broadcast(each.agg(F.avg("b_").alias("b_")))).withColumn("share_of_benefit", ratio("mean_noise", "b_")).drop("b_")


def spread_across_repeats(df: DataFrame, by: list[str], repeat: str, value: str) -> DataFrame:
    """(by, n_repeats, mean, spread): the mean of the repeats' means and the largest distance of one of them from it."""
    means = df.groupBy(*by, repeat).agg(F.avg(value).alias("m_")).where("m_ IS NOT NULL")
    s = means.groupBy(*by).agg(F.count("*").alias("n_repeats"), F.avg("m_").alias("mean"), F.min("m_").alias("lo_"), F.max("m_").alias("hi_"))
    return s.select(*by, "n_repeats", "mean", F.greatest(F.col("hi_") - F.col("mean"), F.col("mean") - F.col("lo_")).alias("spread"))


def reverse_scored(df: DataFrame, value: str, reverse: Column, k: int) -> DataFrame:
    """Rows with ``value`` as (k + 1) - value where ``reverse`` holds."""
    return df.withColumn(value, F.when(reverse, F.lit(k + 1) - F.col(value)).otherwise(F.col(value)))


def pair_correlations(df: DataFrame, batch: str, respondent: str, item: str, value: str) -> DataFrame:
    """(batch, a, b, n, r): guarded correlations of the items that stand in one batch, a < b.

    A respondent's answers (one value an item; the mean of repeated ones) are
    gathered once and paired within that short list, and pairs are summed
    before they are shuffled: the responses are never joined to themselves.
    A list is as long as a batch has items, which its design bounds.
    """
    one = df.where(F.col(value).isNotNull() & F.col(item).isNotNull()).groupBy(batch, respondent, item).agg(F.avg(value).alias("v"))
    lists = one.groupBy(batch, respondent).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "v"))).alias("xs"))
    first = lists.select(batch, F.posexplode("xs").alias("p", "x"), "xs")
    pairs = first.select(batch, "x", F.explode(F.slice("xs", F.col("p") + 2, F.size("xs"))).alias("y"))
    return pairs.groupBy(batch, F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("n"), safe_corr(F.col("x.v"), F.col("y.v")).alias("r"))


def item_pairs(correlations: DataFrame, real: DataFrame, items: DataFrame, batch: str) -> DataFrame:
    """(batch, a, b, same_scale, real_r, gen_r, anchors): pairs that both sides know.

    ``real`` has a, b, r; ``items`` a row per item: item, scale, anchored.
    """
    known = real.where("r IS NOT NULL").select("a", "b", F.col("r").alias("real_r"))
    side = lambda name: items.select(F.col("item").alias(name), F.col("scale").alias(f"scale_{name}"), F.col("anchored").cast("int").alias(f"anchored_{name}"))
    joined = correlations.where("r IS NOT NULL").join(known, ["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    anchors = F.format_string("%d of 2 anchored", F.coalesce("anchored_a", F.lit(0)) + F.coalesce("anchored_b", F.lit(0)))
    return joined.select(batch, "a", "b", (F.col("scale_a") == F.col("scale_b")).alias("same_scale"), "real_r", F.col("r").alias("gen_r"), anchors.alias("anchors"))


def holdout_neighbours(pairs: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    """Leave-one-out study: ``pairs`` (query_id, vec_id, similarity) with the mean distance of the two variables' curves.

    ``curves`` has ``key`` and curve; pairs without both curves are left out.
    """
    own = curves.select(F.col(key).alias("query_id"), F.col("curve").alias("own_"))
    other = curves.select(F.col(key).alias("vec_id"), F.col("curve").alias("other_"))
    joined = pairs.join(own, "query_id").join(other, "vec_id")
    return joined.select("query_id", "vec_id", "similarity", mean_distance("own_", "other_").alias("error"))
