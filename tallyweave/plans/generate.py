"""One generation request: respondents by items, scored in batches, calibrated and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import curve
from tallyweave.operators import calibration, distributions, generation, retrieval
from tallyweave.sources.shared import written

BATCH_SIZE = 8


def scored(people: DataFrame, key: str, persona: Column, bucket: Column, items: DataFrame, provider: generation.Provider, size: int = BATCH_SIZE) -> DataFrame:
    """(key, item, raw): scores of every respondent and item.

    ``items`` has item, from 1 without gaps, and text; it is small and counted once.

    Batches are slices of ``size`` respondents in key order within a bucket, so
    that no window spans all respondents: let the number of buckets grow with
    them.  ``key`` has to be unique and not null.
    """
    rows = generation.batches(people.select(F.col(key), persona.alias("persona_"), bucket.alias("bucket_")), key, size, ["bucket_"])
    rows = rows.withColumn("batch", F.concat_ws("-", "bucket_", "batch"))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n_people")).withColumn("n_items", F.lit(items.count()))
    prompts = generation.prompt_text(rows, ["batch"], F.col("persona_"), "position").join(sizes, "batch")
    answers = generation.score_batches(generation.with_items(prompts, items), provider)
    long = generation.long_scores(answers, ["batch"]).withColumn("position", F.col("person") + 1)
    return long.join(rows.select("batch", "position", key), ["batch", "position"]).select(key, "item", "raw")


def request(scores: DataFrame, key: str, targets: DataFrame, generic: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """The dataset (key, item, response, source) and the coverage report, a row per item.

    ``scores`` has key, item, raw; ``targets`` a row per item with cuts (null
    without a source) and tier; ``generic`` one row with the population's cuts.
    The response is calibrated unless the tier is low, the item has no source
    or its calibrated output is constant; then it is population-calibrated.  A
    null score gives a null response and is counted in n_missing.
    """
    kept = calibration.percentiles(scores.where("raw IS NOT NULL"), ["item"], "raw", key)
    joined = kept.join(F.broadcast(targets.select("item", "cuts", "tier")), "item").crossJoin(F.broadcast(generic.select(F.col("cuts").alias("generic_")).limit(1)))
    both = joined.withColumn("calibrated_", calibration.calibrate(joined, m)).withColumn("population_", calibration.calibrate(joined, m, "generic_"))
    constant = F.coalesce(F.min("calibrated_") == F.max("calibrated_"), F.lit(True))
    both = both.join(F.broadcast(both.groupBy("item").agg(constant.alias("degenerate_"))), "item")
    response = calibration.chosen_response(F.col("tier"), F.col("calibrated_"), F.col("population_"), F.col("degenerate_"))
    source = F.when((F.col("tier") == "low") | F.col("degenerate_"), "population").otherwise("calibrated")
    answered = both.select(key, "item", response.alias("response"), source.alias("source"))
    missing = scores.where("raw IS NULL").select(key, "item", F.lit(None).cast("int").alias("response"), F.lit(None).cast("string").alias("source"))
    dataset = answered.unionByName(missing)
    flags = calibration.quality_flags(scores.where("raw IS NOT NULL"), ["item"], "raw").drop("degenerate")
    used = dataset.groupBy("item").agg(F.max("source").alias("source"), F.count(F.when(F.col("response").isNull(), 1)).alias("n_missing"))
    coverage = targets.select("item", "tier").join(flags, "item", "left").join(used, "item", "left")
    return dataset, coverage


def ensemble_cuts(used: DataFrame, shares: DataFrame, by: str, on: str, n: int = 20) -> DataFrame:
    """(by, cuts): the mean of the variables' n-point curves, weighted by similarity; ``shares`` has ``on`` and shares."""
    weighted = used.withColumn("weight_", retrieval.ensemble_weights(F.col("similarity"), by))
    curves = shares.select(on, curve("shares", n).alias("curve"))
    points = distributions.mean_curve(weighted.join(curves, on), [by], F.col("weight_"))
    return points.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"]).alias("cuts"))


def targets(candidates: DataFrame, shares: DataFrame, high: float = 0.75, low: float = 0.5, most: int = 5) -> DataFrame:
    """A row per item of the choice of its source, with tier and cuts (null without one).

    ``candidates`` is as for ``retrieval_choice``, of items in query_id;
    ``shares`` has vec_id and the ordered shares of each known variable.
    """
    chosen = retrieval.retrieval_choice(candidates, high, low, most)
    chosen = chosen.withColumn("tier", calibration.confidence_tier(F.col("method"), F.col("forced_degenerate"), F.col("n_min"), F.col("years_min")))
    single = chosen.where("method = 'single_best'").join(shares, chosen["matched"] == shares["vec_id"].cast("string"))
    single = distributions.cut_points(single.select("query_id", "shares"), ["query_id"]).select("query_id", "cuts")
    good = candidates.where("quality").withColumn("good_", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("good_") <= most)
    blended = good.join(chosen.where("method = 'ensemble'").select("query_id"), "query_id", "left_semi")
    cuts = single.unionByName(ensemble_cuts(blended, shares, "query_id", "vec_id"))
    return chosen.join(cuts, "query_id", "left")


def generate_dataset(
    items: DataFrame, people: DataFrame, key: str, persona: Column, bucket: Column, candidates: DataFrame, shares: DataFrame, generic: DataFrame,
    lookup: DataFrame, provider: generation.Provider, m: int = 5, confirmed: bool = False, high: float = 0.75, low: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """The dataset (key, item, raw, response, source) and the coverage report, a row per item, of one request.

    ``items`` has item (1.. without gaps), text and kind (likert or binary);
    likert items are answered on 1..m, binary ones by 0 or 1.  ``candidates``
    and ``shares`` are as for ``targets``, ``generic`` has the population's
    cuts, ``lookup`` the past errors by similarity.  Over the limits of a
    request it needs ``confirmed``.  The provider's scores are written before
    they are used, so each batch is asked for once.
    """
    generation.check_request(items.count(), people.count(), m, confirmed)
    scores = written(scored(people, key, persona, bucket, items.select("item", "text"), provider), "scores")
    found = targets(written(candidates, "candidates"), shares, high, low)
    # An item without a candidate has no source.
    found = items.select("item", "text", "kind").join(found, items["item"] == found["query_id"], "left").drop("query_id")
    found = found.fillna({"method": "none", "tier": "low", "n_used": 0, "forced_degenerate": False})
    found = written(found, "targets")
    parts, reports = [], []
    for kind, levels in (("likert", m), ("binary", 2)):
        own = found.where(F.col("kind") == kind)
        data, report = request(scores.join(F.broadcast(own.select("item")), "item", "left_semi"), key, own, generic, levels)
        parts.append(data.withColumn("response", F.col("response") - (1 if kind == "binary" else 0)))
        reports.append(report.drop("tier", "n"))
    dataset = scores.join(parts[0].unionByName(parts[1]), [key, "item"])
    report = retrieval.expected_error(found.drop("cuts"), lookup, "top1").join(reports[0].unionByName(reports[1]), "item", "left")
    report = report.withColumn("calibrated_produced", F.coalesce(F.col("source") == "calibrated", F.lit(False)))
    return dataset.select(key, "item", "raw", "response", "source"), report.withColumnRenamed("top1", "similarity_top1").withColumnRenamed("raw_std", "raw_propensity_std")
