"""A whole generation request in one call: people are sampled, items are matched, batches survive the driver, and the report has every column."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.operators import generation, people, reports, retrieval, sampling
from tallyweave.plans import generate
from tallyweave.sources import files
from tallyweave.sources.providers import Embedder, embedded
from tallyweave.sources.shared import written

#: Named filters of respondents: field, label, how it is compared, whether its codes are left out.  Fixed values.
FILTERS = {"employed": ("wrkstat", "working", "contains", False), "married": ("marital", "married", "exact", False), "religious": ("relig", "none", "exact", True)}
#: Variables that are looked at for an item, and what one of quality has at least.
CANDIDATES, LEAST_N, LEAST_YEARS = 15, 200, 2
#: Columns of the coverage report, in its order.
REPORT = [
    "item", "method", "matched_variable", "matched_label", "similarity_top1", "real_n_min", "years_fielded_min", "n_candidates_used", "confidence_tier", "confident_match", "calibrated_produced",
    "raw_propensity_std", "low_variance_flag", "tie_concentration", "high_tie_concentration_flag", "anchor_forced_degenerate", "expected_error", "expected_error_std", "expected_error_n_cases",
]


class Known(NamedTuple):
    """What a request draws on.

    ``people``: respondents with a unique key, a weight and coded fields.
    ``variables``: variable, label, embedding, n, years and the ordered shares
    of its categories (null where it has no statistics).  ``generic``: one row
    with the general cuts.  ``lookup``: past errors by similarity.
    """

    people: DataFrame
    variables: DataFrame
    generic: DataFrame
    lookup: DataFrame


def codebook_rows(spark: SparkSession) -> DataFrame:
    """(variable, code, label) of the published codes."""
    return spark.createDataFrame([(f, c, v) for f, labels in people.CODEBOOK.items() for c, v in labels.items()], "variable string, code int, label string")


def filtered_people(pool: DataFrame, filters: list[str], least_age: float | None = None, most_age: float | None = None) -> DataFrame:
    """Respondents that pass the named filters, with an age in the range."""
    labels = codebook_rows(pool.sparkSession)
    for name in filters:
        field, label, how, without = FILTERS[name]
        codes = sampling.codes_matching(labels, field, [label], how)
        # A code that isn't there differs from all: where the filter leaves codes out, its row stays.
        pool = sampling.filter_by_label(pool.withColumn(field, F.col(field).cast("int")), field, codes, without)
    return people.between(pool, "age", least_age, most_age)


def sample_people(
    pool: DataFrame, n: int, seed: int, key: str, weight: str, mode: str = "representative", filters: list[str] | None = None,
    least_age: float | None = None, most_age: float | None = None, female: float | None = None, white: float | None = None,
) -> DataFrame:
    """(person, the pool's columns): n weighted draws with replacement, numbered from 0.

    ``representative`` draws from all; ``custom`` from those that pass the
    filters, and with a share of women or of white respondents by quotas of the
    four cells, both shares taken as independent; a share that isn't given is
    that of the filtered respondents.  A cell without respondents gives none.
    No respondent left is a ValueError.
    """
    if mode not in ("representative", "custom"):
        raise ValueError("the mode is representative or custom")
    if mode == "custom":
        pool = generation.require_rows(filtered_people(pool, filters or [], least_age, most_age), "no respondents are left: loosen the filters")
    if mode == "representative" or (female is None and white is None):
        drawn = sampling.draw(sampling.weight_slots(pool, weight, key), sampling.uniform_draws(pool.sparkSession, n, seed))
        return drawn.withColumn("person", F.col("draw_no")).drop("draw_no", "u")
    marked = written(pool.withColumn("woman_", F.coalesce(F.col("sex") == 2, F.lit(False))).withColumn("white_", F.coalesce(F.col("race") == 1, F.lit(False))), "people")
    share = lambda given, c: F.lit(float(given)) if given is not None else F.avg(F.col(c).cast("double"))
    both = marked.agg(share(female, "woman_").alias("w"), share(white, "white_").alias("r"))
    part = lambda c, yes: F.col(c) if yes else 1 - F.col(c)
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("woman_"), F.lit(r).alias("white_"), (part("w", w) * part("r", r)).alias("share")) for w in (True, False) for r in (True, False)])).alias("c")
    cells = written(both.select(cells).select("c.*"), "cells")
    # A man is a respondent coded as one; a missing code belongs to no cell.
    coded = marked.where("sex IN (1, 2)")
    drawn = reports.quota_sample(coded, cells, n, ["woman_", "white_"], weight, key, seed)
    # Numbered in the shuffled order, which is that of the draws' own numbers: a table of n rows.
    order = Window.orderBy(reports.shuffled(seed, "draw_no"), "draw_no")
    return drawn.withColumn("person", (F.row_number().over(order) - 1).cast("bigint")).drop("draw_no", "u", "woman_", "white_")


def item_candidates(items: DataFrame, variables: DataFrame, embedder: Embedder | None = None, most: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, label, similarity, n, years, usable, quality): the variables nearest to each item's text that have statistics.

    ``items`` has item, text and kind, and embedding where no ``embedder`` is
    given.  Ranks count all the nearest; those without statistics are left out.
    """
    asked = embedded(items, "text", embedder) if embedder else items
    near = retrieval.similar(asked.select(F.col("item").alias("query_id"), F.col("embedding").alias("q")), variables.select(F.col("variable").alias("vec_id"), F.col("embedding").alias("v")), most, exclude_self=False)
    known = variables.where("shares IS NOT NULL").select(F.col("variable").alias("vec_id"), "label", "n", "years", F.size("shares").alias("k_"), F.array_max("shares").alias("top_"))
    rows = near.join(known, "vec_id").join(items.select(F.col("item").alias("query_id"), "kind"), "query_id")
    fits = lambda kind: F.coalesce(retrieval.usable_anchor(F.col("k_"), F.col("top_"), kind), F.lit(False))
    rows = rows.withColumn("usable", F.when(F.col("kind") == "binary", fits("binary")).otherwise(fits("likert")))
    quality = F.col("usable") & (F.col("n") >= LEAST_N) & (F.col("years") >= LEAST_YEARS)
    return rows.select("query_id", "rank", "vec_id", "label", "similarity", "n", "years", "usable", quality.alias("quality"))


def match_labels(candidates: DataFrame, chosen: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, nearest, nearest_label, nearest_n, nearest_years, matched_label): labels of what ``chosen`` took, and the nearest variable of each item."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.withColumn("good_", F.when(F.col("quality"), F.sum(F.col("quality").cast("int")).over(order))).join(chosen.select("query_id", "method", "matched"), "query_id")
    took = F.when(F.col("method") == "ensemble", F.coalesce(F.col("good_") <= most, F.lit(False))).when(F.col("method") == "single_best", F.col("vec_id").cast("string") == F.col("matched")).otherwise(False)
    listed = F.array_sort(F.collect_list(F.when(took, F.struct("rank", "label"))))
    return rows.groupBy("query_id").agg(
        *[F.min_by(F.col(c), "rank").alias(n) for c, n in (("vec_id", "nearest"), ("label", "nearest_label"), ("n", "nearest_n"), ("years", "nearest_years"))],
        F.array_join(F.transform(listed, lambda x: x["label"]), "; ").alias("matched_label"),
    )


def resumed_scores(prompts: DataFrame, provider: generation.Provider, path: str, request: str, rounds: int = 8, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(batch, answer) of ``prompts`` (batch, n_people, n_items, prompt): asked in rounds, each appended to the table at ``path`` when it is done.

    A run that starts again asks only for batches that the table lacks for the
    same ``request``, so a lost driver costs one round at most.  ``progress``
    gets the finished and all batches after each round.  Of a batch that was
    written twice, by runs at the same time, the smallest answer counts.
    """
    spark = prompts.sparkSession
    finished = lambda: spark.read.schema("request string, batch string, answer string").parquet(path).where(F.col("request") == request)
    spark.createDataFrame([], "request string, batch string, answer string").write.mode("append").parquet(path)
    total = prompts.count()
    left = written(files.unfinished(prompts, finished(), ["batch"]).withColumn("slot_", F.pmod(F.xxhash64("batch"), F.lit(rounds))), "left")
    sizes = dict(left.groupBy("slot_").count().collect())  # a row a round
    done = total - sum(sizes.values())
    for slot, n in sorted(sizes.items()):
        asked = left.where(F.col("slot_") == slot).drop("slot_")
        generation.score_batches(asked, provider).select(F.lit(request).alias("request"), F.col("batch").cast("string"), "answer").write.mode("append").parquet(path)
        done += n
        if progress:
            progress(done, total)
    return finished().groupBy("batch").agg(F.min("answer").alias("answer"))


def batch_prompts(rows: DataFrame, persona: Column, items: DataFrame, size: int) -> DataFrame:
    """(batch, n_people, n_items, prompt) of people numbered in ``person``: slices of ``size`` in their order."""
    placed = rows.select(F.floor(F.col("person") / size).cast("string").alias("batch"), (F.col("person") % size + 1).alias("position"), persona.alias("persona_"))
    sizes = placed.groupBy("batch").agg(F.count("*").alias("n_people")).withColumn("n_items", F.lit(items.count()))
    prompts = generation.prompt_text(placed, ["batch"], F.col("persona_"), "position").join(sizes, "batch")
    return generation.with_items(prompts, items).select("batch", "n_people", "n_items", "prompt")


def whole_request(
    known: Known, items: DataFrame, n: int, seed: int, key: str, weight: str, provider: generation.Provider, path: str, embedder: Embedder | None = None, persona: Column | None = None,
    mode: str = "representative", filters: list[str] | None = None, least_age: float | None = None, most_age: float | None = None, female: float | None = None, white: float | None = None,
    scale: int = 5, size: int = generate.BATCH_SIZE, confirmed: bool = False, high: float = 0.75, low: float = 0.5, progress: Callable[[int, int], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The dataset (person, item, raw, response, source) and the coverage report (``REPORT``) of one request, from texts to answers.

    ``items`` has item (1.. without gaps), text and kind (likert or binary), and
    embedding where no ``embedder`` is given.  Answers lie at ``path`` under a
    name made of the items, the sample and the batch size: the same call after
    a failure goes on where it stopped.
    """
    generation.check_request(items.count(), n, scale, confirmed)
    drawn = written(sample_people(known.people, n, seed, key, weight, mode, filters, least_age, most_age, female, white), "sample")
    found = written(item_candidates(items, known.variables, embedder), "candidates")
    persona = people.described() if persona is None else persona
    prompts = written(batch_prompts(drawn, persona, items.select("item", "text"), size), "prompts")
    name = prompts.agg(F.md5(F.concat_ws(":", F.lit(str(size)), F.array_sort(F.collect_list(F.md5(F.concat_ws(":", "batch", "prompt").cast("binary")))))).alias("name")).first()["name"]
    answers = resumed_scores(prompts, provider, path, name, progress=progress).join(prompts.select("batch", "n_people", "n_items"), "batch")
    long = generation.long_scores(answers, ["batch"]).select((F.col("batch").cast("bigint") * size + F.col("person")).alias("person"), "item", "raw")
    scores = written(long, "scores")

    chosen = generate.targets(found, known.variables.where("shares IS NOT NULL").select(F.col("variable").alias("vec_id"), "shares"), high, low)
    chosen = chosen.join(match_labels(found, chosen), "query_id")
    chosen = items.select("item", "text", "kind").join(chosen, items["item"] == chosen["query_id"], "left").drop("query_id")
    chosen = written(chosen.fillna({"method": "none", "tier": "low", "forced_degenerate": False}), "targets")
    parts, flags = [], []
    for kind, levels in (("likert", scale), ("binary", 2)):
        own = chosen.where(F.col("kind") == kind)
        data, report = generate.request(scores.join(F.broadcast(own.select("item")), "item", "left_semi"), "person", own, known.generic, levels)
        parts.append(data.withColumn("response", F.col("response") - (1 if kind == "binary" else 0)))
        flags.append(report.drop("tier", "n"))
    dataset = scores.join(parts[0].unionByName(parts[1]), ["person", "item"]).select("person", "item", "raw", "response", "source")

    c = F.col
    report = retrieval.expected_error(chosen.drop("cuts"), known.lookup, "top1").join(flags[0].unionByName(flags[1]), "item", "left")
    none = c("method") == "none"  # the report names the nearest variable then, which wasn't used
    named = report.select(
        c("item").alias("no_"), c("text").alias("item"), "method", F.when(none, c("nearest").cast("string")).otherwise(c("matched")).alias("matched_variable"),
        F.when(none, c("nearest_label")).otherwise(c("matched_label")).alias("matched_label"), c("top1").alias("similarity_top1"), F.when(none, c("nearest_n")).otherwise(c("n_min")).alias("real_n_min"),
        F.when(none, c("nearest_years")).otherwise(c("years_min")).alias("years_fielded_min"), F.greatest(F.coalesce("n_used", F.lit(1)), F.lit(1)).alias("n_candidates_used"), c("tier").alias("confidence_tier"),
        (c("tier") != "low").alias("confident_match"), F.coalesce(c("source") == "calibrated", F.lit(False)).alias("calibrated_produced"), c("raw_std").alias("raw_propensity_std"), c("low_variance").alias("low_variance_flag"),
        "tie_concentration", c("high_ties").alias("high_tie_concentration_flag"), c("forced_degenerate").alias("anchor_forced_degenerate"), "expected_error", "expected_error_std", c("expected_error_n").alias("expected_error_n_cases"),
    )
    return dataset, named.orderBy("no_").select(*REPORT)


def wide_dataset(dataset: DataFrame, people_: DataFrame, fields: list[str], items: list[int]) -> DataFrame:
    """A row per person with ``fields`` and item_N_raw_propensity, item_N_response and item_N_source."""
    values = [F.max(F.when(F.col("item") == i, F.col(c))).alias(f"item_{i}_{n}") for i in items for c, n in (("raw", "raw_propensity"), ("response", "response"), ("source", "source"))]
    return people_.select("person", *fields).join(dataset.groupBy("person").agg(*values), "person", "left")

