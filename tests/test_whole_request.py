"""Whole requests: sampling, retrieval, batches that survive the driver, and the report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import generation, resampling, summary
from tallyweave.plans import whole_request
from tallyweave.plans.report_queries import checksum_provider as answers
from tallyweave.sources.providers import hashed_letters


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, 18 + i % 60, 1 + i % 2, 1 + (i // 2) % 3, 1 + i % 5, 1 + i % 8, 1 + i % 4, 1.0 + (i % 3)) for i in range(600)]
    return spark.createDataFrame(rows, "k int, age int, sex int, race int, marital int, wrkstat int, relig int, w double")


def test_representative_samples_follow_weights(spark, pool):
    got = whole_request.sample_people(pool, 3000, 4, "k", "w").toPandas()
    assert sorted(got["person"]) == list(range(3000))
    assert abs((got["w"] == 3.0).mean() - 0.5) < 0.04 and got["k"].nunique() < 600
    again = whole_request.sample_people(pool, 3000, 4, "k", "w").toPandas()
    other = whole_request.sample_people(pool, 3000, 5, "k", "w").toPandas()
    assert got.sort_values("person")["k"].tolist() == again.sort_values("person")["k"].tolist() != other.sort_values("person")["k"].tolist()


def test_custom_samples_keep_filters_and_quotas(pool):
    got = whole_request.sample_people(pool, 200, 1, "k", "w", "custom", ["employed", "religious"], 20, 50, female=0.7, white=0.25).toPandas()
    assert sorted(got["person"]) == list(range(200))
    assert set(got["wrkstat"]) <= {1, 2} and 4 not in set(got["relig"]) and got["age"].between(20, 50).all()
    cells = {(s, r): ((got["sex"] == s) & ((got["race"] == 1) == r)).sum() for s in (1, 2) for r in (True, False)}
    assert {k: round(v) for k, v in cells.items()} == {(2, True): 35, (2, False): 105, (1, True): 15, (1, False): 45}
    free = whole_request.sample_people(pool, 50, 1, "k", "w", "custom", ["married"]).toPandas()
    assert set(free["marital"]) == {1} and len(free) == 50
    with pytest.raises(ValueError):
        whole_request.sample_people(pool, 5, 1, "k", "w", "custom", least_age=200)
    with pytest.raises(ValueError):
        whole_request.sample_people(pool, 5, 1, "k", "w", "other")


def known(spark, pool):
    texts = {"trust": "most people can be trusted", "happy": "how happy are you these days", "health": "the state of your own health", "yes": "have you ever been divorced", "none": "how happy are you with life"}
    size = {"trust": [0.2, 0.3, 0.5], "happy": [0.25] * 4, "health": [0.1, 0.4, 0.5], "yes": [0.9, 0.1], "none": None}
    provider = hashed_letters(64)
    unit = lambda v: [float(x / np.linalg.norm(v)) for x in v]
    rows = [(k, t.upper(), unit(provider([t])[0]), 500, 4, size[k]) for k, t in texts.items()]
    variables = spark.createDataFrame(rows, "variable string, label string, embedding array<double>, n int, years int, shares array<double>")
    generic = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i / F.lit(20.0)).alias("cuts"))
    lookup = spark.createDataFrame([(0.0, 0.5, 3, 0.2, 0.1), (0.5, 1.01, 30, 0.05, 0.01)], "lo double, hi double, n long, avg_error double, error_std double")
    return whole_request.Known(pool, variables, generic, lookup)


ITEMS = [(1, "most people can be trusted", "likert"), (2, "zzzz qqqq", "likert"), (3, "have you ever been divorced", "binary"), (4, "how happy are you these days", "likert")]


def test_from_texts_to_answers(spark, pool, tmp_path):
    items, seen = spark.createDataFrame(ITEMS, "item int, text string, kind string"), []
    dataset, report = whole_request.whole_request(known(spark, pool), items, 60, 3, "k", "w", answers, f"file://{tmp_path}/a", hashed_letters(64), mode="custom", female=0.5, progress=lambda done, all_: seen.append((done, all_)))
    assert report.columns == whole_request.REPORT and len(whole_request.REPORT) == 19
    rows = [r for r in report.collect()]
    assert [r["item"] for r in rows] == [t for _, t, _ in ITEMS] and seen[-1] == (8, 8)
    assert [r.method for r in rows] == ["single_best", "none", "single_best", "single_best"]
    assert rows[0].matched_variable == "trust" and rows[0].matched_label == "MOST PEOPLE CAN BE TRUSTED" and rows[0].similarity_top1 == pytest.approx(1.0) and rows[0].confidence_tier == "high" and rows[0].confident_match
    assert rows[1].matched_variable is not None and not rows[1].confident_match and not rows[1].calibrated_produced and rows[1].n_candidates_used == 1
    assert rows[2].matched_variable == "yes" and rows[0].expected_error == 0.05 and rows[0].expected_error_n_cases == 30 and rows[3].real_n_min == 500
    data = dataset.toPandas()
    assert len(data) == 240 and not data["response"].isna().any()
    assert set(data[data["item"] == 3]["response"]) <= {0, 1} and data[data["item"] == 1]["response"].between(1, 5).all()
    counts = data[data["item"] == 1]["response"].value_counts(normalize=True)
    assert counts[1] == pytest.approx(0.2, abs=0.03) and counts[5] == pytest.approx(0.5, abs=0.03)
    people = spark.range(60).select(F.col("id").alias("person"), F.lit("x").alias("field"))
    wide = whole_request.wide_dataset(dataset, people, ["field"], [1, 2, 3, 4])
    assert wide.count() == 60 and {"item_3_response", "item_3_raw_propensity", "item_3_source"} <= set(wide.columns)
    with pytest.raises(ValueError):
        whole_request.whole_request(known(spark, pool), items, 2000, 3, "k", "w", answers, f"file://{tmp_path}/b", hashed_letters(64))


def test_a_killed_run_asks_no_batch_twice(spark, pool, tmp_path):
    """The driver is lost after some rounds; the next run asks for the rest and gives what one run gives."""
    items, asked = spark.createDataFrame(ITEMS, "item int, text string, kind string"), tmp_path / "asked"
    asked.mkdir()

    def noted(batch: dict) -> str:
        import uuid

        (asked / f"{batch['batch']}-{uuid.uuid4().hex}").touch()
        return answers(batch)

    class Lost(Exception):
        pass

    def dies(done, total):
        if done >= 3:
            raise Lost

    call = lambda path, **more: whole_request.whole_request(known(spark, pool), items, 60, 3, "k", "w", noted, f"file://{tmp_path}/{path}", hashed_letters(64), **more)
    with pytest.raises(Lost):
        call("kept", progress=dies)
    before = len(list(asked.iterdir()))
    assert 3 <= before < 8
    dataset, _ = call("kept")
    names = [p.name.split("-")[0] for p in asked.iterdir()]
    assert len(names) == len(set(names)) == 8
    whole, _ = call("fresh")
    assert sorted(map(tuple, dataset.collect())) == sorted(map(tuple, whole.collect()))
    call("kept")
    assert len(list(asked.iterdir())) == 16  # 8 of the fresh run, none of the third
    call("kept", scale=7)  # the same prompts: answers are kept
    assert len(list(asked.iterdir())) == 16


def test_answers_of_other_requests_stay_apart(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), 2, 1, "p") for i in range(5)], "batch string, n_people int, n_items int, prompt string")
    path = f"file://{tmp_path}/t"
    one = whole_request.resumed_scores(prompts, lambda b: '[{"item_1": 0.1}, {"item_1": 0.2}]', path, "one", rounds=2)
    two = whole_request.resumed_scores(prompts, lambda b: '[{"item_1": 0.3}, {"item_1": 0.4}]', path, "two", rounds=3)
    assert {r.answer[12:15] for r in one.collect()} == {"0.1"} and {r.answer[12:15] for r in two.collect()} == {"0.3"}
    assert whole_request.resumed_scores(prompts.limit(0), generation.offline_provider(), path, "three").count() == 0


# The report.
def test_item_table_against_plain_measures(spark):
    rng = np.random.default_rng(1)
    own = {(i, p): rng.dirichlet(np.ones(7)) for i in ("a", "b", "c") for p in (1, 2)}
    real = {"a": rng.dirichlet(np.ones(7)), "b": rng.dirichlet(np.ones(5)), "d": rng.dirichlet(np.ones(7)), "c": np.array([])}
    answers_ = spark.createDataFrame([(i, p, s.tolist()) for (i, p), s in own.items()], "item string, partition int, shares array<double>")
    coverage = spark.createDataFrame([("a", 1, "calibrated", "high", "single_best", "v", 0.8), ("a", 2, "population", "low", "none", None, 0.3), ("b", 2, "population", "low", "none", None, None)], "item string, partition int, source string, tier string, method string, matched string, similarity double")
    known_ = spark.createDataFrame([(i, "s", i == "b", s.tolist()) for i, s in real.items()], "item string, scale string, reverse boolean, shares array<double>")
    got = {r["item"]: r for r in summary.item_table(answers_, coverage, known_).collect()}
    assert set(got) == {"a", "b"} and got["a"].n_sources == 2 and got["a"].source == "calibrated" and got["b"].anchor == "no real anchor" and got["b"].format == "5-point" and got["b"].partitions == 2
    grid = np.arange(1.0, 8.0)
    for item, r in got.items():
        mean = (own[item, 1] + own[item, 2]) / 2
        assert r.spread == pytest.approx(max(abs(own[item, p] @ grid - mean @ grid) for p in (1, 2)))
        for side, s in (("g", mean), ("r", real[item])):
            pos = 1 + 6 * np.arange(len(s)) / (len(s) - 1)
            m = s @ pos
            sd = np.sqrt(s @ (pos - m) ** 2)
            want = (m, sd, s @ ((pos - m) / sd) ** 3, s @ ((pos - m) / sd) ** 4 - 3, s[pos <= 2 + 1e-9].sum(), s[pos >= 6 - 1e-9].sum())
            assert [r[f"{side}_{x}"] for x in summary.MEASURES] == pytest.approx(list(want))
        cdf = lambda s: np.array([s[1 + 6 * np.arange(len(s)) / (len(s) - 1) <= x + 1e-9].sum() for x in grid])
        assert r.cdf_distance == pytest.approx(np.abs(cdf(mean) - cdf(real[item])).mean()) and r.ks == pytest.approx(np.abs(cdf(mean) - cdf(real[item])).max())
        assert r.cdf_distance_flipped == pytest.approx(np.abs(cdf(mean[::-1]) - cdf(real[item])).mean())


def test_intervals_share_draws_and_have_their_width(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=120)
    rows = spark.createDataFrame([(i, i // 4, float(v), float(2 * v + 1)) for i, v in enumerate(x)], "item int, batch int, x double, y double")
    stats = {"mean": F.avg("x"), "twice": F.avg("y"), "n": F.count("x").cast("double")}
    got = {r.statistic: r for r in summary.interval_table(rows, [], ["item"], stats, 800).collect()}
    assert got["twice"].ci_low == pytest.approx(2 * got["mean"].ci_low + 1) and got["n"].ci_low == got["n"].ci_high == 120
    assert got["mean"].ci_high - got["mean"].ci_low == pytest.approx(3.92 * x.std() / np.sqrt(120), rel=0.12)
    clusters = rows.withColumn("x", F.avg("x").over(__import__("pyspark").sql.Window.partitionBy("batch")))
    wide = {r.statistic: r for r in summary.interval_table(clusters, [], ["batch"], stats, 800).collect()}
    spread = np.array([x[i : i + 4].mean() for i in range(0, 120, 4)]).std() / np.sqrt(30)
    assert wide["mean"].ci_high - wide["mean"].ci_low == pytest.approx(3.92 * spread, rel=0.15)
    grouped = summary.interval_table(rows.withColumn("g", F.col("item") < 5), ["g"], ["item"], stats, 20, least=10)
    assert {r.g for r in grouped.collect()} == {False}


def test_seven_blocks_with_their_noise(spark):
    rng = np.random.default_rng(4)
    rows = [(f"b{i % 6}", f"i{i}", f"j{i}", bool(i % 2), f"{i % 3} of 2 anchored", float(r), float(0.8 * r + 0.05 * e)) for i, (r, e) in enumerate(zip(rng.uniform(-0.6, 0.6, 90), rng.normal(size=90), strict=True))]
    pairs = spark.createDataFrame(rows, "batch string, a string, b string, same_scale boolean, anchors string, real_r double, gen_r double")
    report = summary.correlation_report(pairs, pairs.limit(20), 398, 50).collect()
    assert len({r.block for r in report}) == 7 and len({r.statistic for r in report}) == 17
    one = {r.statistic: r for r in report if r.block == "items, all"}
    real, gen = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    assert one["slope"].value == pytest.approx(np.polyfit(real, gen, 1)[0]) and one["intercept"].value == pytest.approx(np.polyfit(real, gen, 1)[1])
    assert one["mae"].noise == pytest.approx((0.798 * np.sqrt(2) * (1 - real**2) / np.sqrt(397)).mean()) and one["bias"].noise is None
    assert one["mae"].ci_low <= one["mae"].value <= one["mae"].ci_high


def test_marginal_noise_stands_beside_its_statistic(spark):
    floor = resampling.noise_floor(spark.createDataFrame([("a", [0.2, 0.3, 0.5]), ("b", [0.5, 0.5])], "item string, shares array<double>"), ["item"], 100, 40)
    noise = {r.statistic: r.noise for r in summary.marginal_noise(floor).collect()}
    assert noise["mean_abs"] == pytest.approx(np.mean([r["mean"] for r in floor.collect()])) and set(noise) == set(summary.NOISE_OF)
    table = spark.createDataFrame([("all", "ks", 0.2), ("all", "mean_gap", 0.1)], "block string, statistic string, value double")
    got = {r.statistic: r.noise for r in summary.with_noise(table, summary.marginal_noise(floor).withColumn("block", F.lit("all")), ["block"]).collect()}
    assert got["ks"] == pytest.approx(noise["ks"]) and got["mean_gap"] is None
