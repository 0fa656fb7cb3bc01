import math

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import columns as C
from tallyweave.operators import calibration, distributions, generation, profile, reports, retrieval, sampling, studies, validation
from tallyweave.plans import generate
from tallyweave.sources import files, providers


def values(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_rescale_rounds_halves_to_even(spark):
    for k, m, want in ((5, 7, [1, 2, 4, 6, 7]), (3, 4, [1, 2, 4]), (1, 7, [4]), (1, 4, [2])):
        assert [values(spark, C.rescale_rank(F.lit(r), F.lit(k), m)) for r in range(1, k + 1)] == want


def test_left_rank(spark):
    assert [values(spark, C.left_rank(doubles(0.2, 0.5, 1), F.lit(p))) for p in (0.2, 0.5, 0.50001, 1.0)] == [1, 2, 3, 3]


def test_first_come_ties(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.2)], "id int, item string, raw double")
    got = {r.id: (r.rank_, round(r.percentile, 3)) for r in calibration.percentiles(rows, ["item"], "raw", "id").collect()}
    assert got == {1: (2, 0.667), 2: (3, 1.0), 3: (1, 0.333)}


def test_curves(spark):
    assert values(spark, C.curve(doubles(0.3, 0.7), 3)) == pytest.approx([0.3, 0.65, 1.0])
    assert values(spark, C.curve(F.array().cast("array<double>"), 3)) == pytest.approx([0, 0.5, 1])
    assert values(spark, C.curve(doubles(1), 3)) == [1, 1, 1]


def test_other_is_left_out_of_curves_but_not_of_usability(spark):
    shares = spark.createDataFrame([("v", "2.0", 0.3), ("v", "10.0", 0.3), ("v", "__other__", 0.4)], "v string, cat string, share double")
    row = distributions.share_arrays(shares, ["v"]).first()
    assert row.cats == [2.0, 10.0] and row.shares == pytest.approx([0.5, 0.5])
    assert not values(spark, retrieval.usable_anchor(F.lit(2), F.lit(0.3)))


def test_largest_remainder_ties_go_to_the_first(spark):
    cells = spark.createDataFrame([(i, p) for i, p in enumerate((0.35, 0.15, 0.35, 0.15))], "cell int, share double")
    assert [r.quota for r in sampling.largest_remainder(cells, 10, ["cell"]).orderBy("cell").collect()] == [4, 2, 3, 1]


def test_bins_are_right_closed(spark):
    items = spark.createDataFrame([(0.4,), (0.5,), (0.75,), (0.0,), (1.01,)], "s double")
    lookup = retrieval.bin_table(spark).withColumn("n", F.lit(9)).withColumn("avg_error", F.lit(1.0)).withColumn("error_std", F.lit(1.0))
    got = {r.s: r for r in retrieval.expected_error(items, lookup, "s").collect()}
    assert got[0.0].expected_error_n == 0 and got[0.4].expected_error is None and got[0.4].expected_error_n == 9


def test_batch_repair(spark):
    for given, want in (((), [0.5] * 3), ((0.1,), [0.1] * 3), ((0.1, 0.2, 0.3, 0.4), [0.1, 0.2, 0.3])):
        scores = doubles(*given) if given else F.array().cast("array<double>")
        assert values(spark, generation.repaired(scores, F.lit(3))) == pytest.approx(want)


def test_json_answers(spark):
    parse = lambda t: values(spark, generation.parsed_scores(F.lit(t)))
    assert parse('```json\n[{"item_1": 0.5}]\n```') == [{"item_1": 0.5}]
    assert parse('{"item_1": 0.5}') == [] and parse("nonsense") == []


def test_label_matching(spark):
    labels = spark.createDataFrame([("m", 1, "Married"), ("m", 5, "Never married"), ("w", 1, "working full time"), ("w", 2, "working part time"), ("w", 3, "temporarily away")], "variable string, code int, label string")
    assert [r.code for r in sampling.codes_matching(labels, "m", ["married"]).collect()] == [1]
    assert sorted(r.code for r in sampling.codes_matching(labels, "w", ["working"], "contains").collect()) == [1, 2]


def test_guarded_statistics(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 1.0), (1.0, 2.0, 4.0)], "c double, x double, y double")
    assert rows.select(C.safe_corr("c", "x").alias("r")).first().r is None
    twins = rows.select("x", F.col("x").alias("z"))
    assert validation.cronbach_alpha(twins.withColumn("g", F.lit(1)), ["g"], ["x", "z"]).first().alpha == pytest.approx(1.0)
    assert validation.cronbach_alpha(twins.withColumn("g", F.lit(1)), ["g"], ["x"]).first().alpha is None
    ranks = validation.average_ranks(spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "g int, x int"), ["g"], "x", "r")
    assert sorted(r.r for r in ranks.collect()) == [1.5, 1.5, 3.0]


def test_weights_and_profile(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", 9.0, 0.0), ("a", None, 1.0)], "g string, v double, w double")
    got = profile.weighted_stats(rows, ["g"], "v", "w").first()
    assert (got.n, got["mean"], got["std"]) == (2, 2.0, 1.0)
    shares = profile.weighted_shares(spark.createDataFrame([("a", i, float(i)) for i in range(1, 26)], "g string, c int, w double"), ["g"], "c", "w")
    top = profile.top_with_other(shares, ["g"]).collect()
    assert len(top) == 21 and math.isclose(sum(r.share for r in top), 1)


def test_ensemble_weights(spark):
    rows = spark.createDataFrame([(1, 0.6), (1, -0.1), (2, -0.1), (2, -0.3)], "query_id int, s double")
    got = [(r.query_id, round(r.w, 6)) for r in rows.select("query_id", retrieval.ensemble_weights(F.col("s")).alias("w")).collect()]
    assert sorted(got) == [(1, 0.0), (1, 1.0), (2, 0.5), (2, 0.5)]


def test_scoring_end_to_end(spark):
    prompts = spark.createDataFrame([(0, 3, 2), (1, 1, 2)], "batch bigint, n_people bigint, n_items bigint")
    got = generation.long_scores(generation.score_batches(prompts, generation.offline_provider(1)), ["batch"]).collect()
    assert len(got) == 8 and all(0 <= r.raw <= 1 for r in got)


def test_resumed_sink(spark, tmp_path):
    planned = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/out"
    files.append_unfinished(planned.limit(1), path, ["k"])
    files.append_unfinished(planned, path, ["k"])
    files.append_unfinished(planned, path, ["k"])
    assert spark.read.parquet(path).count() == 2


def test_balanced_batches():
    assert validation.balanced_batches([("a", 20), ("b", 15), ("c", 10), ("d", 5)]) == [["a", "d"], ["b", "c"]]


def test_slots_cover_the_unit_interval(spark):
    rows = spark.createDataFrame([(i, float(i % 7) - 1) for i in range(200)], "k int, w double")
    slots = sorted((r.lo_, r.hi_) for r in sampling.weight_slots(rows, "w", "k").collect())
    assert slots[0][0] == 0 and slots[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(slots, slots[1:], strict=False))
    assert sampling.draw(sampling.weight_slots(rows, "w", "k"), sampling.uniform_draws(spark, 300)).count() == 300


def test_student_t_equals_tables():
    for df, t in ((1, 12.7062), (4, 2.776445), (9, 2.262157), (30, 2.042272), (100000, 1.959988)):
        assert reports.student_p(t, df) == pytest.approx(0.05, abs=2e-6)
        assert reports.student_quantile(0.05, df) == pytest.approx(t, rel=1e-4)
    assert reports.student_p(0.0, 5) == pytest.approx(1.0)


def test_paired_t_test(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("c", None, 1.0), ("b", 2.0, 2.0)], "g string, x double, y double")
    got = {r.g: r for r in reports.paired_t_test(rows, ["g"], "x", "y").collect()}
    a = got["a"]  # differences -1, -2, -3: t = -2 / (1 / sqrt 3) with 2 degrees of freedom
    assert a.t == pytest.approx(-(12**0.5)) and a.p == pytest.approx(0.0741799, abs=1e-6) and a.wins == 3
    assert (a.ci_low, a.ci_high) == pytest.approx((-2 - 4.302653 / 3**0.5, -2 + 4.302653 / 3**0.5), abs=1e-5)
    assert set(got) == {"a", "b"} and got["b"].p is None and got["b"].ci_low is None


def test_report_edges(spark):
    codes = spark.createDataFrame([("p", 36), ("p", None), ("q", 36), ("q", 7)], "item string, code int")
    got = sorted((r.item, r.code, r["shift"]) for r in reports.repaired_codes(codes, ["item"], "code").where("code IS NOT NULL").collect())
    assert got == [("p", 1, 35), ("q", 7, None), ("q", 36, None)]
    shares = spark.createDataFrame([("a", "1", 1.0), ("b", "x", 1.0), ("c", "2", 0.0), ("d", None, 1.0)], "item string, cat string, weight double")
    assert {r.item: r.usable for r in reports.items_in_range(shares, ["item"], 7).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert [values(spark, reports.signed_number(F.lit(x).cast("double"))) for x in (None, float("nan"), 1.0, -0.5)] == ["n/a", "n/a", "+1.00", "-0.50"]


def test_request_edges(spark):
    scores = spark.createDataFrame([(k, i, None if (k, i) == (1, 1) else 0.1 * k) for k in range(1, 5) for i in (1, 2)], "k int, item int, raw double")
    targets = spark.createDataFrame([(1, [0.5, 1.0], "high"), (2, [1.0], "high"), (3, None, "low")], "item int, cuts array<double>, tier string")
    generic = spark.createDataFrame([([0.25, 0.5, 0.75, 1.0],)], "cuts array<double>")
    dataset, coverage = generate.request(scores, "k", targets, generic, 4)
    got = {(r.k, r.item): (r.response, r.source) for r in dataset.collect()}
    assert got[1, 1] == (None, None) and [got[k, 1] for k in (2, 3, 4)] == [(1, "calibrated"), (4, "calibrated"), (4, "calibrated")]
    assert [got[k, 2] for k in range(1, 5)] == [(i, "population") for i in range(1, 5)]  # one cut point: constant
    report = {r.item: r for r in coverage.collect()}
    assert report[1].n_missing == 1 and report[2].source == "population" and report[3].n is None


def test_pairs_of_items(spark):
    rows = [(1, r, i, float(r * i if i < 3 else 5)) for r in (1, 2, 3, 4) for i in (1, 2, 3)] + [(1, 9, 1, None), (1, 9, None, 1.0), (2, 1, 1, 1.0)]
    got = {(r.batch, r.a, r.b): (r.n, r.r) for r in studies.pair_correlations(spark.createDataFrame(rows, "batch int, who int, item int, v double"), "batch", "who", "item", "v").collect()}
    assert got == {(1, 1, 2): (4, pytest.approx(1.0)), (1, 1, 3): (4, None), (1, 2, 3): (4, None)}
    assert studies.pair_correlations(spark.createDataFrame([], "batch int, who int, item int, v double"), "batch", "who", "item", "v").count() == 0


def test_coverage_gate_edges(spark):
    rows = [(1, 1, 0.8, False, 0.05), (1, 2, 0.7, True, 0.01), (2, 1, 0.6, True, 0.2), (2, 2, 0.5, True, 0.0), (3, 1, 0.6, True, 0.1), (4, 1, 0.1, True, 0.0), (5, 1, 0.6, False, 0.0)]
    got = {r.query_id: r for r in studies.coverage_gate(spark.createDataFrame(rows, "query_id int, rank int, similarity double, quality boolean, e double"), "e").collect()}
    assert [got[i].method for i in range(1, 6)] == ["single_best", "ensemble", "none", "none", "none"]
    assert [got[i].confident for i in range(1, 6)] == [False, True, False, False, False]
    assert got[2].error == pytest.approx(0.12 / 1.1) and got[2].n_used == 2 and [got[i].confident_single for i in range(1, 6)] == [False, False, True, False, False]


def test_holdout_neighbours(spark):
    curves = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, None)], "id int, curve array<double>")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 9, 0.8), (1, 3, 0.7)], "query_id int, vec_id int, similarity double")
    got = {(r.query_id, r.vec_id): r.error for r in studies.holdout_neighbours(pairs, curves, "id").collect()}
    assert got == {(1, 2): 0.25, (1, 3): None}


def test_embedded_texts(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, " "), (4, "abcd")], "id int, t string")
    got = {r.id: r.embedding for r in providers.embedded(rows, "t", providers.hashed_letters(8), size=1).collect()}
    assert got[2] is None and got[3] is None and all(sum(x * x for x in got[i]) == pytest.approx(1.0) for i in (1, 4))
    assert providers.embedded(rows.limit(0), "t", providers.hashed_letters(8)).count() == 0


def test_items_and_people(spark):
    items = spark.createDataFrame([(1, "one\n\n two "), (2, None), (3, "")], "id int, t string")
    assert sorted((r.id, r.item_no, r["item"]) for r in generation.item_lines(items, "t").collect()) == [(1, 0, "one"), (1, 2, "two")]
    a, b = (spark.createDataFrame(rows, "item_no int, item string") for rows in ([(5, "x"), (1, "y")], [(0, "z")]))
    assert [(r.item_no, r["item"], r.kind) for r in generation.item_table(a, b).orderBy("item_no").collect()] == [(0, "y", "likert"), (1, "x", "likert"), (2, "z", "binary")]
    row = spark.range(1).select(generation.persona({"sex": F.lit(None).cast("string"), "region": F.lit("north")}, F.lit(41.9)).alias("p")).first().p
    assert (row.age, row.sex, row.region) == (41, "unknown", "north")
    people = [r.asDict() for r in generation.dummy_personas(spark, 300, {"sex": ["a", "b"]}, 3).orderBy("person").collect()]
    assert people == [r.asDict() for r in generation.dummy_personas(spark, 300, {"sex": ["a", "b"]}, 3).orderBy("person").collect()]
    assert {p["sex"] for p in people} == {"a", "b"} and all(18 <= p["age"] <= 89 for p in people)


def test_limits_of_a_request(spark):
    generation.check_request(50, 1000, 7)
    generation.check_request(51, 5, 5, confirmed=True)
    for bad in ((51, 100, 7), (10, 9, 7), (10, 100, 6), (0, 100, 7)):
        with pytest.raises(ValueError):
            generation.check_request(*bad)
    with pytest.raises(ValueError, match="nobody"):
        generation.require_rows(spark.range(0), "nobody is left")
    assert generation.require_rows(spark.range(1), "nobody is left").count() == 1


def test_batch_files_and_sinks(spark, tmp_path):
    for name, text in (("resp_p1_b2", "who,x,y\n1,3,4\n2,bad,7\n"), ("cov_p1_b2", "item\nx\n"), ("resp_p1_b3", "who,z\n1,2\n"), ("other_p1_b3", "item\nz\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    (pair,) = files.paired_files(spark, f"file://{tmp_path}").collect()
    assert (pair.partition, pair.batch) == (1, 2)
    got = {(r.respondent, r["item"]): r.value for r in files.read_answers(spark, [(1, 2, pair.answers)]).collect()}
    assert got == {("1", "x"): 3, ("1", "y"): 4, ("2", "x"): None, ("2", "y"): 7} and files.read_answers(spark, []).count() == 0
    table = spark.createDataFrame([("b", 2.00050001), ("a", 0.1235), (None, 1.0)], "k string, v double")
    files.write_map(table, f"file://{tmp_path}/map", "k", "v")
    assert {r.key: r.value for r in files.read_map(spark, f"file://{tmp_path}/map", "double").collect()} == {"a": 0.1235, "b": 2.00050001}
    assert sorted(r.v for r in files.rounded_numbers(table).collect()) == [0.124, 1.0, 2.001]


def test_answers_of_any_kind_are_asked_for_again(spark):
    """Scalars, objects, null and broken answers are repeated, fenced lists are not; lost connections are tried again, other errors raised."""
    prompts = spark.createDataFrame([(k, 2, 1, k) for k in ("scalar", "null", "none", "object", "broken", "fenced", "lost")], "batch string, n_people int, n_items int, prompt string").coalesce(1)

    def make():
        calls = {}

        def provider(batch):
            kind = batch["prompt"]
            calls[kind] = calls.get(kind, 0) + 1
            if kind == "lost" and calls[kind] < 3:
                raise ConnectionError("lost")
            first = {"scalar": "5", "null": "null", "none": None, "object": '{"a": 1, "b": 2}', "broken": "[{"}.get(kind)
            if kind in ("scalar", "null", "none", "object", "broken") and calls[kind] < 3:
                return first
            body = f'[{{"item_1": 0.{calls[kind]}}}, {{"item_1": 0.5}}]'
            return f"```json\n{body}\n```" if kind == "fenced" else body

        return provider

    scored = generation.score_batches(prompts, make())
    got = {r.batch: r.s for r in scored.select("batch", generation.parsed_scores(F.col("answer")).alias("s")).collect()}
    assert {k: v[0]["item_1"] for k, v in got.items()} == {"scalar": 0.3, "null": 0.3, "none": 0.3, "object": 0.3, "broken": 0.3, "fenced": 0.1, "lost": 0.3}

    def refuses(batch):
        raise KeyError("no such model")

    with pytest.raises(Exception, match="no such model"):
        generation.score_batches(prompts, refuses).collect()
