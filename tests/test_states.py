"""Mergeable moments, wide profiles, quantiles over ranges and the similarity kernel, against plain computations."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import profile, ranks, retrieval, states, studies


def plain(rows):
    w = sum(b for _, b in rows)
    mean = sum(a * b for a, b in rows) / w
    return len(rows), mean, math.sqrt(sum(b * (a - mean) ** 2 for a, b in rows) / w), min(a for a, _ in rows), max(a for a, _ in rows)


def test_moments_keep_what_a_large_mean_hides(spark):
    """A spread of 1 on a mean of 10^9, in one pass, with a hot group and null, dated and decimal keys."""
    rnd = random.Random(5)
    days = [None, dt.date(2020, 1, 1), dt.date(2021, 5, 5)]
    rows = [(rnd.choice(["hot", "hot", "hot", None, "a"]), rnd.choice(days), Decimal("1.50") if i % 2 else None, None if i % 17 == 0 else 1e9 + rnd.gauss(0, 1), rnd.choice([None, 0.0, -1.0, 0.5, 2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, d date, k decimal(9,2), x double, w double").repartition(6)
    for by in (["g"], ["g", "d", "k"], []):
        got = {tuple(r[b] for b in by): (r["n"], r["mean"], r["std"], r["min"], r["max"]) for r in profile.weighted_stats(df, by, "x", "w").collect()}
        want: dict = {}
        for r in rows:
            if r[3] is not None and r[4] is not None and r[4] > 0:
                want.setdefault(tuple(r["gdkxw".index(b)] for b in by), []).append((r[3] - 1e9, r[4]))
        assert got.keys() == want.keys()
        for k, pairs in want.items():
            n, mean, sd, low, high = plain(pairs)
            assert got[k][0] == n and got[k][1] - 1e9 == pytest.approx(mean, abs=1e-6) and got[k][2] == pytest.approx(sd, rel=1e-6)
            assert got[k][3] - 1e9 == pytest.approx(low, abs=1e-6) and got[k][4] - 1e9 == pytest.approx(high, abs=1e-6)
    assert profile.weighted_stats(df.limit(0), ["g"], "x", "w").count() == 0


def test_many_groups_leave_a_task_early(spark, monkeypatch):
    monkeypatch.setattr(states, "HELD", 100)
    df = spark.range(5000).select((F.col("id") % 700).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    got = profile.weighted_stats(df, ["g"], "x", "w").agg(F.count("*"), F.sum("n"), F.sum("mean")).first()
    assert got[0] == 700 and got[1] == 5000 and got[2] == pytest.approx(sum(np.mean(np.arange(g, 5000, 700)) for g in range(700)))


def test_one_row_a_group_and_task_is_shuffled(spark):
    df = spark.range(0, 20_000, 1, 5).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    text = states.moment_states(df, ["g"], "x", "w")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and text.index("FlatMapGroupsInArrow") < text.index("Exchange") < text.index("MapInArrow")


def test_wide_profile(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({f"v{i}": rng.normal(i, 1, 400) for i in range(40)})
    frame.iloc[::7, 3] = None
    frame["v5"] = None
    frame["year"], frame["wt"] = rng.integers(2000, 2004, 400), rng.random(400) - 0.1
    frame["v5"] = frame["v5"].astype(float)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" if c != "year" else "year int" for c in frame.columns)).repartition(4)
    got = {r.variable: r for r in profile.profile_variables(df, ["V3", "v39", "v5", "absent"], "wt", F.col("year")).collect()}
    for name, column in (("V3", "v3"), ("v39", "v39")):
        kept = frame[frame[column].notna() & (frame["wt"] > 0)]
        n, mean, sd, low, high = plain(list(zip(kept[column], kept["wt"], strict=True)))
        r = got[name]
        assert (r.n, r.n_years, r.first_year, r.last_year) == (n, kept["year"].nunique(), kept["year"].min(), kept["year"].max())
        assert (r["mean"], r["std"], r["min"], r["max"]) == pytest.approx((mean, sd, low, high))
    assert got["v5"].error == "no valid rows" and got["absent"].error == "not found" and got["absent"].n == 0
    many = states.wide_states(df, [c for c in frame if c[0] == "v"], "wt", "year")
    assert many.count() <= 40 * 4 and many._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3


def test_wide_shares(spark, monkeypatch):
    monkeypatch.setattr(states, "HELD", 3)
    df = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 1.0), ("x", None, 1.0), (None, 2, 4.0), ("z", 3, 0.0), ("z", 3, None)], "a string, b int, w double")
    got = {(r.variable, r["cat"]): (r.weight, r.share) for r in states.wide_shares(df, ["a", "b"], "w").collect()}
    assert got == {("a", "x"): (3.0, 0.75), ("a", "y"): (1.0, 0.25), ("b", "1"): (3.0, 3 / 7), ("b", "2"): (4.0, 4 / 7)}
    assert states.wide_shares(df.limit(0), ["a"], "w").count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_interpolated_ones(spark, by):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["hot", "hot", "a"], 2000), "x": np.round(rng.normal(size=2000), 1)})
    rows = [(g, None if i % 9 == 0 else float(x)) for i, (g, x) in enumerate(zip(frame["g"], frame["x"], strict=True))] + [(None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p97": 0.975, "p100": 1.0}
    got = {tuple(r[b] for b in by): [r[p] for p in points] for r in ranks.quantiles(df, by, "x", points).collect()}
    want: dict = {}
    for g, x in rows:
        if x is not None:
            want.setdefault((g,) if by else (), []).append(x)
    assert got.keys() == want.keys()
    for k, xs in want.items():
        assert got[k] == pytest.approx(list(np.quantile(xs, list(points.values()))))
    described = {r.g: r for r in studies.described(df, ["g"], "x").collect()}
    assert described["none"].n == 0 and described["none"].p50 is None and described[None].p50 == 4.0
    assert ranks.quantiles(df.limit(0), by, "x", points).count() == 0


def test_running_sums_of_decimals_over_ranges(spark):
    rows = [(i % 5 if i % 7 else None, i, Decimal(i % 11) / 4 if i % 13 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, k int, w decimal(20,3)").repartition(6)
    got = {r.k: (r.before_, r.total_) for r in ranks.running_before(df, ["g"], ["k"], F.col("w")).collect()}
    sums: dict = {}
    want = {}
    for g, k, w in rows:
        want[k] = sums.get(g, Decimal(0))
        sums[g] = want[k] + (w or 0)
    assert got == {k: (want[k], sums[g]) for g, k, _ in rows}
    with pytest.raises(TypeError):
        ranks.running_before(df, ["g"], ["k"], F.col("k") * 1.5)


def test_rows_are_exchanged_once_for_a_rank(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.lit(0.5).alias("x"))
    text = ranks.ordinal_ranks(df, ["g"], ["x", "id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "Window" not in text


def test_similar_equals_all_pairs_to_the_bit(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 24)).astype(np.float32)
    v[40:60] = v[3]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, None, *[0.0] * 22]), (902, [1.0, 2.0]), (903, [3.0, 1.0]), (904, [])]
    index = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    asked = spark.createDataFrame([(i, x) for i, x in rows if i % 10 == 3 or i >= 900], "query_id int, q array<float>")
    got: dict = {}
    for r in retrieval.similar(asked, index, 7, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    fits = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if x and None not in x]
    for q, x in fits:
        if q % 10 == 3 or q >= 900:
            scored = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in fits if i != q and len(y) == len(x))
            assert got.pop(q) == [(i, -s) for s, i in scored[:7]]
    assert not got
    assert retrieval.similar(asked.limit(0), index, 3).count() == retrieval.similar(asked, index.limit(0), 3).count() == 0


def test_group_numbers_tell_null_and_nan_apart():
    table = pa.table({"a": pa.array([1.0, None, float("nan"), 1.0, None]), "b": ["x", None, None, "x", None]})
    got = states.group_numbers(table)
    assert got[0] == got[3] and got[1] == got[4] and len(set(got.tolist())) == 3
