"""Draws, bootstraps, subsamples and noise floors against what chance gives, not only against the same generator in SQL."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import draws
from tallyweave.functions.columns import ratio
from tallyweave.operators import reports, resampling, sampling, validation


def test_neighbours_streams_and_seeds_are_independent(spark):
    rows = spark.range(20_000).select("id", draws.uniform(0, "id").alias("a"), draws.uniform(0, F.col("id") + 1).alias("b"), draws.uniform(1, "id").alias("c"), draws.uniform(0, F.lit("x"), "id").alias("d")).toPandas()
    for c in "abcd":
        assert abs(rows[c].mean() - 0.5) < 0.01 and abs(rows[c].std() - 12**-0.5) < 0.005
        counts = np.bincount((rows[c] * 500).astype(int), minlength=500)
        assert 0.8 < counts.var() / 40 < 1.25  # of binomial counts, not of a lattice
    assert all(abs(rows["a"].corr(rows[c])) < 0.03 for c in "bcd")
    assert rows["a"].iloc[1:].to_list() == rows["b"].iloc[:-1].to_list()


def test_numbers_are_uniform_over_rows_and_streams():
    got = draws.numbers(np.arange(3000), np.arange(200)).astype(float) / 2**53
    assert abs(got.mean() - 0.5) < 0.002 and abs(got.std() - 12**-0.5) < 0.002
    assert abs(np.corrcoef(got[:, 0], got[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(got[0], got[1])[0, 1]) < 0.25
    times = np.searchsorted(np.array(draws.poisson_limits(), np.uint64), draws.numbers(np.arange(3000), np.arange(200)), "right")
    assert abs(times.mean() - 1) < 0.006 and abs(times.var() - 1) < 0.01


@pytest.mark.parametrize("n", [25, 153, 2000])
def test_bootstrap_spread_of_a_mean_is_the_known_one(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    items = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "no_ bigint, x double")
    got = validation.bootstrap_draws(items, 800, seed=7).join(items, "no_").groupBy("repeat").agg(F.avg("x").alias("m"), F.count_distinct("no_").alias("d"), F.count("*").alias("n")).toPandas()
    assert (got["n"] == n).all() and abs(got["d"].mean() / n - (1 - (1 - 1 / n) ** n)) < 0.02
    assert got["m"].std() == pytest.approx(x.std() / math.sqrt(n), rel=0.08)
    # The one-pass form has the same spread.
    rows = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x)], "k bigint, x double").repartition(3)
    sums = resampling.poisson_sums(rows, "k", {"sx": F.col("x"), "n": F.lit(1)}, 800, seed=7).toPandas()
    assert len(sums) == 800 and (sums["sx"] / sums["n"]).std() == pytest.approx(x.std() / math.sqrt(n), rel=0.08 if n > 30 else 0.12)


def test_poisson_interval_is_as_wide_as_theory_and_as_clusters(spark):
    rng = np.random.default_rng(3)
    cluster = rng.integers(0, 60, 3000)
    x = rng.normal(size=60)[cluster] + 0.1 * rng.normal(size=3000)
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000), "c": cluster, "x": x}))
    sums, mean = {"sx": F.col("x"), "n": F.lit(1)}, ratio("sx", "n")
    one = resampling.poisson_interval(rows, "k", sums, mean, 600).first()
    assert one.value == pytest.approx(x.mean()) and one.ci_high - one.ci_low == pytest.approx(3.92 * x.std() / math.sqrt(3000), rel=0.12)
    many = resampling.poisson_interval(rows, "c", sums, mean, 600).first()
    means = pd.Series(x).groupby(cluster).agg(["sum", "count"])
    spread = math.sqrt(((means["sum"] - means["count"] * x.mean()) ** 2).sum()) / 3000
    assert many.ci_high - many.ci_low == pytest.approx(3.92 * spread, rel=0.15)
    none = resampling.poisson_interval(rows.limit(0), "k", sums, mean, 5).first()
    assert none.value is None and none.ci_low is None


def test_noise_floor_equals_the_closed_form(spark):
    shares = {"a": [0.1, 0.2, 0.3, 0.4], "b": [0.05, 0.1, 0.2, 0.3, 0.2, 0.1, 0.05], "one": [1.0], "far": [0.999, 0.001]}
    arrays = spark.createDataFrame([*shares.items(), ("none", [])], "v string, shares array<double>")
    got = {r.v: r for r in resampling.noise_floor(arrays, ["v"], 398, 1500).collect()}
    assert set(got) == set(shares)
    for v in ("a", "b"):
        s = np.array(shares[v])
        p = 1 + 6 * np.arange(len(s)) / (len(s) - 1)
        sd = math.sqrt((s * p * p).sum() - (s * p).sum() ** 2)
        expected = lambda variance: math.sqrt(2 / math.pi) * math.sqrt(2 * variance / 398)
        assert got[v]["mean"] == pytest.approx(expected(sd * sd), rel=0.05)
        for name, inside in (("low", p <= 2), ("high", p >= 6)):
            q = s[inside].sum()
            assert got[v][name] == pytest.approx(expected(q * (1 - q)), rel=0.06)
    assert got["one"]["mean"] == 0 and got["one"]["skewness"] is None and got["one"]["ks"] == 0
    assert 0 < got["far"]["ks"] < 0.01


def test_noise_floor_equals_simulated_surveys(spark):
    """All measures against surveys drawn by numpy's own multinomial."""
    s = np.array([0.2, 0.1, 0.1, 0.25, 0.15, 0.1, 0.1])
    got = resampling.noise_floor(spark.createDataFrame([("x", s.tolist())], "v string, shares array<double>"), ["v"], 150, 2500).first()
    rng, p = np.random.default_rng(0), np.arange(1.0, 8.0)

    def measured(c):
        m = c @ p
        d = p[None, :] - m[:, None]
        sd = np.sqrt((c * d**2).sum(1))
        return {"mean": m, "sd": sd, "skewness": (c * d**3).sum(1) / sd**3, "kurtosis": (c * d**4).sum(1) / sd**4 - 3, "low": c[:, :2].sum(1), "high": c[:, 5:].sum(1)}, np.cumsum(c, axis=1)

    (a, ca), (b, cb) = (measured(rng.multinomial(150, s, 20_000) / 150) for _ in range(2))
    for name in a:
        assert got[name] == pytest.approx(np.abs(a[name] - b[name]).mean(), rel=0.05), name
    assert got["cdf"] == pytest.approx(np.abs(ca - cb).mean(), rel=0.05) and got["ks"] == pytest.approx(np.abs(ca - cb).max(1).mean(), rel=0.05)


def test_binomial_numbers():
    u = np.random.default_rng(4).random(4000)
    for n, p in ((398, 0.3), (398, 0.999), (20, 0.0), (20, 1.0), (0, 0.5), (5000, 0.01)):
        got = resampling.binomial_numbers(np.full(4000, n), np.full(4000, p), u)
        assert 0 <= got.min() and got.max() <= n
        assert abs(got.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 4000) + 1e-9 and got.var() == pytest.approx(n * p * (1 - p), rel=0.12, abs=1e-9)


def test_subsamples_have_their_sizes_and_their_noise(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), draws.uniform(9, "id").alias("x")).repartition(5)
    drawn = resampling.subsample_rows(rows, "k", ["x"], [30, 500, 2990, 5000], 12, seed=2)
    counts = {(r["size"], r["repeat"]): (r.n, r.d) for r in drawn.groupBy("size", "repeat").agg(F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()}
    assert counts == {(s, r): (min(s, 3000),) * 2 for s in (30, 500, 2990, 5000) for r in range(12)}
    noise = {r["size"]: r.mean_noise for r in resampling.subsample_noise(rows, "k", "x", [30, 500], 300).collect()}
    for size, got in noise.items():
        assert got == pytest.approx(math.sqrt(2 / math.pi) * math.sqrt(1 / 12 / size * (1 - size / 3000)), rel=0.15)
    assert resampling.subsample_rows(rows.limit(0), "k", ["x"], [5], 2).count() == 0


def test_subsamples_start_small(spark):
    """What is kept before the sort is as large as the subsamples."""
    rows = spark.range(100_000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"))
    import glob

    from tallyweave.sources.shared import shared_dir

    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/subsamples-*"))
    resampling.subsample_rows(rows, "k", ["x"], [100], 10).count()
    (path,) = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/subsamples-*")) - before
    assert spark.read.parquet(f"file://{path}").count() < 10 * 300


def test_curve_noise_shrinks_with_size(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.floor(draws.uniform(1, "id") * 7).alias("v"))
    got = {r["size"]: r.mean_noise for r in resampling.subsample_curve_noise(rows, "k", "v", [50, 200, 4000, 9000], 200).collect()}
    assert set(got) == {50, 200, 4000} and got[4000] == pytest.approx(0, abs=1e-12)
    values, rng = np.array([r.v for r in rows.collect()]), np.random.default_rng(0)

    def points(x):
        cum = np.cumsum(np.unique(x, return_counts=True)[1]) / len(x)
        return np.interp(np.linspace(0, 1, 20), np.linspace(0, 1, len(cum)), cum)

    for size in (50, 200):
        want = np.mean([np.abs(points(rng.choice(values, size, replace=False)) - points(values)).mean() for _ in range(2000)])
        assert got[size] == pytest.approx(want, rel=0.12)
    assert resampling.subsample_curve_noise(rows, "k", "v", [9000], 2).count() == 0


def test_weighted_draws_vary_as_draws(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(500)], "k int, w double")
    drawn = sampling.draw(sampling.weight_slots(rows, "w", "k"), sampling.uniform_draws(spark, 5000, seed=3))
    counts = np.zeros(500)
    for r in drawn.groupBy("k").count().collect():
        counts[r.k] = r["count"]
    assert counts.sum() == 5000 and 7.5 < counts.var() < 13  # 10 expected; a lattice has under 1
    other = sampling.uniform_draws(spark, 5000, seed=4).agg(F.count_distinct("u")).first()[0]
    shared = sampling.uniform_draws(spark, 5000, seed=3).join(sampling.uniform_draws(spark, 5000, seed=4), "u").count()
    assert other == 5000 and shared == 0  # another seed isn't the same sequence moved on


def test_quota_samples_are_shuffled(spark):
    people = spark.createDataFrame([(i, "ab"[i % 2], 1.0) for i in range(400)], "k int, s string, w double")
    cells = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "s string, share double")
    got = [r.s for r in reports.quota_sample(people, cells, 200, ["s"], "w", "k", seed=1).collect()]
    assert got.count("a") == 100
    changes = sum(x != y for x, y in zip(got, got[1:], strict=False))
    assert 75 < changes < 125
