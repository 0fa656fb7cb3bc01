"""Quality classifier, collocations and source divergence, against plain computations and SQL on tables made to provoke them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import data, differences
from pyspark.sql import functions as F

from tallyweave.llm import collocations, counts, divergence, quality_model, queries
from tallyweave.llm.words import buffers

TRAPS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "x" * 5000 + " y", "de", "a"), (5, None, None, None), (6, "no. separators: here, at; all! ever?", "", ""),
    (7, "é É ß İ 漢字 \x1c\x7f @[`{ A_b-c", "fr", "b"), (7, "é É ß İ 漢字 \x1c\x7f @[`{ A_b-c", "fr", "b"), (None, "a a a a a a a a a a a a a a", "en", "a"), (9, "A  b\tB\x0bc\x0cd\re", "en", "c"),
]


def documents(n: int = 260, seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["of", "the", "and", "New", "York", "city", "Über", "naïve", "x1", "漢字", "co-op", "don't"]
    out = list(TRAPS)
    for i in range(n):
        lang = rnd.choice(["en", "en", "en", "de", None, "und"])
        own = words[: 4 + len(lang or "")] + ["only" + str(i % 4)]
        text = "".join(rnd.choice(own) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rnd.randint(0, 60)))
        out.append((100 + i, text + (" in New York city hall" if i % 3 else " new york CITY"), lang, rnd.choice(["a", "b", "c", "d", "e", None, "", "z" + str(i % 9)])))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    import duckdb

    path = str(tmp_path_factory.mktemp("made") / "documents.parquet")
    spark.createDataFrame([(*r, 9, "mine", 0.5, 3) for r in documents()], "doc_id bigint, text string, lang string, source string, rank int, item string, score double, id int").repartition(7).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return spark.read.parquet(path), con


def test_collocations_equal_sql(made):
    docs, con = made
    assert differences(collocations.collocations(docs), con, queries.PHRASE_SQL) == ""


def test_full_filters_and_small_tasks_change_nothing(made, monkeypatch):
    """A filter whose bits are all set, blocks of a few texts and sums of a few pairs give the same rows."""
    docs, con = made
    monkeypatch.setattr(counts, "FILTER_BITS", 64)
    monkeypatch.setattr(counts.name_filter, "__defaults__", (64,))
    monkeypatch.setattr(counts.PairSums.__init__, "__defaults__", (50,))
    monkeypatch.setattr(collocations, "BLOCK", 100)
    monkeypatch.setattr(divergence, "BLOCK", 100)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(divergence, "EXPANDED", 4)
    assert differences(collocations.collocations(docs), con, queries.PHRASE_SQL) == ""
    assert differences(divergence.source_divergence(docs), con, queries.DIVERGENCE_SQL) == ""


def test_divergence_equals_sql(made):
    docs, con = made
    assert differences(divergence.source_divergence(docs), con, queries.DIVERGENCE_SQL) == ""


def test_collocations_against_plain_counts(spark):
    """Cuts, the phrases inside longer ones, ranks and ties without SQL."""
    rows = [r for r in documents(120, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    grams: dict[str, Counter] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _ in rows:
        own = grams.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    want = []
    for lang, f in grams.items():
        n, found = sum(c for g, c in f.items() if len(g) == 1), []
        for g, a in f.items():
            if len(g) == 1 or a < 10 or any(len(h) == 3 and len(g) == 2 and b >= 10 and g in (h[:2], h[1:]) and 100 * b >= 50 * a for h, b in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        want += [(lang, rank, p.decode(), -a, x, y, n, -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:7], 1)]
    got = collocations.collocations(docs, most=7, rank_parts=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**12, 7 * 10**12, 5 * 10**12 + 1)], "a bigint, l bigint, r bigint")
    assert rows.select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * 9 * 10**24 // (7 * 10**12 * (5 * 10**12 + 1))
    got = rows.select(divergence.share(F.lit(10**13), F.lit(3 * 10**13), F.col("a") * 0 + 5)).first()[0]
    assert got == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 10)


def test_edges(edge, empty):
    assert collocations.collocations(empty).count() == divergence.source_divergence(empty).count() == 0
    assert divergence.source_divergence(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {r.lang for r in collocations.collocations(edge).collect()} == {"en"}  # "word word", 3,000 times
    pairs = divergence.source_divergence(edge).collect()
    assert {(r.lang, r.source, r.item) for r in pairs} == {("en", "", "a"), ("en", "", "b"), ("en", "a", ""), ("en", "a", "b"), ("en", "b", ""), ("en", "b", "a"), ("de", "a", "b"), ("de", "b", "a")}
    assert {r.value for r in pairs} == {0}  # no term is in ten documents


# The quality classifier.
def plain_features(text: str) -> dict[tuple, float]:
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text)
    named = ["<again>" if i and t == tokens[i - 1] else t for i, t in enumerate(tokens)]
    grams = Counter([(t,) for t in named] + list(zip(["<s>", *named], [*named, "</s>"], strict=True)))
    norm = math.sqrt(sum(grams.values()))
    return {g: math.sqrt(c) / norm for g, c in grams.items()}


def test_features_equal_plain_ones():
    texts = ["One two, two two.  Two", None, "", "x", "A## ## ##\nb| |c é1", "the the the the"]
    bytes_, offsets = buffers(pa.array(texts, pa.string()))
    first, bucket, value = quality_model.features(bytes_, offsets)
    names: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        got, want = dict(zip(bucket[first[i] : first[i + 1]].tolist(), value[first[i] : first[i + 1]].tolist(), strict=True)), plain_features(text or "")
        assert got.pop(0) == 1.0 and len(got) == len(want)
        assert sorted(got.values()) == pytest.approx(sorted(want.values()))
        for gram, v in want.items():  # a gram has one bucket wherever it stands
            if list(want.values()).count(v) == 1:
                at = next(b for b, x in got.items() if x == pytest.approx(v))
                assert names.setdefault(gram, at) == at
    assert names[("<again>",)] > 0


def test_steps_equal_the_published_formula():
    """Weights from the sums of gradients, one coordinate at a time."""
    rnd = np.random.default_rng(1)
    rows = [(rnd.choice(20, 6, replace=False), rnd.random(6), int(rnd.random() < 0.5)) for _ in range(60)]
    z, n = np.zeros(20), np.zeros(20)
    zs, ns = [0.0] * 20, [0.0] * 20
    a, b, l1, l2 = quality_model.ALPHA, quality_model.BETA, quality_model.L1, quality_model.L2
    for bucket, value, label in rows:
        quality_model.learn(z, n, bucket, value, label)
        w = [0.0 if abs(zs[i]) <= l1 else -(zs[i] - math.copysign(l1, zs[i])) / ((b + math.sqrt(ns[i])) / a + l2) for i in bucket]
        p = 1 / (1 + math.exp(-sum(x * y for x, y in zip(w, value, strict=True))))
        for i, x, wi in zip(bucket, value, w, strict=True):
            g = (p - label) * x
            zs[i] += g - (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / a * wi
            ns[i] += g * g
    assert z == pytest.approx(np.array(zs)) and n == pytest.approx(np.array(ns))


def test_held_out_quality(spark):
    """Documents that were not learned from are told apart, clean ones stay, and a rerun gives the same scores."""
    got = {r.doc_id: r for r in queries.op11_quality_classifier(spark, data("sf0.01")).collect()}
    again = {r.doc_id: r.score for r in queries.op11_quality_classifier(spark, data("sf0.01")).collect()}
    assert {k: r.score for k, r in got.items()} == again
    labels = spark.read.parquet(data("sf0.01") + "/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(r.predicted == q for r, q in held) / len(held) >= 0.95
    assert sum(r.predicted for r, q in held if q == 1) / sum(q for _, q in held) >= 0.98


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (5, 0, "x"), (5, 1, "x"), (5, 0, None), (7, 1, "y"), (99, 0, "z"), (None, 0, "z")], "doc_id bigint, quality int, text string")
    model = quality_model.fit_quality(edge, labels)
    got = quality_model.with_quality(edge, model)
    rows = got.collect()
    assert len(rows) == edge.count() and rows[0].row.asDict().keys() == set(edge.columns)
    assert len({r.score for r in rows if r.row.doc_id in (1, 2, 3)}) == 1  # null, empty and blank texts
    assert {r.label for r in quality_model.labelled_sample(edge, labels, 10, "doc_id", "text", "quality").where(F.length("text") > 1000).collect()} == {0}
    assert quality_model.labelled_sample(edge, labels, 2, "doc_id", "text", "quality").count() == 2
    none = quality_model.fit_quality(empty, labels)
    assert not none.any() and {r.score for r in quality_model.with_quality(edge, none).collect()} == {0.5}
    assert quality_model.with_quality(empty, model).count() == 0
