"""Weighted sampling and near-duplicate classes against plain computations with the operator's own weights."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from tallyweave.llm import near_dedup
from tallyweave.llm.near_dedup import Idf, multipliers, signatures


@pytest.mark.parametrize("n", [5, 200, 2000, 20000])
def test_agreement_is_the_weighted_jaccard_similarity(n):
    """Draws agree as often as the weighted sets are alike, for any number of shingles and unequal weights."""
    random_ = np.random.default_rng(n)
    functions = multipliers(1500)
    h = np.sort(random_.integers(0, 1 << 63, int(n * 1.2), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    x = np.where(random_.random(len(h)) < 0.4, 12.0, 3.0)
    y = x * np.where(random_.random(len(h)) < 0.1, 1.7, 1.0)
    a, b = random_.random(len(h)) > 0.08, random_.random(len(h)) > 0.08
    want = np.minimum(x * a, y * b).sum() / np.maximum(x * a, y * b).sum()
    draws = [signatures(np.zeros(m.sum(), np.int64), h[m], w[m], 1, functions) for m, w in ((a, x), (b, y))]
    assert abs((draws[0] == draws[1]).mean() - want) < 0.03


def test_least_draw_of_all_shingles():
    """The bounded look finds the least draw of all shingles, in every text and function."""
    random_ = np.random.default_rng(1)
    row = np.sort(random_.integers(0, 60, 3000))
    row = row[(row != 7)]
    h = random_.integers(0, 1 << 63, len(row), dtype=np.uint64)
    order = np.lexsort((h, row))
    row, h, weight = row[order], h[order], random_.random(len(row)) * 9 + 0.2
    functions = multipliers(40)
    got = signatures(row, h, weight, 60, functions)
    assert not got[7].any()
    for k, r in itertools.product(range(40), set(row.tolist())):
        own = np.flatnonzero(row == r)
        ln_a, t = near_dedup.draw(near_dedup._hashed(h[own], functions[k]), np.log(weight[own]))
        i = ln_a.argmin()
        assert got[r, k] == near_dedup.mix(h[own[i : i + 1]] + near_dedup.mix(t[i : i + 1].astype(np.int64).view(np.uint64)))[0]


def _shingles(text):
    w = text.lower().split()
    return collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_frequencies_and_classes_equal_brute_force(spark):
    """Frequencies are those of plain counting; classes are those of all pairs under the operator's own TF-IDF weights."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common = [text(40) for _ in range(3)]
    texts = []
    for i in range(300):
        own = text(rnd.randint(20, 120)) + " " + (common[i % 3] if i % 2 else "")
        texts.append(own)
        for change in (1, 2, 4, 8):
            if rnd.random() < 0.25:
                w = own.split()
                for _ in range(change):
                    w[rnd.randrange(len(w))] = rnd.choice(words)
                texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    sets = [_shingles(t) for t in texts]
    df = collections.Counter(s for c in sets for s in c)
    n = len(texts)
    rare = max(n // near_dedup.RARE, 1)
    idf = {s: math.log((n + 1) / (max(k, rare) + 1)) + 1 for s, k in df.items()}
    fitted = near_dedup.inverse_frequencies(docs, n)
    assert len(fitted.shingle) == sum(k > rare for k in df.values()) > 100
    assert sorted(np.round(fitted.weight, 9)) == sorted(np.round([idf[s] for s, k in df.items() if k > rare], 9))
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in itertools.combinations(range(n), 2):
        x, y = sets[a], sets[b]
        least = sum(min(x[g], y[g]) * idf[g] for g in x if g in y)
        whole = sum(x[g] * idf[g] for g in x) + sum(y[g] * idf[g] for g in y) - least
        if least >= 0.8 * whole:
            links += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    want = {i: root(i) for i in range(n)}
    assert links > 40 and all(want[got[i]] == want[i] for i in got)  # no false link
    assert sum(got[i] == want[i] for i in got) >= 0.995 * n


def test_idf_without_frequent_shingles():
    assert Idf(np.zeros(0, np.uint64), np.zeros(0), 3.0).of(np.array([1, 2], np.uint64)).tolist() == [3.0, 3.0]


def test_close_pairs_of_a_large_bucket_meet_once_in_blocks(spark):
    """A bucket larger than a block is dealt by pairs of blocks; its pairs are those of plain comparisons, each once."""
    rnd = np.random.default_rng(5)
    least, rows = 0.8, []
    base = rnd.random((6, near_dedup.CELLS)).astype(np.float32)
    for tid in range(1, 241):
        rest = base[tid % 6] * (rnd.random(near_dedup.CELLS) > rnd.random() * 0.3).astype(np.float32)
        keys = [1000 + (tid % 6 > 3), 2000 + tid % 2, 3000 + tid]
        most = float(rest.sum(dtype=float))
        mass = float(most * rnd.uniform(1, 1.1))
        rows += [(k, tid, tid // 3, mass, most, keys, rest.tolist()) for k in keys]
    members = spark.createDataFrame(rows, "key bigint, tid bigint, component bigint, mass double, most double, keys array<bigint>, rest array<float>")
    dealt = near_dedup._dealt(members, 32).cache()
    assert max(r["count"] for r in dealt.groupBy("key", "i", "j").count().collect()) < 100
    got = [(r.a, r.b) for r in near_dedup._close_pairs(dealt, least).collect()]
    texts = {r[1]: r[2:] for r in rows}
    want = set()
    for b, a in itertools.combinations(sorted(texts), 2):
        (ca, ma, ta, ka, ra), (cb, mb, tb, kb, rb) = texts[a], texts[b]
        common = min(ta, tb, sum(map(min, ra, rb)))
        if ca != cb and set(ka) & set(kb) and common >= (least - 1e-6) * (ma + mb - common):
            want.add((a, b))
    assert len(want) > 100
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("late", [False, True])
def test_batches_without_a_new_text(spark, late):
    """Batches that hold only copies of earlier texts, or only texts without a word, have the columns of all others."""
    name, own = "spark.sql.execution.arrow.maxRecordsPerBatch", ["some words of one text", "another text of other words"]
    none = [own[0], own[0], " ", "", own[1], own[0]]
    texts = own + none if late else none[2:4] + own + none
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
        kept = {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {i: texts.index(t) if t.strip() else i for i, t in enumerate(texts)}
    assert kept == {i for i, first in got.items() if i == first}
