"""Targets, copies, permutation and shards against plain computations of their own."""

import collections
import math
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import mixing, queries, sharding

WORD = r"[^\x20\x09-\x0D]+"


def plain_targets(sizes: dict, repeats: int = 3) -> dict:
    """Weights 1, 2, 3 in code-point order, null last; targets over ``repeats`` sizes are cut and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = {s for s in open_ if target[s] + share[s] >= repeats * sizes[s]}
        if not over:
            for s in open_:
                target[s] += share[s]
            break
        for s in over:
            left -= repeats * sizes[s] - target[s]
            target[s] = float(repeats * sizes[s])
        open_ -= over
    return target


@pytest.mark.parametrize("table", ["sf0.01", "made"])
def test_mix_against_plain_targets(spark, table):
    if table == "made":
        rnd = random.Random(2)
        rows = [(i if i % 3 else None, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "é", "Z", None])) for i in range(900)]
        rows += [(1, "once more", "few"), (2, None, "none"), (3, "", "none")] + [(None, None, "b")] * 400 + [(5, "x y z " * 9000, "one text")]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    else:
        docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    sizes, documents, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.collect():
        n = len(re.findall(WORD, r.text or ""))
        sizes[r.source] += n
        documents[r.source] += 1
        most[r.source] = max(most[r.source], n)
    target = plain_targets(sizes)
    by_size = {sizes[s]: s for s in sizes}
    assert len(by_size) == len(sizes)
    rows = mixing.mix_sources(docs, block=64).collect()
    taken = collections.Counter()
    for r in rows:
        s = by_size[r.source_size]
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        q = r.target / r.source_size if r.source_size else 0
        assert r.taken in {r.size * math.floor(q + 1e-9), r.size * (math.floor(q - 1e-9) + 1)} and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == docs.count()
    assert all(abs(taken[s] - target[s]) <= max(1, min(2 * most[s], 0.02 * target[s] + 12)) for s in sizes if s != "one text")
    assert collections.Counter(rows) == collections.Counter(mixing.mix_sources(docs.repartition(5), block=64).collect())


def plain_permutation(x: int, n: int, seed: int) -> int:
    """A Feistel walk on the grid, with the public hash of 64-bit numbers chained as Spark does."""

    def hashed(*parts):
        h = 42
        for kind, v in parts:
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    a, b = sharding.grid(n)
    assert a * b >= n > a * b - a
    while True:
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + hashed(("<q", right), ("<i", i), ("<q", seed)) % a) % a
            else:
                right = (right + hashed(("<q", left), ("<i", i), ("<q", seed)) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_permutation_equals_a_plain_one(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permute("id", n, 2024)).collect()]
    assert got == [plain_permutation(x, n, 2024) for x in range(n)]


def test_shards_equal_a_plain_numbering(spark):
    """Shard and slot of every document from its place in the order of id, checksum and size, nulls first."""
    rows = [(i * 7 % 100, f"text {i % 9}", 1) for i in range(100)] + [(None, None, 2), (None, "a", 3), (4, None, 4)] + [(50, "same", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot int").repartition(4)
    got = sharding.feistel_shards(docs).collect()
    place = sorted(got, key=lambda r: tuple((v is not None, v or 0) for v in (r.doc_id, r.text_crc32, r.size)))
    want = collections.Counter()
    for x, r in enumerate(place):
        moved = plain_permutation(x, len(rows), 2024)
        want[(r.doc_id, r.text_crc32, r.size, moved % 8, moved // 8)] += 1
    assert collections.Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in got) == want
    assert sharding.feistel_shards(docs.where(F.col("doc_id") < 0)).collect() == []
