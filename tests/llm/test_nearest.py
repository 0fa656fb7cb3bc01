"""Multi-index hashing: probing finds the whole radius, answers are those of brute force where they have to be."""

import collections

import numpy as np
import pytest

from tallyweave.llm import ann, queries


def test_probing_finds_every_code_within_the_radius():
    code = np.random.default_rng(0).integers(0, 1 << 16, (3000, 8)).astype(np.uint16)
    code[1:200] = code[0] ^ (np.uint16(1) << np.random.default_rng(1).integers(0, 16, (199, 8)).astype(np.uint16)) * (np.random.default_rng(2).random((199, 8)) < 0.6)
    away = ann._POPCOUNT[code ^ code[0]]
    for radius in (0, 3, 7, 8, 12, 20):
        own = ann.radii(radius, 8)
        found = set()
        for s in range(8):
            if own[s] >= 0:
                rows = ann.SubstringIndex(code[:, s]).probe(code[0, s], ann.ball(own[s]))
                assert sorted(rows) == np.flatnonzero(away[:, s] <= own[s]).tolist()
                found.update(rows.tolist())
        assert set(np.flatnonzero(away.sum(1) <= radius).tolist()) <= found


def answers(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def brute_force(rows, every=20, k=20):
    out = {}
    for q, v in dict(sorted(rows)[::-1]).items():
        if q % every == 0:
            out[q] = sorted(((i, float((np.array(x, float) * np.array(v, float)).sum())) for i, x in rows if i != q), key=lambda r: (-r[1], r[0]))[:k]
    return out


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    vectors = queries.table(spark, f"/root/testdata/{table}", "embeddings")
    odd = spark.createDataFrame([(100000, None, 1), (100020, [0.0] * 64, 1), (100040, [float("nan")] * 64, 1), (None, [1.0] * 64, 1), (100060, [None] + [1.0] * 63, 1), (100080, [1.0] * 3, 1)], vectors.schema)
    got = answers(ann.nearest(vectors.union(odd), list_rows=300).collect())
    p = vectors.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    hits = 0
    for i in asked:
        score = x @ x[i]
        best = {int(ids[j]) for j in [j for j in np.lexsort((ids, -score)) if j != i][:20]}
        own = got[int(ids[i])]
        hits += len(best & {v for v, _ in own})
        assert len(own) == 20 and own == sorted(own, key=lambda r: (-r[1], r[0]))
        assert all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in own)
    assert set(got) == {int(ids[i]) for i in asked} and hits >= 0.9 * 20 * len(asked)


def test_small_tables_ties_and_repeats_equal_brute_force(spark):
    """All candidates if fewer than k; ties to the smaller id; repeated rows; tiny and huge vectors; none."""
    random = np.random.default_rng(4)
    rows = [(i, random.standard_normal(5).round(1).tolist()) for i in range(1, 50)]
    rows += [(40, rows[10][1]), (41, rows[10][1]), (60, [1e-170] * 5), (61, [1e-300, 0.0, 0.0, 0.0, -1e-300]), (80, [1e150] * 5), (20, rows[19][1]), (20, rows[19][1])]
    make = lambda r: spark.createDataFrame(r, "vec_id bigint, embedding array<double>")
    wide = dict(radius=128)
    for some in (rows[:1], rows[:25], rows):
        got = answers(ann.nearest(make(some), **wide).collect())
        want = brute_force(some)
        assert set(got) == set(want)
        for q in want:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    fitted = answers(ann.nearest(make(rows), radius=0, list_rows=4).collect())
    assert {q: len(a) for q, a in fitted.items()} == {q: 20 for q in brute_force(rows)}
    assert len(answers(ann.nearest(make(rows)).collect())[60]) == 20
    hot = [(i, rows[3][1]) for i in range(200, 330)] + rows
    got, want = answers(ann.nearest(make(hot), list_rows=16, radius=128).collect()), brute_force(hot)
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in want if q >= 200)
    assert ann.nearest(make(rows).limit(0)).collect() == []
