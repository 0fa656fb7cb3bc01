"""Approximate nearest neighbours with multi-index hashing.

Vectors get binary codes: signs of rotations learned on a bounded sample
(iterative quantisation, Gong and Lazebnik, 2011).  A code is split into
substrings, and every substring has an index of its own: lists of vectors by
the substring's value.  If two codes differ in at most r bits, some substring
differs in few; probing all values of every substring within that distance
finds every code within r (Norouzi, Punjani and Fleet, 2012).  What is probed
is ranked by the exact inner product of the vectors.

The lists are dealt to tasks by substring and leading bits of the value, and a
query goes to the tasks that hold values which it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, written

CODE_BITS, SUBSTRING_BITS = 128, 16
#: Vectors on which rotations and radius are fitted, at most.
SAMPLE = 8000
#: Vectors of a task's lists, about.
LIST_ROWS = 65536
_POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation that brings the vectors near to the corners of the cube."""
    start = np.random.Generator(np.random.Philox(seed)).standard_normal((x.shape[1],) * 2)
    rotation = np.linalg.qr(start)[0]
    for _ in range(rounds):
        moved = x @ rotation
        u, _, v = np.linalg.svd(np.where(moved >= 0, 1.0, -1.0).T @ x)
        rotation = (u @ v).T
    return rotation


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size: first by the largest component, so that tiny and huge ones keep their direction."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Substrings [vector, substring] as 16-bit numbers of the signs along the columns; ``x`` has rows of length 1."""
    packed = np.packbits(x @ columns >= 0, axis=1).astype(np.uint16)
    return packed[:, ::2] << np.uint16(8) | packed[:, 1::2]


def radii(radius: int, m: int) -> np.ndarray:
    """How far to probe in each of ``m`` substrings to find every code within ``radius``; below 0 is not at all."""
    return radius // m - (np.arange(m) > radius % m)


def fit_codes(sample: np.ndarray, k: int, wanted: float, population: int, seed: int = 3) -> tuple[np.ndarray, int]:
    """Code columns, and the least radius whose probing finds the share ``wanted`` of the nearest neighbours.

    The sample's neighbours stand for the population's: those as near in rank,
    the k-th of the population being the (k times sample over population)-th.
    """
    x = unit(sample)
    rotations = -(-CODE_BITS // x.shape[1])
    columns = np.concatenate([learn_rotation(x, seed + i) for i in range(rotations)], axis=1)[:, :CODE_BITS]
    code = codes(x, columns)
    m = code.shape[1]
    near = []
    own_k = min(max(1, math.ceil(k * len(sample) / max(population, 1))), len(sample) - 1)
    for i in range(0, len(sample), max(1, len(sample) // 1000)) if own_k else ():
        score = x @ sample[i]
        score *= np.abs(sample).max(1) * np.linalg.norm(sample / np.abs(sample).max(1, keepdims=True), axis=1)
        score[i] = -np.inf
        best = np.argpartition(-score, own_k - 1)[:own_k]
        near.append(_POPCOUNT[code[best] ^ code[i]])
    if not near:
        return columns, 0
    near = np.concatenate(near).astype(int)
    for radius in range(CODE_BITS):
        if (near <= radii(radius, m)).any(1).mean() >= wanted:
            break
    return columns, radius


def ball(distance: int) -> np.ndarray:
    """All 16-bit numbers with at most ``distance`` bits set: what to flip in a value to probe around it."""
    out = [0]
    for n in range(1, min(distance, SUBSTRING_BITS) + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(SUBSTRING_BITS), n)]
    return np.array(out, np.uint16)


class SubstringIndex:
    """Lists of one substring: rows in the order of its value, and where each value's rows begin."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.cuts = np.searchsorted(values[self.order], np.arange((1 << SUBSTRING_BITS) + 1))

    def probe(self, value: np.uint16, flips: np.ndarray) -> np.ndarray:
        """Rows with one of the probed values."""
        probed = (value ^ flips).astype(np.int64)
        low, n = self.cuts[probed], self.cuts[probed + 1] - self.cuts[probed]
        low, n = low[n > 0], n[n > 0]
        return self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, no null or non-finite component, not all zero.

    ``v`` stays an array of floats if the column is one, and has doubles otherwise.
    """
    own = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(f"`{vector_col}`").cast(own if own == "array<float>" else "array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _coded(rows: DataFrame, columns) -> DataFrame:
    """Adds ``code``, the substrings of each vector's code."""
    schema = "vec_id bigint, v " + rows.schema["v"].dataType.simpleString() + ", code array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = codes(unit(_matrix(pa.chunked_array([batch.column(1)]))), columns.value)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(code.astype(np.int32).ravel()), code.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "code"])

    return rows.mapInArrow(run, schema)


class _List:
    """The vectors of one list in a task, and the queries' answers from it."""

    def __init__(self, many: list[pa.RecordBatch], s: int, own: list[int], flips: np.ndarray, k: int):
        table = pa.Table.from_batches(many)
        self.ids, self.x, self.code = table["vec_id"].to_numpy(), _matrix(table["v"]), _matrix(table["code"]).astype(np.uint16)
        self.s, self.flips, self.before, self.k = s, flips, np.array(own[:s]), k
        self.index = SubstringIndex(self.code[:, s])

    def answers(self, few: pa.RecordBatch) -> pa.RecordBatch:
        table, s, k, ids = pa.Table.from_batches([few]), self.s, self.k, self.ids
        q_ids, q, q_code = table["vec_id"].to_numpy(), _matrix(table["v"]), _matrix(table["code"]).astype(np.uint16)
        out: list[list] = [[], [], []]
        for i in range(len(q_ids)):
            rows = self.index.probe(q_code[i, s], self.flips)
            rows = rows[ids[rows] != q_ids[i]]
            if s:  # pairs that an earlier substring finds are ranked there
                rows = rows[(_POPCOUNT[self.code[rows, :s] ^ q_code[i, :s]] > self.before).all(1)]
            score = (self.x[rows] * q[i]).sum(1)
            if len(rows) > k:
                top = np.flatnonzero(score >= np.partition(score, len(rows) - k)[len(rows) - k])
                rows, score = rows[top], score[top]
            best = np.lexsort((ids[rows], -score))[:k]
            out[0] += [int(q_ids[i])] * len(best)
            out[1] += ids[rows[best]].tolist()
            out[2] += score[best].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _search(coded: DataFrame, queries: DataFrame, k: int, radius: int, bits: int, list_rows: int) -> DataFrame:
    """(query_id, vec_id, score): up to k a query, list and batch, of all that probing within ``radius`` finds.

    A list has the vectors whose substring number ``s`` begins with the
    ``bits`` bits of ``part``; one of many more than ``list_rows`` vectors, as
    of a frequent value, is split.  A task holds one list at a time and streams
    the queries past it.  A pair is ranked in one place, the first of the
    substrings that finds it.
    """
    m = CODE_BITS // SUBSTRING_BITS
    own = radii(radius, m).tolist()
    used = [s for s in range(m) if own[s] >= 0]

    def lead(s: int):
        return F.shiftright(F.col("code")[s], SUBSTRING_BITS - bits)

    def probed(s: int):
        near = [p for p in range(1 << bits) if _POPCOUNT[p] <= own[s]]
        return F.transform(F.lit(near), lambda p: F.struct(F.lit(s).alias("s"), lead(s).bitwiseXOR(p).alias("part")))

    lists = coded.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), lead(s).alias("part")) for s in used])).alias("at"), "vec_id", "v", "code").select("at.*", "vec_id", "v", "code")
    # A row for each list that is split: at most m lists for each value of ``bits`` bits.
    large = lists.groupBy("s", "part").count().where(F.col("count") > 2 * list_rows).select("s", "part", F.ceil(F.col("count") / list_rows).cast("int").alias("chunks"))
    large = F.broadcast(large)
    chunks = F.coalesce("chunks", F.lit(1))
    many = lists.join(large, ["s", "part"], "left").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), chunks).cast("int"))
    few = queries.select(F.explode(F.concat(*map(probed, used))).alias("at"), "vec_id", "v", "code").select("at.*", "vec_id", "v", "code")
    few = few.join(large, ["s", "part"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    columns = ["s", "part", "chunk", "asks", "vec_id", "v", "code"]
    both = many.withColumn("asks", F.lit(0)).select(columns).unionByName(few.withColumn("asks", F.lit(1)).select(columns))
    tasks = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(used) << bits)
    dealt = both.repartition(tasks, "s", "part", "chunk").sortWithinPartitions("s", "part", "chunk", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {r: ball(r) for r in set(own) if r >= 0}
        at, members, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
            for low, high in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                *key, asks = keys[low].tolist()
                if key != at:
                    at, members, held = key, [], None
                if not asks:
                    members.append(batch.slice(low, high - low))
                elif members:
                    held = held or _List(members, key[0], own, flips[own[key[0]]], k)
                    yield held.answers(batch.slice(low, high - low))

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, wanted: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, list_rows: int = LIST_ROWS, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, nearest first, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by ``every``; candidates are
    all vectors with another id; score is the inner product in doubles.
    Vectors that are null, zero or hold null or non-finite components, have a
    null id, or another length than most (of equally many, the greatest), take
    no part: they have no inner product with the others.  Repeated rows are
    candidates each and, as queries, one.  A query that finds fewer than k
    searches again within a wider radius, at last all of the code, so every
    query has k rows if there are k candidates.  An empty table gives no rows;
    other columns are ignored.

    ``radius`` is fitted on the sample unless given.  Each vector is sent once
    a substring, each query once to every list that it probes, and each list
    gives few rows a query.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = usable_vectors(vectors, id_col, vector_col)
    lengths = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    size, population = lengths[0] if lengths else (0, 0)
    usable = usable.where(F.size("v") == size)
    # A hash threshold first: tasks send about ``sample`` vectors in all, however many tasks there are.
    pick = F.xxhash64("vec_id", F.lit(9))
    rare = F.pmod(pick, F.lit(1 << 31)) < F.lit(min(1 << 31, math.ceil((1 << 31) * 1.5 * sample / max(population, 1))))
    picked = usable.where(rare).orderBy(pick, "vec_id", "v").limit(sample).toArrow()
    columns, fitted = fit_codes(_matrix(picked["v"]), k, wanted, population) if picked.num_rows else (np.zeros((max(size, 1), CODE_BITS)), 0)
    radius = fitted if radius is None else radius
    coded = written(_coded(usable, spark.sparkContext.broadcast(columns)), "codes")
    queries = written(coded.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]), "queries")
    bits = min(SUBSTRING_BITS, max(0, math.ceil(math.log2(max(population, 1) / list_rows))))
    m = CODE_BITS // SUBSTRING_BITS
    found = written(_search(coded, queries, k, radius, bits, list_rows), "found")
    while radius < m * SUBSTRING_BITS:
        enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = written(queries.join(enough, "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        radius = min(2 * radius + m, m * SUBSTRING_BITS)
        again = _search(coded, short, k, radius, bits, list_rows)
        found = written(found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
