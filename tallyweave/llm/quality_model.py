"""Quality of texts by logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader.

A text's features are its words and pairs of neighbouring words, hashed to
2^18 numbers, with square roots of their counts scaled to length one, and a
constant.  Words are runs of letters and digits, or of other signs, in their
own case; a word equal to the one before it is named as such, so that repeats
have a feature whatever the word is.  Training rows are dealt to shards of about
2,048 rows, by their hashes; in each round every shard goes on from the common state (the sums of
gradients and of their squares) and the states are averaged by Spark, so the
result doesn't depend on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import blocks, buffers, mix, split_words

_U = np.uint64
BUCKETS = 1 << 18
#: Labelled documents that are fitted on, at most.
MOST_LABELS = 16_384
#: Rows of a shard, of which there are as many as the sample needs, and rounds over all of them.
SHARD_ROWS, ROUNDS = 2_048, 6
#: Step, its offset and both penalties of follow-the-regularised-leader (proximal).
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
GOOD = 0.7
#: Kinds of bytes: between words, letters and digits, other signs.
KINDS = np.full(256, 2, np.uint8)
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_START, _END, _AGAIN = (_U(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, value) of the rows of a block: row r has the entries first[r] to first[r + 1].

    Bucket 0 is the constant; a row's other values have the length one.
    """
    words, rows = split_words(data, offsets, KINDS), len(offsets) - 1
    row, h = words.row, words.hash.copy()
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    h[same] = _AGAIN
    at = np.arange(len(h)) + 2 * row + 1  # each row's words stand between a start and an end
    padded = np.full(len(h) + 2 * rows, _END)
    padded[words.first[:-1] + 2 * np.arange(rows)] = _START
    padded[at] = h
    owner = np.repeat(np.arange(rows), words.count + 2)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    name = np.concatenate([mix(h), mix(mix(padded[pair]) + padded[pair + 1])])
    owner = np.concatenate([row, owner[pair]])
    bucket = 1 + (name % _U(BUCKETS - 1)).astype(np.int64)
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, bucket = key // BUCKETS, key % BUCKETS
    value = np.sqrt(count)
    value /= np.sqrt(np.bincount(owner, count, rows))[owner]
    first = np.searchsorted(owner, np.arange(rows + 1))
    into = first[:-1]
    return first + np.arange(rows + 1), np.insert(bucket, into, 0), np.insert(value, into, 1.0)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: zero where the sum of gradients is within the first penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
    """One step of follow-the-regularised-leader on one row, in place."""
    w = weights(z[bucket], n[bucket])
    g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
    z[bucket] += g - (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / ALPHA * w
    n[bucket] += g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(h, text, label): a text of each of at most ``most`` labelled documents, those with the smallest hashes of their ids.

    Only (id, label) pairs are ordered, so no text is moved to choose.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id_")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id_"))
    chosen = some.join(ids, "id_", "left_semi").orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id_"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(written(chosen, "labels")), "id_")
    return found.groupBy("id_", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of")).select(F.xxhash64("id_").alias("h"), "of.text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the buckets, fitted on a sample of ``most`` labelled documents at most (whole texts).

    A document labelled more than once has its commoner label (ties: 1); null
    labels and labels of no document don't count; of a repeated id one text is
    taken.  Without labels all weights are 0, so every score is one half.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low, high in blocks(offsets):
                at = offsets[low : high + 1]
                first, bucket, value = features(data[at[0] : at[-1]], at - at[0])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), lists(pa.array(bucket, pa.int32())), lists(pa.array(value, pa.float32()))], names=["h", "label", "bucket", "value"]
                )

    sample = labelled_sample(docs, labels, most, id_col, text_col, label_col)
    rows = written(sample.mapInArrow(extract, "h bigint, label int, bucket array<int>, value array<float>"), "features")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, (z, n), at = state.value, (None, None), None  # noqa: B023

            def given() -> Iterator[pa.RecordBatch]:
                if at is not None:
                    moved = np.flatnonzero((z != common[0]) | (n != common[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(z[moved] - common[0][moved]), pa.array(n[moved] - common[1][moved])], names=["bucket", "z", "n"])

            for batch in batches:
                for i in range(batch.num_rows):
                    if batch.column(0)[i].as_py() != at:
                        yield from given()
                        at, z, n = batch.column(0)[i].as_py(), common[0].copy(), common[1].copy()
                    learn(z, n, batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy().astype(float), batch.column(1)[i].as_py())
            yield from given()

        # A shard's rows stay together and in order whatever the partitions; sums are rounded so that their order doesn't count.
        dealt = rows.select("shard", "label", "bucket", "value", "h").repartition(shards, "shard").sortWithinPartitions("shard", "h").drop("h")
        moved = dealt.mapInArrow(train, "bucket int, z double, n double").groupBy("bucket").agg(*[F.sum(F.col(c).cast("decimal(28,12)")).cast("double").alias(c) for c in ("z", "n")])
        got: pd.DataFrame = moved.toPandas()  # one row a bucket at most
        z[got["bucket"]] += got["z"] / shards
        n[got["bucket"]] += got["n"] / shards
    return weights(z, n)


def with_quality(docs: DataFrame, model: np.ndarray, text_col: str = "text", good: float = GOOD) -> DataFrame:
    """(row, score, predicted): each whole row as a struct, the probability of label 1, and 1 where it is ``good`` or more.

    Whole texts are scored as sparse dot products; a null text is empty, which
    has a score as well.  Rows keep all their columns, inside the struct, so
    names cannot clash; repeated rows stay.  No shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low, high in blocks(offsets):
                at = offsets[low : high + 1]
                first, bucket, value = features(data[at[0] : at[-1]], at - at[0])
                score = 1 / (1 + np.exp(-np.clip(np.add.reduceat(shared.value[bucket] * value, first[:-1]), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score), pa.array((score >= good).astype(np.int32))], names=["row", "score", "predicted"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
