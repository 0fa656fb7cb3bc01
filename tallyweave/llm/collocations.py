"""Phrases of two and three words that keep together, by hierarchical naming of pairs.

Level 1 names words.  Level 2 names pairs of neighbouring frequent words, and
level 3 pairs of neighbouring frequent pairs that share their middle word, that
is, three words.  A name is a hash of its two parts' names, so each position is
replaced by its pair's name where it stands; counts of names are summed over all
documents and joined with the level below.  The two parts of a name are its
parents: they give both sides of a cut, and the pairs inside three words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.counts import NameFilter, PairSums, name_filter, pair_names
from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import blocks, buffers, byte_kinds, lower_ascii, mix, signed, split_words, word_strings

_U = np.uint64
LEAST_COUNT = 10
#: A phrase goes if this many hundredths of its occurrences lie inside one longer candidate.
INSIDE_PERCENT = 50
MOST_RANK = 2000
SCALE = 1_000_000
#: Parts of a language's phrases that are ranked before they meet.
RANK_PARTS = 64
#: Bytes that end a piece, and those between words of a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BETWEEN = byte_kinds(PIECE_ENDS + b" \t")
#: Text bytes of which a task looks at words together.
BLOCK = 2 << 20


def named_words(texts: pa.Array, lang: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (bytes, word starts, word ends, word names, row of each word, whether the next word is its neighbour)."""
    data, offsets = buffers(texts)
    ends = np.zeros(256, bool)
    ends[list(PIECE_ENDS)] = True
    for low, high in blocks(offsets, BLOCK):
        at = offsets[low : high + 1]
        part = lower_ascii(data[at[0] : at[-1]])
        words = split_words(part, at - at[0], BETWEEN)
        row = words.row
        piece = np.cumsum(ends[part], dtype=np.int64)[words.start] if len(row) else row
        near = np.zeros(len(row), bool)
        near[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        yield part, words.start, words.end, mix(words.hash ^ lang[low:high][row]), row + low, near


def word_counts(docs: DataFrame) -> DataFrame:
    """(lid, id, word, n) of ``docs`` (lid, text): words of each language; the row without a word counts all of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            for data, start, end, name, row, _ in named_words(batch.column(1), lang.view(_U)):
                _, first, n = np.unique(name, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang[row[first]]), pa.array(signed(name[first])), word_strings(data, start[first], end[first]), pa.array(n)], names=["lid", "id", "word", "n"])
                lids, total = np.unique(lang[row], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lids), pa.array(np.zeros(len(lids), np.int64)), pa.nulls(len(lids), pa.string()), pa.array(total)], names=["lid", "id", "word", "n"])

    return docs.mapInArrow(run, "lid bigint, id bigint, word string, n bigint").groupBy("lid", "id", "word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, filters: list, least: int) -> DataFrame:
    """(id, left, right, f) of the pairs of neighbouring names of level ``len(filters)``, each of which passes its level's filter, with ``least`` occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast([f.bits for f in filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [NameFilter(bits) for bits in shared.value]
        sums = PairSums()
        given = lambda got: (pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(n)], names=["left", "right", "n"]) for a, b, n in got)
        for batch in batches:
            for _, _, _, name, _, near in named_words(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).view(_U)):
                known = frequent[0].has(name)
                at = np.flatnonzero(near[:-1] & known[:-1] & known[1:]) if len(name) else np.zeros(0, np.int64)
                left, right = name[at], name[at + 1]
                if len(frequent) == 2:
                    pair = pair_names(left, right)
                    known = frequent[1].has(pair)
                    on = np.flatnonzero((at[1:] == at[:-1] + 1) & known[1:] & known[:-1]) if len(at) else at
                    left, right = pair[on], pair[on + 1]
                yield from given(sums.add(left, right))
        yield from given(sums.rest())

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).to_numpy(zero_copy_only=False).view(_U) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(pair_names(left, right))), *batch.columns], names=["id", "left", "right", "f"])

    counts = docs.mapInArrow(run, "left bigint, right bigint, n bigint").groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return counts.mapInArrow(name, "id bigint, left bigint, right bigint, f bigint")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of 38 digits: exact up to counts of 10^15."""
    big = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(SCALE).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, most: int = MOST_RANK, rank_parts: int = RANK_PARTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language by score.

    Texts are lower-cased from A to Z and split into pieces and words.  A
    candidate is two or three words with ``least`` occurrences within pieces,
    overlaps included; ``l`` and ``r`` are the occurrences of the two parts of
    its lowest-scoring cut (ties: the first cut).  A candidate goes if half of
    its occurrences lie inside one longer candidate.  Ties of the score go by
    ``a``, then by the phrase's bytes.

    Null texts are empty, null languages are ``und``; empty languages and texts
    are taken as they are; repeated rows count each; other columns, also those
    named like results, are ignored; an empty table gives no rows.  Names are
    64-bit hashes, so of m names about m^2 / 2^65 coincide.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(F.xxhash64(lang).alias("lid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    langs = docs.select(F.xxhash64(lang).alias("lid"), lang.alias("lang")).distinct()

    counts = written(word_counts(rows).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    words = counts.where("word IS NOT NULL").select("id", "lid", "word", F.col("n").alias("f"))
    first = name_filter(words, "id")
    pairs = written(pair_counts(rows, [first], least), "pairs")
    second = name_filter(pairs, "id")
    triples = pair_counts(rows, [first, second], least)

    word = lambda side: words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("f").alias(f"{side}_f"))
    placed = pairs.join(words.select(F.col("id").alias("left"), "lid", F.col("word").alias("left_word"), F.col("f").alias("left_f")), "left").join(word("right"), "right")
    placed = written(placed.select("id", "lid", "left_word", "right_word", "left_f", "right_f", "f"), "placed")
    parent = lambda side, *more: placed.select(F.col("id").alias(side), F.col("f").alias(f"{side}_pair"), *more)
    triples = triples.join(parent("left", "lid", "left_word", F.col("right_word").alias("middle"), "left_f"), "left").join(parent("right", "right_word", "right_f"), "right")
    triples = written(triples.select("id", "lid", "left", "right", "left_word", "middle", "right_word", "left_f", "right_f", "left_pair", "right_pair", "f"), "triples")

    c = F.col
    one, two = cut_score(c("f"), c("left_f"), c("right_pair")), cut_score(c("f"), c("left_pair"), c("right_f"))
    early = one <= two
    three = triples.select(
        "lid", F.concat_ws(" ", "left_word", "middle", "right_word").alias("phrase"), c("f").alias("a"),
        F.when(early, c("left_f")).otherwise(c("left_pair")).alias("l"), F.when(early, c("right_pair")).otherwise(c("right_f")).alias("r"), F.least(one, two).alias("score"),
    )
    around = triples.select(F.explode(F.array("left", "right")).alias("id"), c("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    kept = placed.join(around, "id", "left").where(F.coalesce(100 * c("longer") < INSIDE_PERCENT * c("f"), F.lit(True)))
    pair = kept.select("lid", F.concat_ws(" ", "left_word", "right_word").alias("phrase"), c("f").alias("a"), c("left_f").alias("l"), c("right_f").alias("r"), cut_score(c("f"), c("left_f"), c("right_f")).alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = pair.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(rank_parts)))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lid", "part").orderBy(*order))).where(c("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lid").orderBy(*order))).where(c("rank") <= most)
    totals = counts.where("word IS NULL").select("lid", c("n").alias("n"))
    return best.join(totals, "lid").join(langs, "lid").select("lang", c("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
