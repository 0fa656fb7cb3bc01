"""How far the sources of a language are apart in their words, by an inverted index with corrections of a baseline.

Each pair of a language's sources starts at the number of kept terms times the
distance of two zero counts.  Postings then add corrections, and only those that
can differ from zero: a term that one source has and another may lack is
corrected against the other's zero count, once for all terms of the same count;
a term that both have is corrected by its posting list, in blocks of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.counts import NameFilter, PairSums, name_filter
from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import blocks, buffers, lower_ascii, mix, signed, split_words, word_strings

_U = np.uint64
LEAST_DOCUMENTS = 10
UNIT = 1_000_000_000
MOST_TERMS = 10
#: Bytes of terms: letters, and all of characters beyond ASCII.
TERM_BYTES = np.zeros(256, np.uint8)
TERM_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
BLOCK = 2 << 20
#: Sources of a language whose pairs are summed in one table of a task.
SOURCE_BLOCK = 256
#: Parts of a language's terms that are summed alone.
TERM_PARTS = 64
#: Pairs that a task expands at once.
EXPANDED = 1 << 20


def named_terms(texts: pa.Array, lang: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (bytes, term starts, term ends, term names, row of each term)."""
    data, offsets = buffers(texts)
    for low, high in blocks(offsets, BLOCK):
        at = offsets[low : high + 1]
        part = lower_ascii(data[at[0] : at[-1]])
        words = split_words(part, at - at[0], TERM_BYTES)
        row = words.row + low
        yield part, words.start, words.end, mix(words.hash ^ lang[row]), row


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(id, lid, term) of ``docs`` (lid, text): terms in ``least`` documents of their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            for data, start, end, name, row in named_terms(batch.column(1), lang.view(_U)):
                _, once = np.unique(mix(name + row.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)
                _, first, n = np.unique(name[once], return_index=True, return_counts=True)
                at = once[first]
                yield pa.RecordBatch.from_arrays([pa.array(signed(name[at])), pa.array(lang[row[at]]), word_strings(data, start[at], end[at]), pa.array(n)], names=["id", "lid", "term", "n"])

    found = docs.mapInArrow(run, "id bigint, lid bigint, term string, n bigint").groupBy("id", "lid", "term").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least).drop("n")


def group_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(gid, id, n) of ``docs`` (lid, text, gid): occurrences of the names that pass the filter of ``kept``, by group."""
    shared = docs.sparkSession.sparkContext.broadcast(name_filter(kept, "id").bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = NameFilter(shared.value), PairSums()
        given = lambda got: (pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(n)], names=["gid", "id", "n"]) for a, b, n in got)
        for batch in batches:
            lang, group = (batch.column(i).to_numpy(zero_copy_only=False).view(_U) for i in (0, 2))
            for _, _, _, name, row in named_terms(batch.column(1), lang):
                at = np.flatnonzero(known.has(name))
                yield from given(sums.add(group[row[at]], name[at]))
        yield from given(sums.rest())

    return docs.mapInArrow(run, "gid bigint, id bigint, n bigint").groupBy("gid", "id").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; null without terms."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are whole numbers up to 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared_terms(postings: DataFrame) -> DataFrame:
    """(lid, i, j, value) of ``postings`` (lid, term id, source number, p, p0): corrections of terms that both sources i < j have.

    Posting lists are dealt by language, two blocks of sources and a part of
    the terms; each task goes through them sorted by term and sums the pairs in
    a table of two blocks' size.
    """
    size = SOURCE_BLOCK
    block = F.floor(F.col("no") / size).cast("int")
    last = postings.groupBy("lid").agg(F.max(block).alias("last"))
    dealt = postings.join(last, "lid").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select(
        "lid", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.pmod("id", F.lit(TERM_PARTS)).cast("int").alias("part"), "id", "no", "p", "p0")
    key = ["lid", "a", "b", "part"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "id", "no")

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def add(table: np.ndarray, rows: pd.DataFrame, a: int, b: int) -> None:
        """Add the pairs of each term's rows; rows are sorted by term and number."""
        ids, no, p, p0 = (rows[c].to_numpy() for c in ("id", "no", "p", "p0"))
        ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids))
        last = np.repeat(ends, np.diff(np.append(0, ends)))
        later = last - np.arange(len(ids)) - 1
        low = 0
        total = np.append(0, np.cumsum(later))
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(total, total[low] + EXPANDED, "right")) - 1)
            n = later[low:high]
            x = np.repeat(np.arange(low, high), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(total[low:high] - total[low], n)
            if a != b:
                on = (no[x] // size == a) & (no[y] // size == b)
                x, y = x[on], y[on]
            value = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
            np.add.at(table, (no[x] - a * size, no[y] - b * size), value)
            low = high

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, table, held = None, None, None

        def given() -> Iterator[pd.DataFrame]:
            if at is not None:
                add(table, held, at[1], at[2])
                i, j = np.nonzero(table)
                if len(i):
                    yield pd.DataFrame({"lid": at[0], "i": i + at[1] * size, "j": j + at[2] * size, "value": table[i, j]})

        for batch in batches:
            for now, rows in batch.groupby(key, sort=False):
                if now != at:
                    yield from given()
                    at, table, held = now, np.zeros((size, size), np.int64), rows
                    continue
                held = pd.concat([held, rows], ignore_index=True)
                whole = np.flatnonzero(held["id"].to_numpy() != held["id"].iloc[-1])
                if len(whole):  # the last term may go on in the next batch
                    add(table, held.iloc[: whole[-1] + 1], at[1], at[2])
                    held = held.iloc[whole[-1] + 1 :]
        yield from given()

    return dealt.mapInPandas(run, "lid bigint, i int, j int, value bigint").groupBy("lid", "i", "j").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from the language's other sources, and by which terms from the language.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased;
    a language keeps those in ``least`` of its documents.  A source's share of
    a term is p = 1 + floor(10^9 (count + 2) / (all counts + 2 terms)); two
    shares are floor((p - q)^2 / (p + q)) apart.  Part ``pair`` has a row for
    each other source, the sum over all kept terms; part ``term`` the
    ``most_terms`` terms that the source has with a larger share than its
    language.  Ranks go by value, ties by the item's bytes.

    Null texts, languages and sources are empty strings, which are a language
    and a source like others; a source without terms, or a language that keeps
    none, has its pairs too (0 without kept terms); repeated rows count each;
    other columns are ignored; an empty table gives no rows.  The rows of part
    ``pair`` are as many as pairs of sources, as the result asks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    lid, gid = F.xxhash64(plain(lang_col)), F.xxhash64(plain(lang_col), plain(source_col))
    rows = docs.select(lid.alias("lid"), F.col(f"`{text_col}`").cast("string").alias("text"), gid.alias("gid"))
    groups = docs.select(lid.alias("lid"), gid.alias("gid"), plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lid").orderBy("source")) - 1)

    c = F.col
    kept = written(kept_terms(rows, least), "terms")
    counts = written(group_counts(rows, kept).join(kept.select("id"), "id"), "postings")
    terms = kept.groupBy("lid").agg(F.count("*").alias("v"))
    groups = groups.join(terms, "lid", "left").join(counts.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").na.fill(0, ["v", "total"])
    groups = written(groups.withColumn("p0", share(F.lit(0), c("total"), c("v"))), "groups")
    whole = groups.groupBy("lid").agg(F.sum("total").alias("lang_total"))
    placed = counts.join(groups.select("gid", "lid", "no", "v", "total", "p0"), "gid").withColumn("p", share(c("n"), c("total"), c("v")))
    placed = written(placed.select("lid", "gid", "id", "no", "n", "v", "p", "p0"), "shares")

    # The pairs: baseline, corrections of what one source has, corrections of what both have.
    side = lambda s: groups.select("lid", *[c(x).alias(f"{s}_{x}") for x in ("gid", "source", "no", "p0")])
    names = groups.select("lid", "lang", "v", *[c(x).alias(f"own_{x}") for x in ("gid", "source", "no", "p0")])
    pairs = names.join(side("other"), "lid").where("own_gid <> other_gid").withColumn("zero", F.coalesce(distance(c("own_p0"), c("other_p0")), F.lit(0)))
    alike = placed.groupBy("lid", "no", "p", "p0").agg(F.count("*").alias("m"))
    one = alike.join(side("other"), "lid").where("no <> other_no")
    one = one.groupBy("lid", c("no").alias("i"), c("other_no").alias("j")).agg(F.sum(c("m") * (distance(c("p"), c("other_p0")) - distance(c("p0"), c("other_p0")))).alias("value"))
    both = shared_terms(placed.select("lid", "id", "no", "p", "p0"))
    corrections = one.unionByName(both)
    corrections = corrections.unionByName(corrections.select("lid", c("j").alias("i"), c("i").alias("j"), "value")).groupBy("lid", "i", "j").agg(F.sum("value").alias("correction"))
    pairs = pairs.withColumnsRenamed({"own_no": "i", "other_no": "j"}).join(corrections, ["lid", "i", "j"], "left")
    pairs = pairs.select("lang", c("own_source").alias("source"), F.lit("pair").alias("part"), c("other_source").alias("item"), (c("v") * c("zero") + F.coalesce("correction", F.lit(0))).alias("value"))

    # The terms that stand out of their language.
    in_lang = counts.groupBy("id").agg(F.sum("n").alias("lang_n"))
    listed = placed.join(kept.select("id", "term").join(in_lang, "id"), "id").join(whole, "lid").withColumn("q", share(c("lang_n"), c("lang_total"), c("v"))).where("p > q")
    listed = listed.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), distance(c("p"), c("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    first = listed.withColumn("rank", F.row_number().over(order)).where(c("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
