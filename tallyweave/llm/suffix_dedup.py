"""Repeated passages with a sparse suffix array.

A suffix is retained where its first ``ANCHOR_WORDS`` words have the least hash
among ``PASSAGE_WORDS - ANCHOR_WORDS + 1`` consecutive such runs: a choice that
depends on the content alone, so every passage of ``PASSAGE_WORDS`` words
retains the same suffix wherever it stands.  The retained suffixes are sorted
by their beginnings and compared with their neighbours.  A suffix that agrees
with a neighbour is extended left and right: each passage of ``PASSAGE_WORDS``
words around it that it was retained for is sorted and compared in the same
way.  The union of the passages found more than once gives the spans.

Sorting and comparing use fingerprints of the words in place of the words: 64
bits for a beginning, which only selects what is extended, and 128 bits for a
passage, which decides.  Neighbours with equal beginnings are the same in the
order of fingerprints as in that of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.near_dedup import NO_ID, text_ids
from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import Words, blocks, buffers, signed, split_words, window_hashes, windows_inside

PASSAGE_WORDS = 50
ANCHOR_WORDS = 34
#: Base of a passage's second fingerprint.
SECOND_BASE = 0xD6E8FEB86659FD93
_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)


def passages(words: Words, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages inside rows, and the start of the suffix that each retains (the first of least hash)."""
    inside = windows_inside(words, size)
    h = window_hashes(words.hash, anchor)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, span = len(inside), size - anchor + 1
    best, at = h[:n].copy(), np.arange(n)
    for k in range(1, span):
        other = h[k : k + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    starts = np.flatnonzero(inside)
    return starts, at[starts]


def _text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(batch.column(column).cast(pa.large_string()))
    for low, high in blocks(offsets):
        at = offsets[low : high + 1]
        yield low, high, split_words(data[at[0] : at[-1]], at - at[0])


def _first_seen(tids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose text this task has not had yet; a bounded memory, so that copies in one task cost nothing."""
    out = np.zeros(len(tids), bool)
    for i, t in enumerate(tids.tolist()):
        if t not in seen:
            seen.add(t)
            out[i] = True
    if len(seen) > 200_000:
        seen.clear()
    return out


#: What a task knows of a row: alone with its key so far, the least of several, or one of several but not the least.
ALONE, LEAST, LATER = 0, 1, 2


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it, from the second row on."""
    out = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        out |= c[1:] != c[:-1]
    return out


def _combined(parts: list[list[np.ndarray]], keys: int) -> list[np.ndarray]:
    """Rows (key columns, order columns) of one batch, equal ones once, and each row's state among those of its key."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.append(True, _changes(columns))[: len(order)]
    columns = [c[new] for c in columns]
    n, change = len(columns[0]), _changes(columns[:keys])
    begins, ends = np.append(True, change)[:n], np.append(change, True)[:n]
    return [*columns, np.where(begins, np.where(ends, ALONE, LEAST), LATER).astype(np.int8)]


def retained_suffixes(texts: DataFrame, size: int, anchor: int) -> DataFrame:
    """(key, tid, place, state): hash of the first words, text and word number of every retained suffix; state as ``_combined`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids = batch.column(0).to_numpy()
            fresh = _first_seen(tids, seen)
            parts = []
            for low, high, words in _text_blocks(batch, 1):
                at = np.unique(passages(words, size, anchor)[1])
                row = words.row[at] if len(at) else at
                keep = fresh[low:high][row]
                at, row = at[keep], row[keep]
                h = window_hashes(words.hash, anchor)[at] if len(at) else np.zeros(0, np.uint64)
                parts.append([signed(h), tids[low:high][row], (at - words.first[row]).astype(np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _combined(parts, 1)], names=["key", "tid", "place", "state"])

    return texts.select("tid", "text").mapInArrow(run, "key bigint, tid bigint, place int, state byte")


def sorted_neighbours(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Rows sorted by ``keys`` and ``order`` that have the keys of a different neighbour; ``first`` is true for the first of each key.

    ``order`` has to identify rows: equal ones (copies made by different tasks)
    count once; a row that is known to come later than another of its key may
    come out twice.  Such rows need no comparison and are dealt by ``order``,
    so that of a common key only the least row of each batch goes to the
    key's task.  The rows there are streamed in sorted order, one batch and
    one row at a time.
    """
    columns = [*keys, *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.when(F.col("state") < LATER, F.col("key")).otherwise(F.xxhash64(*order))
    dealt = rows.select(*columns, "state", deal.alias("deal")).repartition(n, "deal").sortWithinPartitions(*columns, "state").drop("deal")
    schema = T.StructType([dealt.schema[c] for c in columns] + [T.StructField("first", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table, first: np.ndarray) -> list[pa.RecordBatch]:
            return table.select(columns).append_column("first", pa.array(first, pa.bool_())).to_batches()

        held: pa.Table | None = None  # the last row so far
        before: tuple | None = None  # the keys of the row before it
        for batch in batches:
            table = pa.Table.from_batches([batch])
            later = pc.equal(table["state"], LATER)
            known, table = table.filter(later), table.filter(pc.invert(later))
            yield from out(known, np.zeros(known.num_rows, bool))
            if not table.num_rows:
                continue
            table = pa.concat_tables([held, table]) if held is not None else table
            arrays = [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in columns]
            index = np.flatnonzero(np.append(_changes(arrays), True))  # of equal rows the last stays: LEAST, if one of them is
            key = [a[index] for a in arrays[: len(keys)]]
            change = _changes(key)
            begins = np.append(before is None or before != tuple(int(k[0]) for k in key), change)
            ends = np.append(change, True)
            several = table["state"].combine_chunks().to_numpy(zero_copy_only=False)[index] == LEAST
            done = index[:-1]  # the last row waits for its successor
            repeated = (~(begins & ends) | several)[:-1]
            if len(done):
                yield from out(table.take(pa.array(done[repeated])), begins[:-1][repeated])
                before = tuple(int(k[-2]) for k in key)
            held = table.slice(index[-1], 1)
        if held is not None:
            begins = before is None or before != tuple(held[k][0].as_py() for k in keys)
            if not begins or held["state"][0].as_py() == LEAST:
                yield from out(held, np.array([begins]))

    return dealt.mapInArrow(run, schema)


def repeated_passages(texts: DataFrame, anchors: DataFrame, size: int, anchor: int) -> DataFrame:
    """(key, second, head, tid, place, state): every passage around a repeated suffix that the suffix is retained for.

    ``texts`` has carrier, the doc_id of its row (``NO_ID`` for null): of the
    copies of a text one moves.  ``anchors`` has tid, head (least doc_id of the text) and places, the
    repeated suffixes of one text, at most as many as it has words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids, heads = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = batch.column(2)
            fresh = _first_seen(tids, seen)
            parts = []
            for low, high, words in _text_blocks(batch, 3):
                starts, at = passages(words, size, anchor)
                wanted = np.zeros(len(words.start), bool)
                for i in np.flatnonzero(fresh[low:high]):
                    wanted[words.first[i] + np.asarray(places[int(low + i)].values)] = True
                starts = starts[wanted[at]] if len(at) else starts
                row = words.row[starts] if len(starts) else starts
                h, second = (window_hashes(words.hash, size, *b)[starts] if len(starts) else np.zeros(0, np.uint64) for b in ((), (SECOND_BASE,)))
                parts.append([signed(h), signed(second), heads[low:high][row], tids[low:high][row], (starts - words.first[row]).astype(np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _combined(parts, 2)], names=["key", "second", "head", "tid", "place", "state"])

    joined = texts.withColumnRenamed("carrier", "head").join(anchors.hint("shuffle_hash"), ["tid", "head"]).select("tid", "head", "places", "text")
    return joined.mapInArrow(run, "key bigint, second bigint, head bigint, tid bigint, place int, state byte")


def united(marks: DataFrame, size: int) -> DataFrame:
    """(tid, role, start_word, end_word): unions of overlapping or touching passages of one text and role."""
    by = Window.partitionBy("tid", "role").orderBy("place")
    marks = marks.withColumn("new", F.when(F.col("place") <= F.lag("place").over(by) + size, 0).otherwise(1)).withColumn("span", F.sum("new").over(by))
    return marks.groupBy("tid", "role", "span").agg(F.min("place").alias("start_word"), (F.max("place") + size).alias("end_word")).drop("span")


def text_spans(rows: DataFrame, heads: DataFrame, size: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(tid, role, start_word, end_word) of every text: repeats of passages that stand earlier, and the earliest places themselves."""
    bounded_batches(rows.sparkSession)
    texts = rows.where("tid IS NOT NULL").select("tid", F.coalesce("doc_id", F.lit(NO_ID)).alias("carrier"), "text")
    repeated = sorted_neighbours(retained_suffixes(texts, size, anchor), ["tid", "place"])
    anchors = repeated.groupBy("tid").agg(F.collect_set("place").alias("places")).join(heads.select("tid", "head"), "tid").select("tid", "head", "places")
    marks = sorted_neighbours(repeated_passages(texts, written(anchors, "suffixes"), size, anchor), ["head", "tid", "place"], ("key", "second"))
    return united(marks.select("tid", F.when(F.col("first"), "first").otherwise("repeat").alias("role"), "place"), size)


def _heads(rows: DataFrame) -> DataFrame:
    """(tid, head, copies): least doc_id of each text (the largest number if all are null) and its rows."""
    return written(rows.where("tid IS NOT NULL").groupBy("tid").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("head"), F.count("*").alias("copies")), "heads")


#: The rows of a text meet what is known of it in so many tasks.
SALTS = 16


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*by: str) -> Column:
    """Spreads rows, also those that repeat ``by``, if they come from several partitions."""
    return F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.lit(SALTS)).cast("int")


def _known(heads: DataFrame, spans: DataFrame) -> DataFrame:
    """(tid, head, copies, spans, salt) of the texts that have several rows or spans; others need nothing joined."""
    return _salted(written(heads.where("copies > 1").join(spans, "tid", "full").select("tid", "head", "copies", "spans"), "cuts"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, role, start_word, end_word, n_words): a row per repeated span of at least ``size`` words of each document.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; end_word is exclusive.
    A span's role is ``first`` where its passages stand for the first time (by
    least doc_id of the text, then text fingerprint and place) and ``repeat``
    elsewhere; unions are made per role, so a document can have spans of both.
    Of documents with equal texts of at least ``size`` words the one of least
    doc_id has one whole span ``first``, the others one whole span ``repeat``
    and no further rows; repeated rows of that least doc_id are all ``first``.
    Null and shorter texts and an empty table give no rows; null ids rank
    last; other columns are ignored.
    """
    rows = text_ids(docs, id_col, text_col)
    heads = _heads(rows)
    spans = text_spans(rows, heads, size, anchor)
    counted = rows.select("doc_id", "tid", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), _salt("doc_id").alias("salt"))
    found = spans.groupBy("tid").agg(F.collect_list(F.struct("role", "start_word", "end_word")).alias("spans"))
    placed = counted.join(_known(heads, found).hint("merge"), ["tid", "salt"])
    whole = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.lit(0).alias("start_word"), F.col("words").cast("int").alias("end_word")))
    empty = F.array().cast("array<struct<role:string,start_word:int,end_word:int>>")
    own = F.coalesce("spans", empty)
    long_copies = F.col("copies").isNotNull() & (F.col("words") >= size)
    is_head = F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("head")
    spans = F.when(long_copies & ~is_head, whole("repeat")).when(long_copies, F.concat(whole("first"), F.filter(own, lambda s: s["role"] == "repeat"))).otherwise(own)
    out = placed.select("doc_id", F.explode(spans).alias("s"))
    return out.select("doc_id", "s.role", "s.start_word", "s.end_word", (F.col("s.end_word") - F.col("s.start_word")).alias("n_words"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", size: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """The documents without the words of their ``repeat`` spans; those left without a word go.

    A removed span takes the white space behind it along.  Documents without
    such spans stay as they are, null texts and wordless ones included.
    ``chars_col``, if it is a column, gets the new length.  Of equal texts of
    at least ``size`` words one row stays (least doc_id, null ids last, then by
    the hash of the row).
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = text_ids(docs, id_col, text_col)
    heads = _heads(rows)
    spans = text_spans(rows, heads, size, anchor).where("role = 'repeat'").groupBy("tid").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("tid"))
    whole = whole.withColumn("salt", _salt("row"))
    joined = whole.join(_known(heads, spans).hint("merge"), ["tid", "salt"], "left")
    words = F.regexp_count(F.col("row")[text_col].cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    if not heads.where("copies > 1").isEmpty():
        copies = F.coalesce((F.col("copies") > 1) & (words >= size), F.lit(False))
        own_id = F.col("row")[id_col].cast("bigint")
        # Each task sends one row of a text, however many copies it has.
        least = F.min_by(F.struct("row", "spans"), F.struct(own_id.isNull(), own_id, F.xxhash64("row")))
        joined = joined.where(~copies).select("row", "spans").unionByName(joined.where(copies).groupBy("tid").agg(least.alias("kept")).select("kept.*"))
    joined = joined.select("row", "spans", F.col("row")[text_col].cast("string").alias("text"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for spans, own in zip(batch.column(1), batch.column(2), strict=True):
                if not spans.is_valid:
                    keep.append(True)
                    texts.append(own.as_py())
                    continue
                raw = own.as_py().encode()
                words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                gone = np.zeros(len(words.start) + 1, np.int32)
                for s in spans.as_py():
                    gone[s["start_word"]] += 1
                    gone[s["end_word"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                stop = np.append(words.start[1:], len(raw))
                mask = np.ones(len(raw), bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    mask[words.start[a] : stop[b - 1]] = False
                keep.append(not gone.all())
                texts.append(np.frombuffer(raw, np.uint8)[mask].tobytes().decode())
            row = batch.column(0)
            fields = row.flatten()
            fields[at] = pa.array(texts, pa.string()).cast(row.type.field(at).type)
            changed = pa.StructArray.from_arrays(fields, fields=list(row.type))
            out = pa.RecordBatch.from_arrays([changed], names=["row"])
            yield out.filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(run, T.StructType([joined.schema["row"]])).select("row.*")
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changed = F.length(text).cast(kind)
        out = out.withColumn(chars_col, F.when(text.isNotNull(), changed).otherwise(F.col(f"`{chars_col}`")))
    return out
