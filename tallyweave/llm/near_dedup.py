"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: five-word shingles, weighing term frequency times
inverse document frequency.  Each of ``BANDS * BAND_ROWS`` hash functions draws
one shingle by improved consistent weighted sampling (Ioffe, 2010), so that two
texts agree on a draw with a probability equal to their weighted Jaccard
similarity.  Equal bands make candidates, and every link is verified by the
weighted Jaccard similarity of the whole texts.

Document frequencies are exact for the shingles that at least one text in
``RARE`` has; there are at most ``RARE`` times as many of them as a text has
shingles, whatever the corpus.  They are found in two passes over all
documents: counts of hashed features leave candidates, whose own counts decide.
All rarer shingles have the weight of one at that threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, connected_components, give_back, written
from tallyweave.llm.words import blocks, buffers, mix, signed, split_words

_U = np.uint64
#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1
SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 14, 4
#: Bits of the hashed features that leave candidates for frequent shingles.
FEATURE_BITS = 18
#: A shingle that fewer than one in so many texts have weighs like one that one in so many have.
RARE = 256
_FEATURE_CHUNK = 2048
#: Cells in which the weight that two texts can have in common is bounded.
CELLS = 64
#: Members of a large bucket are compared in blocks of about so many.
MEMBERS = 512
#: Pairs that are looked at together.
_PAIRS = 1 << 18
#: Draws are looked for below ``FIRST_LOOK`` over the weight of the text; without one, among all shingles.
FIRST_LOOK = 4.0
_SHINGLES = 1 << 13


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash, term frequency), by row and hash.

    A text of one to four words is one shingle; one without a word has none.
    """
    words = split_words(data, offsets)
    n, row = len(words.start), words.row
    short = words.count < SHINGLE_WORDS
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        h[: n - k] += words.hash[k:] * _U(0x9E3779B97F4A7C15 + 2 * (k + 1) * 0x1234567)
        if k:  # words beyond the row don't count
            over = np.flatnonzero(row[: n - k] != row[k:])
            h[over] -= words.hash[over + k] * _U(0x9E3779B97F4A7C15 + 2 * (k + 1) * 0x1234567)
    left = words.first[1:][row] - np.arange(n)
    keep = (left >= SHINGLE_WORDS) | (short[row] & (np.arange(n) == words.first[:-1][row]))
    h, row = mix(h[keep]), row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def feature(h: np.ndarray) -> np.ndarray:
    """The hashed feature on which a shingle is counted first."""
    return ((h >> _U(32)) & _U((1 << FEATURE_BITS) - 1)).astype(np.int64)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in blocks(offsets):
        at = offsets[low : high + 1]
        yield low, high, data[at[0] : at[-1]], at - at[0]


def frequent_features(docs: DataFrame, least: int) -> np.ndarray:
    """Which features occur in at least ``least`` texts' shingles: only these go to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                _, h, _ = shingles(data, offsets)
                total += np.bincount(feature(h), minlength=len(total))
        parts = total.reshape(-1, _FEATURE_CHUNK)
        used = np.flatnonzero(parts.any(1))
        for p in used:
            at = np.flatnonzero(parts[p])
            yield pa.RecordBatch.from_arrays([pa.array(p * _FEATURE_CHUNK + at, pa.int64()), pa.array(parts[p][at])], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = np.zeros(1 << FEATURE_BITS, bool)
    out[rows.select("feature").toArrow()["feature"].to_numpy()] = True
    return out


class Idf:
    """Inverse document frequencies: those of frequent shingles (ascending), and one for all others."""

    def __init__(self, shingle: np.ndarray, weight: np.ndarray, rare: float):
        self.shingle, self.weight, self.rare = shingle, weight, rare

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rare)
        if len(self.shingle) and len(h):
            at = np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)
            known = self.shingle[at] == h
            out[known] = self.weight[at[known]]
        return out


def inverse_frequencies(docs: DataFrame, n_docs: int, rare: int = RARE) -> Idf:
    """ln((N + 1) / (df + 1)) + 1, with df at least N over ``rare``.

    The frequent shingles, at most ``rare`` times the shingles of a text, are
    the one thing that the driver gets.
    """
    least = max(n_docs // rare, 1)
    bound = float(np.log((n_docs + 1) / (least + 1)) + 1)
    candidates = docs.sparkSession.sparkContext.broadcast(frequent_features(docs, least + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                _, h, _ = shingles(data, offsets)
                own, n = np.unique(h[candidates.value[feature(h)]], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(n)], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    got = rows.toArrow()
    shingle = got["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return Idf(shingle[order], (np.log((n_docs + 1) / (got["n"].to_numpy() + 1)) + 1)[order], bound)


def multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def _hashed(h: np.ndarray, factor: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a shingle and a function."""
    own = h * factor
    own ^= own >> _U(29)
    own *= _U(0xBF58476D1CE4E5B9)
    own ^= own >> _U(32)
    return own


def _two(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) from the halves of each hash."""
    return ((h >> _U(32)).astype(float) + 0.5) * 2.0**-32, ((h & _U(0xFFFFFFFF)).astype(float) + 0.5) * 2.0**-32


def draw(own: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of shingles with hashes ``own`` of (shingle, function).

    Improved consistent weighted sampling: with r, c ~ Gamma(2, 1) and
    b ~ Uniform(0, 1), t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r.
    r and c come from u, v and two more uniform numbers: u is 1 - exp(-e), where
    e = c times a uniform number is exponential, and r is minus the logarithm
    of that number times v.
    """
    u, v = _two(own)
    x, b = _two(mix(own + _U(0x9E3779B97F4A7C15)))
    e = -np.log1p(-u)
    log_c = np.log(e - np.log(x))
    r = log_c - np.log(e * v)
    t = np.floor(log_weight / r + b)
    return log_c - r * (t - b + 1), t


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, factors: np.ndarray) -> np.ndarray:
    """Draws [row, function] as 64-bit values; equal draws are the same shingle at the same t.  Rows without shingles get 0.

    ``a`` is at least e v over the weight, hence u v over the weight: only
    shingles below a bound on that can have the least a, if that a is below
    the bound too.  The least a of a text is exponential with its whole weight,
    so few texts need the second look, at all their shingles.
    """
    out = np.zeros((rows, len(factors)), np.uint64)
    if not len(h):
        return out
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    bound = FIRST_LOOK / np.add.reduceat(weight, starts)
    n = np.diff(np.append(starts, len(row)))
    stops = starts + n
    nth = np.repeat(np.arange(len(starts)), n)
    log_weight = np.log(weight)
    most = np.minimum(weight * bound[nth] * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    draws = np.zeros((len(factors), len(starts)), np.uint64)
    low = 0
    while low < len(starts):  # whole texts, about as many shingles as caches hold
        high = max(low + 1, int(np.searchsorted(stops, starts[low] + _SHINGLES, "right")))
        a, b = starts[low], stops[high - 1]
        _least_draws(h[a:b], log_weight[a:b], most[a:b], nth[a:b] - low, starts[low:high] - a, n[low:high], bound[low:high], factors, draws[:, low:high])
        low = high
    out[row[starts]] = draws.T
    return out


def _least_draws(h, log_weight, most, nth, starts, n, bound, factors, out) -> None:
    near, function, hashes = [], [], []
    for k, factor in enumerate(factors):
        own = _hashed(h, factor)
        at = np.flatnonzero((own >> _U(32)) * (own & _U(0xFFFFFFFF)) <= most)
        near.append(at)
        function.append(np.full(len(at), k))
        hashes.append(own[at])
    at, k = np.concatenate(near), np.concatenate(function)
    cell, least, value = _least(at, k * len(starts) + nth[at], np.concatenate(hashes), h, log_weight)
    sure = np.exp(least) <= bound[cell % len(starts)]
    flat = np.zeros(len(factors) * len(starts), np.uint64)
    flat[cell[sure]] = value[sure]
    open_ = np.ones(len(flat), bool)
    open_[cell[sure]] = False
    again = np.flatnonzero(open_)
    ends = np.cumsum(n[again % len(starts)])
    low = 0
    while low < len(again):  # about a million shingles at a time, or those of one text
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
        of = again[low:high] % len(starts)
        each = n[of]
        at = np.arange(each.sum()) + np.repeat(starts[of] - np.cumsum(each) + each, each)
        cells = np.repeat(again[low:high], each)
        cell, _, value = _least(at, cells, _hashed(h[at], factors[cells // len(starts)]), h, log_weight)
        flat[cell] = value
        low = high
    out[:] = flat.reshape(out.shape)


def _least(at: np.ndarray, cell: np.ndarray, own: np.ndarray, h: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, ln a, value) of the least draw in each cell; ``cell`` ascends and a cell's shingles do too."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    ln_a, t = draw(own, log_weight[at])
    begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    least = np.minimum.reduceat(ln_a, begins)
    winner = np.flatnonzero(ln_a == np.repeat(least, np.diff(np.append(begins, len(at)))))
    winner = winner[np.append(True, cell[winner[1:]] != cell[winner[:-1]])]
    return cell[begins], least, mix(h[at[winner]] + mix(t[winner].astype(np.int64).view(np.uint64)))


def unpacked(packed: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a packed text, ascending, and their TF-IDF weights."""
    n = len(packed) // 12
    h = np.frombuffer(packed, np.uint64, n)
    return h, np.frombuffer(packed, np.uint32, n, 8 * n) * idf.of(h)


def weighted_jaccard(a: bytes, b: bytes, idf: Idf) -> float:
    """Similarity of two packed shingle sets: sum of least over sum of greatest TF-IDF weights."""
    (hx, wx), (hy, wy) = unpacked(a, idf), unpacked(b, idf)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    least = np.minimum(wx[i], wy[j]).sum()
    whole = wx.sum() + wy.sum() - least
    return float(least / whole) if whole else 0.0


def _sampled(docs: DataFrame, shared, bands: int, band_rows: int) -> DataFrame:
    """(tid, mass, keys) once per text with a word: its whole weight and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, seen, idf = multipliers(bands * band_rows), set(), Idf(*shared.value)
        for batch in batches:
            tids = batch.column(0).to_numpy()
            for low, high, data, offsets in text_blocks(batch.column(1)):
                row, h, tf = shingles(data, offsets)
                own = tids[low:high]
                fresh = np.zeros(len(own), bool)
                for i in np.unique(row):
                    fresh[i] = own[i] not in seen
                    seen.add(own[i])
                if len(seen) > 200_000:
                    seen.clear()
                keep = fresh[row]
                row, h, tf = row[keep], h[keep], tf[keep]
                weight = tf * idf.of(h)
                draws = signatures(row, h, weight, len(own), factors)
                mass = np.bincount(row, weight, len(own)).astype(float)  # of no rows bincount gives whole numbers, weighted or not
                keys = np.zeros((len(own), bands), np.uint64)
                for b in range(bands):
                    for k in range(b * band_rows, (b + 1) * band_rows):
                        keys[:, b] = mix(keys[:, b] * _U(31) + draws[:, k])
                    keys[:, b] = mix(keys[:, b] + _U(b + 1))
                at = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[at], pa.int64()),
                        pa.array(mass[at]),
                        pa.FixedSizeListArray.from_arrays(pa.array(signed(keys[at].ravel())), bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["tid", "mass", "keys"],
                )
        give_back()

    made = docs.select("tid", "text").mapInArrow(run, "tid bigint, mass double, keys array<bigint>")
    return made.dropDuplicates(["tid"])


def _packed(docs: DataFrame) -> DataFrame:
    """(tid, shingles): each text's distinct shingles and term frequencies, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(1)):
                row, h, tf = shingles(data, offsets)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                packed = [h[a:b].tobytes() + tf[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(packed, pa.binary())], names=["tid", "shingles"])

    return docs.select("tid", "text").mapInArrow(run, "tid bigint, shingles binary")


def _verified(pairs: DataFrame, packed: DataFrame, shared, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose weighted Jaccard similarity is at least ``least``."""
    pairs = written(pairs.distinct(), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Idf(*shared.value)
        for batch in batches:
            good = [weighted_jaccard(x.as_py(), y.as_py(), idf) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = packed.select(F.col("tid").alias("a"), F.col("shingles").alias("x"))
    right = packed.select(F.col("tid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(run, "a bigint, b bigint"), "links")


def _shared_cells(packed: DataFrame, shared) -> DataFrame:
    """(tid, rest): the weight of those shingles that another of the texts has too, by cell of the shingle's hash.

    The sum over cells of the least of two texts' weights is never below the
    weight that they have in common.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text in zip(batch.column(0), batch.column(1), strict=True):
                h = np.frombuffer(text.as_py(), np.int64, len(text.as_py()) // 12)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tid.as_py())), pa.array(h)], names=["tid", "shingle"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = Idf(*shared.value)
        for batch in batches:
            rest = []
            for text, single in zip(batch.column(1), batch.column(2), strict=True):
                h, w = unpacked(text.as_py(), idf)
                if single.is_valid:
                    w = np.where(np.isin(h, single.values.to_numpy().view(np.uint64)), 0.0, w)
                # Rounded up, so that the bound stays one.
                rest.append(np.nextafter(np.bincount((h & _U(CELLS - 1)).astype(np.int64), w, CELLS).astype(np.float32), np.float32(np.inf)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.list_(pa.float32()))], names=["tid", "rest"])

    rows = packed.mapInArrow(spread, "tid bigint, shingle bigint")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("tid").alias("tid")).where("n = 1")
    joined = packed.join(single.groupBy("tid").agg(F.collect_list("shingle").alias("single")), "tid", "left").select("tid", "shingles", "single")
    return joined.mapInArrow(cells, "tid bigint, rest array<float>")


def _dealt(members: DataFrame, size: int = MEMBERS) -> DataFrame:
    """Each member of a bucket (key) with several components, once for each pair (i, j) of the bucket's blocks that its own block is in.

    A bucket has a block per ``size`` members, so that no task meets a large one whole.
    """
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    buckets = buckets.select("key", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    placed = members.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return placed.select("key", "i", "j", "block", "tid", "component", "mass", "most", "keys", "rest")


def _close(group: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of ``_close_pairs`` in whole groups, which ``group`` has one after another."""
    key, i, j, block, tid, component, mass, most = (group.column(k).to_numpy() for k in range(8))
    n = group.num_rows
    keys, rest = (group.column(k).flatten().to_numpy().reshape(n, -1) for k in (8, 9))
    new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    ends = np.append(new, n)
    each = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1
    total = np.cumsum(each)
    low = 0

    def alike(x, y, common):
        return common >= (least - 1e-6) * (mass[x] + mass[y] - common)

    while low < n:
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, "right")))
        some = each[low:high]
        x = np.repeat(np.arange(low, high), some)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
        good = (component[x] != component[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
        x, y = x[good], y[good]
        good = alike(x, y, np.minimum(most[x], most[y]))
        x, y = x[good], y[good]
        for at in range(0, len(x), 1 << 13):
            a, b = x[at : at + (1 << 13)], y[at : at + (1 << 13)]
            good = alike(a, b, np.minimum(rest[a], rest[b]).sum(1, dtype=float))
            a, b = a[good], b[good]
            same = keys[a] == keys[b]
            good = keys[a, same.argmax(1)] == key[a]
            a, b = tid[a[good]], tid[b[good]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        low = high


def _close_pairs(dealt: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of one bucket and two components that may be similar enough by their cells.

    A pair meets once: in the first band whose bucket both are in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, i, j = (batch.column(k).to_numpy() for k in range(3))
            cut = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1:].sum() + 1) if (key[0], i[0], j[0]) != (key[-1], i[-1], j[-1]) else 0
            if cut:
                yield from _close(batch.slice(0, cut), least)
            held = batch.slice(cut)
        if held is not None:
            yield from _close(held, least)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint")


def text_ids(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, tid, text and more columns): ``tid`` is a 64-bit fingerprint of the text and its length, null for a null text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("tid"),
        text.alias("text"),
        *more,
    )


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, tid, class_id): one row per document; class_id is the least doc_id of its class.

    Texts are linked if their weighted Jaccard similarity is at least
    ``least``; a class is a connected component.  Equal texts always share a
    class and are compared once.  A null text or one without a word is alone:
    its class is its own doc_id (null if that is null).  Words are compared in
    lower case.  Null ids are ranked last in a class.  Repeated rows stay;
    other columns are ignored; an empty table gives no rows.

    Within a band's bucket, members are first compared with three leaders (one
    per priority order, found by aggregation), whatever the bucket's size, so
    a large group of copies costs a few links a member.  Then pairs of a bucket
    that still lie in different components are compared, unless a bound on
    what they have in common shows that they cannot be similar enough; a large
    bucket is dealt by pairs of blocks of its members.
    """
    return _classes(text_ids(docs, id_col, text_col), least, bands, band_rows).select("doc_id", "tid", F.coalesce("head.doc_id", "doc_id").alias("class_id"))


def _classes(rows: DataFrame, least: float = 0.8, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """The rows of ``text_ids`` without text, and head.

    ``head`` is (doc_id, tid) of the row that stands for the class: least
    doc_id, nulls last, then least tid.  It is null for a row that is alone.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    n_docs = rows.count()
    idf = inverse_frequencies(rows, n_docs)
    shared = spark.sparkContext.broadcast((idf.shingle, idf.weight, idf.rare))
    texts = rows.where("tid IS NOT NULL").select("tid", F.coalesce("doc_id", F.lit(NO_ID)).alias("carrier"), "text")
    sampled = written(_sampled(texts, shared, bands, band_rows), "draws")

    members = sampled.select(F.explode("keys").alias("key"), "tid", "mass")
    orders = [F.col("tid"), F.xxhash64("tid", F.lit(1)), F.xxhash64("tid", F.lit(2))]
    leaders = members.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.struct(o.alias("o"), "tid")).alias(f"p{i}") for i, o in enumerate(orders)]).where("n > 1")
    buckets = leaders.select("key", "n", F.array_distinct(F.array(*[f"p{i}.tid" for i in range(len(orders))])).alias("leaders"))
    listed = written(members.join(buckets, "key"), "buckets")
    # One carrier a text, its least doc_id, so that the copies of a hot text neither meet in one task nor move together.
    carriers = texts.groupBy("tid").agg(F.min("carrier").alias("carrier"))
    wanted = written(listed.select("tid").distinct().join(carriers, "tid"), "carriers")
    one_each = texts.join(wanted.hint("shuffle_hash"), ["tid", "carrier"], "left_semi").groupBy("tid", "carrier").agg(F.first("text").alias("text"))
    packed = written(_packed(one_each), "shingles")
    stars = listed.select(F.explode("leaders").alias("b"), F.col("tid").alias("a")).where("a <> b")
    stars = written(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    links = _verified(stars, packed, shared, least)
    parts = written(connected_components(links), "parts")

    # Buckets whose members are not yet of one component: compare across components.
    placed = listed.where("n > 2").select("key", "tid", "mass").join(parts.withColumnRenamed("node", "tid"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    placed = placed.join(mixed, "key", "left_semi")
    rest = _shared_cells(packed.join(placed.select("tid").distinct(), "tid", "left_semi"), shared)
    total = F.aggregate("rest", F.lit(0.0), lambda s, v: s + v)
    open_members = placed.join(rest, "tid").withColumn("most", total)
    # A text with too much of its own is similar enough to none, whatever the other text is.
    open_members = open_members.where(F.col("most") >= (least - 1e-6) * F.col("mass"))
    open_members = written(open_members.join(sampled.select("tid", "keys"), "tid"), "open")
    across = _close_pairs(_dealt(open_members), least)
    more = _verified(across.join(stars, ["a", "b"], "left_anti"), packed, shared, least)
    parts = written(connected_components(links.unionByName(more)), "parts")

    classed = rows.select("doc_id", "tid", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    classed = classed.join(parts.withColumnRenamed("node", "tid"), "tid", "left")
    classed = classed.withColumn("part", F.when(F.col("worded"), F.coalesce("component", "tid")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")).alias("head")
    heads = written(classed.where("part IS NOT NULL").groupBy("part").agg(first, F.count("*").alias("n")).where("n > 1"), "heads")
    # Salted, so that the copies of one hot text spread over many tasks, also if they repeat an id.
    salts = 16
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).cast("int")).join(heads.hint("merge"), ["part", "salt"], "left")
    return out.select("doc_id", "tid", "head")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one row of each near-duplicate class: one of least doc_id stays, null ids last.

    Of repeated rows, of copies with null ids and of near copies under one id
    only one stays; of rows that repeat id and text, the one of least hash.
    All columns are kept; other options are those of
    ``near_duplicate_classes``.  Rows that share id and text meet in one task,
    where each other task sends one of them.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    rows = text_ids(docs, id_col, text_col)
    placed = _classes(rows, **options).where("head IS NOT NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_"), F.col("tid").alias("tid_"), "head")
    same = (F.col("id_") == F.coalesce("head.doc_id", F.lit(NO_ID))) & (F.col("tid_") == F.col("head.tid"))
    known = placed.withColumn("same", same).groupBy("id_", "tid_").agg(F.first("same").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id_"),
        F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("tid_"),
    )
    known = written(known, "known")
    if known.where("stays").isEmpty():
        return whole.join(known.hint("merge"), ["id_", "tid_"], "left_anti").select("row.*")
    joined = whole.join(known.hint("merge"), ["id_", "tid_"], "left")
    alone = joined.where("stays IS NULL").select("row")
    least_row = F.min_by("row", F.xxhash64("row")).alias("row")
    return alone.unionByName(joined.where("stays").groupBy("id_", "tid_").agg(least_row).select("row")).select("row.*")
