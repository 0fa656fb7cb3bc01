"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  The piece
probabilities are fitted by expectation maximisation over all segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.shared import bounded_batches, give_back, written
from tallyweave.llm.words import blocks, buffers, split_words

_U = np.uint64
_BASE = _U(0x100000001B3)
#: Words of up to so many bytes are summed in groups of one length; longer ones in a rolling window that is rescaled.
SHORT_BYTES = 48
#: Steps of the rolling window between two rescalings, and bytes whose pieces are looked up at a time.
RESCALE, LONG_STEP = 8, 512
#: Added to the log probability per byte so that products of a run stay within doubles.
BYTE_GAIN = 3.5
SCORE_BLOCK = 3 << 20


def public_pieces(path: str) -> list[bytes]:
    """Lower-case pieces of a sentencepiece file as bytes, a word's start as a space, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    pieces = {t.encode() for t in texts if t == t.lower() and " " not in t[1:]}
    return sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})


class PieceTable:
    """Piece numbers by substring hash: two direct tables, checked against the whole hash."""

    def __init__(self, pieces: list[bytes], bits: int = 19):
        self.size, self.bits = len(pieces), bits
        self.lengths = np.array([len(p) for p in pieces])
        self.longest = int(self.lengths.max())
        keys = np.array([self.hash_of(p) for p in pieces], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.keys = np.append(keys, _U(0))
        self.tables = np.full((3, 1 << bits), self.size, np.int32)
        left = np.arange(self.size)
        for k in range(3):
            slot = self._slot(keys[left], k)
            _, at = np.unique(slot, return_index=True)
            self.tables[k, slot[at]] = left[at]
            left = np.delete(left, at)
        if len(left):
            raise ValueError("the tables are too small")

    @staticmethod
    def hash_of(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
        return h

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h * _U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k])) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, or ``size`` for no piece."""
        out = self.tables[0][self._slot(h, 0)]
        out[self.keys[out] != h] = self.size
        for k in (1, 2):
            rest = np.flatnonzero(out == self.size)
            got = self.tables[k][self._slot(h[rest], k)]
            good = self.keys[got] == h[rest]
            out[rest[good]] = got[good]
        return out


def groups(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte matrices of words of one length, a space before each, and the words' numbers."""
    size = end - start
    order = np.argsort(size, kind="stable")
    for n in np.unique(size).tolist():
        low, high = np.searchsorted(size[order], [n, n + 1])
        step = max(1, 160_000 // (n + 1))
        for at in range(low, high, step):
            own = order[at : min(at + step, high)]
            rows = data[start[own][None, :] + np.arange(n)[:, None]]
            yield np.vstack([np.full((1, len(own)), 0x20, np.uint8), rows]), own


def lattice(rows: np.ndarray, table: PieceTable) -> list[np.ndarray]:
    """Piece numbers by length (from 1) and start: entry [l - 1][j] covers bytes j to j + l."""
    values = rows.astype(np.uint64) + _U(1)
    h, out = values, []
    for n in range(1, min(table.longest, len(rows)) + 1):
        if n > 1:
            h = h[:-1] * _BASE + values[n - 1 :]
        out.append(table.find(h.ravel()).reshape(h.shape))
    return out


def forward(found: list[np.ndarray], scaled: np.ndarray) -> np.ndarray:
    """Scaled probability sums [byte, word, language] over all segmentations up to each byte."""
    m, width = len(found[0]), found[0].shape[1]
    alpha = np.zeros((m + 1, width, scaled.shape[1]))
    alpha[0] = 1
    for j in range(1, m + 1):
        total = alpha[j]
        for n in range(1, min(len(found), j) + 1):
            total += alpha[j - n] * scaled[found[n - 1][j - n]]
    return alpha


def scaled_table(logp: np.ndarray, table: PieceTable) -> np.ndarray:
    """Scaled probabilities [piece, language], with a last row of zeros for no piece."""
    return np.vstack([np.exp(logp + BYTE_GAIN * table.lengths[:, None]), np.zeros((1, logp.shape[1]))])


def long_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: PieceTable, scaled: np.ndarray) -> np.ndarray:
    """Log probability of words of any length, all segmentations summed.

    The sums up to the last bytes, as many as the longest piece has, are held
    for words of about one length; they are rescaled as they move on.
    """
    out = np.zeros((len(start), scaled.shape[1]))
    size, most = end - start + 1, table.longest
    order = np.argsort(size, kind="stable")
    low = 0
    while low < len(order):
        least = int(size[order[low]])
        high = min(int(np.searchsorted(size[order], least * 5 // 4, "right")), low + max(1, (1 << 18) // least))
        own = order[low:high]
        n, low = size[own], high
        window = np.zeros((most, len(own), scaled.shape[1]))
        window[-1] = 1
        log = np.zeros(window.shape[1:])
        held = np.zeros((0, len(own)), np.uint8)  # the bytes that pieces still coming may begin with
        for at in range(0, int(n.max()), LONG_STEP):
            place = np.arange(at, min(at + LONG_STEP, int(n.max())))[:, None]
            rows = data[np.minimum(start[own] + place - 1, len(data) - 1)]
            rows[np.broadcast_to(place == 0, rows.shape)] = 0x20
            rows[place >= n] = 0  # beyond a word's end, where nothing is read
            rows = np.vstack([held, rows])
            ends = np.full((len(place), most, len(own)), table.size, np.int32)
            for k, found in enumerate(lattice(rows, table)):
                first = max(0, len(held) - k)  # pieces of k + 1 bytes that end among the new bytes
                ends[first + k - len(held) :, most - 1 - k] = found[first:]
            held = rows[len(rows) - min(len(rows), most - 1) :]
            for j in range(len(place)):
                new = (window * scaled[ends[j]]).sum(0)
                window[:-1] = window[1:].copy()
                window[-1] = new
                done = np.flatnonzero(n == at + j + 1)
                if len(done):
                    out[own[done]] = log[done] + np.log(new[done]) - BYTE_GAIN * n[done, None]
                if j % RESCALE == RESCALE - 1:
                    log += np.log(new)
                    window /= new
    return out


def word_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: PieceTable, scaled: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(start), scaled.shape[1]))
    short = np.flatnonzero(end - start <= SHORT_BYTES)
    for rows, own in groups(data, start[short], end[short]):
        out[short[own]] = np.log(forward(lattice(rows, table), scaled)[-1]) - BYTE_GAIN * len(rows)
    long = np.flatnonzero(end - start > SHORT_BYTES)
    if len(long):
        out[long] = long_scores(data, start[long], end[long], table, scaled)
    return out


def rescaled_sums(through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ways to each place of one word, and the logarithm that each is short of.

    ``through`` [n - 1, j] is the probability of the step from place j - n to
    j; what the sums are short of grows as the window of the last places is rescaled.
    """
    most, places = through.shape
    sums, log = np.zeros(places), np.zeros(places)
    sums[0] = 1.0
    window, short = np.zeros(most), 0.0
    window[0] = 1.0  # the sum n places before stands at n - 1
    for j in range(1, places):
        new = float(window @ through[:, j])
        window[1:] = window[:-1].copy()
        window[0] = new
        sums[j], log[j] = new, short
        if j % RESCALE == 0 and new > 0:
            window /= new
            short += np.log(new)
    return sums, log


def long_counts(word: np.ndarray, table: PieceTable, scaled: np.ndarray, times: float) -> np.ndarray:
    """Expected numbers of each piece in one word of any length (bytes with the space before it), all its segmentations counted."""
    m, found = len(word), [f[:, 0] for f in lattice(word[:, None], table)]
    ahead, back = np.zeros((len(found), m + 1)), np.zeros((len(found), m + 1))
    for n, pieces in enumerate(found, 1):
        step = scaled[pieces, 0]
        ahead[n - 1, n:] = step
        back[n - 1, n:] = step[::-1]
    (alpha, a), (beta, b) = rescaled_sums(ahead), rescaled_sums(back)
    beta, b, count = beta[::-1], b[::-1], np.zeros(table.size + 1)
    whole = np.log(alpha[m]) + a[m]
    for n, pieces in enumerate(found, 1):
        weight = times * alpha[: m + 1 - n] * ahead[n - 1, n:] * beta[n:] * np.exp(a[: m + 1 - n] + b[n:] - whole)
        if n == 1:
            weight[0] = 0.0  # the space that stands before every word is no piece of a language's own
        count += np.bincount(pieces, weight, table.size + 1)
    return count


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    words = split_words(data, offsets)
    _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    return words, words.start[at], words.end[at], back


def fit_pieces(texts: pa.Array, table: PieceTable, rounds: int, smooth: float) -> np.ndarray:
    """Log piece probabilities of one language by expectation maximisation over the sample's words."""
    data, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    _, start, end, back = distinct_words(data, offsets)
    times = np.bincount(back, minlength=len(start)).astype(float)
    logp = np.full((table.size, 1), -np.log(table.size))
    short, long = np.flatnonzero(end - start <= SHORT_BYTES), np.flatnonzero(end - start > SHORT_BYTES)
    for _ in range(rounds):
        scaled, count = scaled_table(logp, table), np.zeros(table.size + 1)
        for rows, own in groups(data, start[short], end[short]):
            found = lattice(rows, table)
            alpha, m = forward(found, scaled)[:, :, 0], len(rows)
            beta = np.zeros_like(alpha)
            beta[m] = times[short[own]] / alpha[m]
            for j in range(m - 1, -1, -1):
                for n in range(1, min(len(found), m - j) + 1):
                    through = scaled[found[n - 1][j], 0] * beta[j + n]
                    beta[j] += through
                    # The space that stands before every word is no piece of a language's own.
                    count += np.bincount(found[n - 1][j], alpha[j] * through, table.size + 1) if n > 1 or j else 0
        for w in long.tolist():
            count += long_counts(np.append(np.uint8(0x20), data[start[w] : end[w]]), table, scaled, times[w])
        share = count[:-1] + smooth
        logp = np.log(share / share.sum())[:, None]
    return logp[:, 0]


def sample_by_language(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct labelled texts of each language, picked by hash; copies of a text count once.

    ``docs`` has text and lang.  Hashes under a threshold from the language's
    count of distinct texts are ranked, about three times ``most`` a language,
    so that no task gets a share of a frequent language; then texts are read
    once more and each task sends one of every picked text.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("pick", F.xxhash64("text", F.lit(17)))
    order = Window.partitionBy("lang").orderBy("pick")
    distinct = written(usable.select("lang", "pick").distinct(), "labelled")
    counts = F.broadcast(distinct.groupBy("lang").agg(F.count("*").alias("of")))
    rare = F.pmod("pick", F.lit(1 << 31)) * F.col("of") < F.lit(3 * most) * F.lit(1 << 31)
    few = distinct.join(counts, "lang").where(rare).select("lang", "pick")
    picks = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("lang", "pick")
    picked = usable.join(F.broadcast(picks), ["lang", "pick"], "left_semi")
    return picked.groupBy("lang", "pick").agg(F.first("text").alias("text")).select("lang", "text")


class LanguageModel:
    """Fitted languages, piece table and log probabilities; small: languages times vocabulary."""

    def __init__(self, languages: list[str], logp: np.ndarray, pieces: list[bytes]):
        self.languages, self.logp, self.pieces = languages, logp, pieces


def fit_languages(docs: DataFrame, vocabulary_path: str, most_docs: int = 300, rounds: int = 3, smooth: float = 0.05) -> LanguageModel:
    """Fit every language of ``docs`` (text, lang) in a task of its own, on a bounded sample.

    ``most_docs`` labelled whole texts of each language are used at most; null
    languages and texts without a letter are not.  No usable row: no language.
    """
    pieces = public_pieces(vocabulary_path)

    def fit(group: pa.Table) -> pa.Table:
        logp = fit_pieces(group["text"].combine_chunks(), PieceTable(pieces), rounds, smooth)
        return pa.table({"lang": group["lang"][:1].cast(pa.string()), "logp": pa.array([logp], pa.list_(pa.float64()))})

    sample = sample_by_language(docs, most_docs)
    rows = sorted(sample.groupBy("lang").applyInArrow(fit, "lang string, logp array<double>").collect(), key=lambda r: r[0])
    logp = np.array([r[1] for r in rows]).T if rows else np.zeros((len(pieces), 0))
    return LanguageModel([r[0] for r in rows], logp, pieces)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): each whole row as a struct, its language and that language's posterior probability.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Words of any length are summed whole.  Rows keep all their columns, inside the struct, so names cannot
    clash; repeated rows stay.  No shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = LanguageModel(*shared.value)
        table = PieceTable(fitted.pieces)
        scaled = scaled_table(fitted.logp, table)
        for batch in batches:
            data, offsets = buffers(pc.utf8_lower(batch.column(1).cast(pa.large_string())))
            for low, high in blocks(offsets, SCORE_BLOCK):
                at = offsets[low : high + 1]
                words, start, end, back = distinct_words(data[at[0] : at[-1]], at - at[0])
                got = np.zeros((high - low, len(fitted.languages)))
                if len(words.start) and got.shape[1]:
                    each = word_scores(data[at[0] : at[-1]], start, end, table, scaled)[back]
                    sums = np.vstack([np.zeros((1, got.shape[1])), np.cumsum(each, axis=0)])
                    got = sums[words.first[1:]] - sums[words.first[:-1]]
                best = got.argmax(1) if got.shape[1] else np.zeros(len(got), int)
                share = 1 / np.exp(got - got.max(1, keepdims=True)).sum(1) if got.shape[1] else np.zeros(len(got))
                known = batch.column(2).slice(low, high - low)
                names = pa.array([fitted.languages[b] for b in best] if fitted.languages else ["und"] * len(got), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pc.if_else(known, names, "und"), pc.if_else(known, pa.array(share, pa.float64()), 0.0)],
                    names=["row", "lang_pred", "score"],
                )
        give_back()

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
