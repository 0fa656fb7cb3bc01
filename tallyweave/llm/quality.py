"""Quality rules for documents and their hosts.

Each document is measured and judged by five rules: length, repeats, symbols,
word length and repeated lines.  Failures are summed by host and rule; a host's
rate of each rule is shrunk towards all hosts by a beta prior fitted to that
rule's rates, and the host's verdict over all rules is joined back to its
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, written
from tallyweave.llm.words import blocks, buffers, mix, split_words

_U = np.uint64
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEATED_SHARE = 50
#: A host fails if its shrunk rate of documents that fail one rule is over this, whatever the other hosts are like.
HOST_RATE = 0.5
#: A host fails too if the rate stands out: two posterior deviations below it, it is still this much,
#: and three deviations of the other hosts, over the other hosts' rate.
EXCESS, POSTERIOR_DEVIATIONS, HOST_DEVIATIONS = 0.1, 2, 3
MEASURES = "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
#: Rules by name; each is null or false where it doesn't apply.  The first two make ``base_failed``.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEATED_SHARE} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each row of a block."""
    words = split_words(data, offsets)
    rows, n = len(offsets) - 1, len(words.start)
    total = lambda per_byte: np.diff(np.append(0, np.cumsum(per_byte))[offsets])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    letters = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    repeated = np.zeros(n, bool)
    if n >= 3:
        row = words.row
        at = np.flatnonzero(row[: n - 2] == row[2:])
        h = mix(mix(mix(words.hash[at]) + words.hash[at + 1]) + words.hash[at + 2])
        h = mix(h + row[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        for k in range(3):
            repeated[again + k] = True
    dup_lines, lines = duplicate_lines(data, offsets, words.start)
    return [words.count, total(letters), total(symbol[data]), dup_lines, np.diff(np.append(0, np.cumsum(repeated))[words.first]), lines]


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their row, and all lines with a word."""
    rows = len(offsets) - 1
    if not len(word_starts):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 0x0A)
    row = np.searchsorted(offsets, starts, "right") - 1
    with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, row = starts[with_word], ends[with_word], row[with_word]
    seen: set[tuple[int, bytes]] = set()
    out = np.zeros(rows, np.int64)
    raw, last = data.tobytes(), -1
    for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
        if r != last:
            seen, last = set(), r
        line = raw[a:b]
        if line in seen:
            out[r] += 1
        else:
            seen.add(line)
    return out, np.bincount(row, minlength=rows)


def rule_measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host and the measures): a row per document, no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for low, high in blocks(offsets):
                at = offsets[low : high + 1]
                got = measure(data[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).cast(pa.string()), *[pa.array(g.astype(np.int64)) for g in got]],
                    names=[c.split()[0] for c in MEASURES.split(", ")],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, MEASURES)


def _strength(n: Column, k: Column, mean: Column, x2: Column) -> Column:
    """Strength (a + b) of the beta prior of n hosts with k documents, from the mean rate and the sum of failures times rate."""
    least = mean * (1 - mean)
    beyond = F.greatest(x2 / k - mean * mean, F.lit(0.0)) - least * n / k  # between hosts, by documents, beyond chance
    fitted = F.when(beyond > 0, least / beyond - 1).otherwise(k.cast("double"))
    return F.least(F.greatest(fitted, F.lit(1.0)), F.greatest(k.cast("double"), F.lit(1.0)))


def host_verdicts(measured: DataFrame, most_rate: float = HOST_RATE) -> DataFrame:
    """(host, rule, documents, failures, shrunk_rate, rule_failed): a row per host and rule of ``RULES``.

    Each rule has a beta prior of its own with the mean and variance of the
    hosts' rates (method of moments, hosts weighing by documents); without a
    spread between hosts beyond chance every rate shrinks to the common one.
    A host fails a rule if its shrunk rate is over ``most_rate``, or stands out
    from the other hosts (see ``EXCESS``); the others' mean and deviation leave
    the host itself out, so that a large bad host can't hide behind the spread
    that it makes.  The null host is one host.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("documents"), *[F.sum(F.coalesce(F.expr(c), F.lit(False)).cast("bigint")).alias(r) for r, c in RULES.items()])
    hosts = written(hosts, "hosts")
    each = hosts.select("host", "documents", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failures")) for r in RULES])).alias("f")).select("host", "documents", "f.*")
    each = each.withColumn("x2", F.col("failures") * F.col("failures") / F.col("documents"))
    totals = each.groupBy("rule").agg(F.count("*").alias("n"), F.sum("documents").alias("k"), F.sum("failures").alias("x"), F.sum("x2").alias("s"))
    placed = each.join(F.broadcast(totals), "rule")
    c = F.col
    mean = c("x") / c("k")
    placed = placed.withColumn("mean", mean).withColumn("strength", _strength(c("n"), c("k"), c("mean"), c("s")))
    placed = placed.withColumn("shrunk_rate", (c("failures") + c("strength") * c("mean")) / (c("documents") + c("strength")))
    sure = c("shrunk_rate") - POSTERIOR_DEVIATIONS * F.sqrt(c("shrunk_rate") * (1 - c("shrunk_rate")) / (c("documents") + c("strength") + 1))
    rest = F.when(c("n") > 1, c("k") - c("documents"))  # null for a single host, which no other can be held against
    placed = placed.withColumn("rest", rest).withColumn("usual", (c("x") - c("failures")) / c("rest"))
    usual = c("usual")
    deviation = F.sqrt(usual * (1 - usual) / (_strength(c("n") - 1, c("rest"), usual, c("s") - c("x2")) + 1))
    out_stands = sure > usual + F.greatest(F.lit(EXCESS), HOST_DEVIATIONS * deviation)
    failed = (c("shrunk_rate") > most_rate) | F.coalesce(out_stands, F.lit(False))
    return placed.select("host", "rule", "documents", "failures", "shrunk_rate", failed.alias("rule_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_rate: float = HOST_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): a row per document.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    three-word windows that occur twice or more.  ``kept``: neither the
    document failed so nor its host failed any of ``RULES``.  A null text has no words and fails; null
    hosts are one host; repeated rows stay; other columns are ignored; an
    empty table gives no rows.
    """
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    measured = written(rule_measures(docs, id_col, text_col, host_col).withColumn("base_failed", failed), "measures")
    verdicts = host_verdicts(measured, most_rate).groupBy(F.col("host").alias("of")).agg(F.max("rule_failed").alias("host_failed"))
    out = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["of"]), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
