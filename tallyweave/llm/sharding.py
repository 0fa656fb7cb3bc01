"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of id, text checksum and size.  A keyed Feistel
network permutes the numbers 0 to N - 1: it works on pairs (number div b,
number mod b) of a grid of at least N cells, and a number that lands beyond N
walks on along its cycle.  The permuted number gives the shard (mod) and the
slot (div), so both can be computed from a row number alone, shards differ by
one row at most and slots have no gaps.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import written

ROUNDS = 6
#: Steps of a walk at most.  A grid has fewer than sqrt(N) + 1 cells beyond N, so a step leaves the range
#: with a chance below 1 / 64 if N is over 4096, and every walk ends within 64 steps if it is not.
WALK = 64


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_number`` from 0 in the order of the columns; nulls first.

    Sorted ranges are written with each row's place in its range; a table of
    one row per range has the rows before it.  No global window over the rows.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    placed = written(placed, "ranges").withColumn("part_", F.shiftright("at_", 33))
    parts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    parts = parts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    out = placed.join(F.broadcast(parts), "part_")
    return out.withColumn("row_number", F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("part_", "at_", "before_")


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid: a * b >= n, fewer than a cells to spare."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permute(x: str, n: int, seed: int) -> Column:
    """The permuted number of the SQL expression ``x``, a bigint from 0 to n - 1."""
    a, b = grid(n)

    def once(value: str) -> str:
        # Rounds alternate: the left half moves by a hash of the right one, then the right by one of the left.
        pair = f"named_struct('l', ({value}) div {b}L, 'r', ({value}) % {b}L)"
        move = (
            f"if(i % 2 = 0, named_struct('l', pmod(p.l + pmod(xxhash64(p.r, i, {seed}L), {a}L), {a}L), 'r', p.r), "
            f"named_struct('l', p.l, 'r', pmod(p.r + pmod(xxhash64(p.l, i, {seed}L), {b}L), {b}L)))"
        )
        return f"aggregate(sequence(0, {ROUNDS - 1}), {pair}, (p, i) -> {move}, p -> p.l * {b}L + p.r)"

    inner = once("v")
    walked = f"aggregate(sequence(1, {WALK}), {once(x)}, (v, step) -> if(v < {n}L, v, {inner}))"
    return F.expr(f"transform(array({walked}), v -> if(v < {n}L, v, cast(raise_error('a walk did not end') AS bigint)))[0]")


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row per document, under the law ``rows``.

    size is the text's bytes in UTF-8 plus 1, and 1 for a null text, whose
    text_crc32 is null.  Shards' row counts differ by one at most; slots of a
    shard run from 0 without gaps.  grown_shard is null, as the law says
    nothing about other shard counts.  Null ids are numbered first; repeated
    rows get places of their own; other columns are ignored; an empty table
    gives no rows.  The same rows and seed give the same shards.
    """
    text = F.col(f"`{text_col}`").cast("string")
    data = F.encode(text, "UTF-8")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    n = rows.count()
    moved = rows.withColumn("moved", permute("row_number", max(n, 1), seed))
    return moved.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("moved") % shards).cast("int").alias("shard"),
        F.expr(f"moved div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
