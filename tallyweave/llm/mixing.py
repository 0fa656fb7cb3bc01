"""Mixing sources to target weights by balanced sampling (the cube method).

A source's documents are each taken floor(q) or floor(q) + 1 times, where q is
target over size.  The fractions are inclusion probabilities, which the cube
method (Deville and Tille, 2004) moves to 0 or 1 along directions that change
neither the word total nor the document total.  Blocks of documents move in
parallel; each leaves at most two fractions, which are moved in the next level,
until one block a source is left.  A pool of its documents is held back.  The
last two fractions and the pool's large documents are drawn one by one, and the
pool's other fractions move by as many words the other way, in proportion, so
that their expectations stay; then these fly, and a few of them are landed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import written
from tallyweave.llm.sharding import numbered

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
REPEATS = 3
#: Fractions from which a source's last ones are settled in several ways, and how many.
LANDING, WAYS = 48, 6
_NEAR = 1e-9


def direction(size: np.ndarray, room: np.ndarray) -> np.ndarray | None:
    """A direction that moves the first document by 1 and the others, by their room, so that neither total changes; None if there is none."""
    r, s0 = room[1:], float(room[1:].sum())
    if s0 <= 0:
        return None
    middle = float(r @ size[1:]) / s0
    apart, own = size[1:] - middle, float(size[0]) - middle
    weighed = r * apart
    spread = float(weighed @ apart)
    u = np.empty(len(size))
    u[0] = 1.0
    if spread > 1e-12 * s0 * max(middle * middle, 1e-12):
        u[1:] = r * (-1 / s0) - weighed * (own / spread)
    elif abs(own) <= 1e-12 * max(middle, 1.0):
        u[1:] = r * (-1 / s0)
    else:
        return None
    return u


def step_to_face(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """One step of the martingale: as far as the cube goes along ``u`` or against it, with the chances that keep expectations."""
    room = np.where(u > 0, 1 - p, p), np.where(u > 0, p, 1 - p)
    size = np.abs(u) + 1e-300
    up, down = float((room[0] / size).min()), float((room[1] / size).min())
    moved = p + u * (up if draw * (up + down) < down else -down)
    moved[moved < _NEAR] = 0.0
    moved[moved > 1 - _NEAR] = 1.0
    return moved


def flight(size: np.ndarray, p: np.ndarray, seed: list[int], left: int = 2) -> np.ndarray:
    """Flight phase, from the largest document to the smallest, until ``left`` fractions are open.

    Each document is moved to 0 or 1 along a direction that spreads what it
    changes over all smaller ones, so both totals and every expectation stay
    exact, and what stays open (also what no others can make up for) is small.
    """
    p = p.astype(float).copy()
    order = np.lexsort((np.arange(len(p)), -size))
    open_ = order[(p[order] > _NEAR) & (p[order] < 1 - _NEAR)]
    draws = iter(np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(2 * len(p) + 4))
    sizes, now = size[open_].astype(float), p[open_]
    while len(open_) > max(left, 2):
        u = direction(sizes, np.minimum(now, 1 - now))
        if u is None:
            p[open_[0]] = now[0]
            open_, sizes, now = open_[1:], sizes[1:], now[1:]
            continue
        now = step_to_face(now, u, next(draws))
        open_now = (now > 0) & (now < 1)
        p[open_[~open_now]] = now[~open_now]
        open_, sizes, now = open_[open_now], sizes[open_now], now[open_now]
    p[open_] = now
    return np.where(p <= _NEAR, 0.0, np.where(p >= 1 - _NEAR, 1.0, p))


def land(size: np.ndarray, p: np.ndarray, seed: list[int]) -> np.ndarray:
    """Landing phase: gives the words up first, as pairs move against each other, which keeps the number of documents; the last one is drawn by its probability."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    draws = iter(np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(len(p) + 1))
    while len(open_):
        p[open_[-2:]] = step_to_face(p[open_[-2:]], np.array([1.0, -1.0])[: len(open_)], next(draws))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def balanced(size: np.ndarray, p: np.ndarray, seed: list[int]) -> np.ndarray:
    """All probabilities of a source's one block as 0 or 1: of some ways to settle its last fractions, the one nearest in words."""
    open_ = flight(size, p, [*seed, 0], LANDING)
    ways = [land(size, flight(size, open_, [*seed, 1, t]), [*seed, 2, t]) for t in range(WAYS)]
    return min(ways, key=lambda q: abs(float(q @ size - p @ size)))


def source_targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_no, documents, source_size, target): one row per source.

    ``sizes`` has source and size.  Sources in code-point order, null last,
    get the weights in turn; shares of the whole size are capped at
    ``repeats`` times the source's size and the excess is shared again by
    weight.  Only this table, a row per source, is numbered; the driver gets
    sums of it alone.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    # Numbers without a global window: sorted ranges, then the rows before each range.
    ranged = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = starts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = ranged.withColumn("part", part).join(F.broadcast(starts.drop("n")), "part")
    number = F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights)).cast("int") + 1).cast("double")
    numbered = written(numbered.select("source", number.alias("source_no"), "documents", "source_size", weight.alias("weight")), "sources")
    level, cap = 0.0, F.col("source_size") * repeats
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    while total:
        capped = F.col("weight") * level >= cap if level else F.col("source_size") == 0
        fixed, open_weight = numbered.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        after = (total - (fixed or 0)) / open_weight if open_weight else level
        if after <= level:
            break
        level = after
    return numbered.select("source", "source_no", "documents", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def balanced_copies(units: DataFrame, seed: int, block: int) -> DataFrame:
    """Adds ``copies``: how often each unit is taken.

    ``units`` has row_number, source_no, documents, source_size, target and
    size.  Levels of blocks are counted from the largest source, so every
    source goes through the same few steps.
    """
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("base", F.floor(q + _NEAR)).withColumn("p", F.greatest(q - F.col("base"), F.lit(0.0)))
    most = units.agg(F.max("documents")).first()[0] or 0
    left = units
    done: DataFrame | None = None
    level, per_source = 0, F.col("documents")
    while True:
        blocks = F.greatest(F.ceil(per_source / block), F.lit(1))
        last = most <= block
        flight = _flight(left.withColumn("blocks", blocks.cast("bigint")), seed, level)
        moved = written(flight, "mixed")
        settled = moved.where("p = 0 OR p = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        left, level = moved.where("p > 0 AND p < 1"), level + 1
        per_source, most = blocks * 2, 2 * math.ceil(most / block)
    return done.withColumn("copies", F.col("base") + F.col("p").cast("bigint")).drop("p", "base", "blocks")


def _flight(units: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of flight in every block; sources of one block are landed too.

    Blocks are dealt by row number, so rows that repeat an id, or have none, spread over them like any others.
    """
    order = F.xxhash64(F.lit(seed + level), "row_number")
    units = units.withColumn("block", F.pmod(order, "blocks")).withColumn("order_", order)
    schema = units.drop("block", "order_").schema
    names = schema.fieldNames()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order_", "ascending"), ("row_number", "ascending")])
        size, p = group["size"].to_numpy(), group["p"].to_numpy()
        last = group["blocks"][0].as_py() == 1
        seeds = [seed, level, group["source_no"][0].as_py(), group["block"][0].as_py()]
        moved = balanced(size, p, seeds) if last else flight(size, p, seeds)
        return group.select(names).set_column(names.index("p"), "p", pa.array(moved, pa.float64()))

    return units.groupBy("source_no", "block").applyInArrow(run, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _planned(units: DataFrame, seed: int, block: int, repeats: int) -> DataFrame:
    targets = written(source_targets(units.select("source", "size"), repeats), "targets")
    joined = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop("source")
    return balanced_copies(joined, seed, block)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row per document and the words the mix takes of it.

    Size is the number of words.  Null texts have size 0; a null source is one
    source; null ids and repeated rows are rows of their own; other columns
    are ignored; an empty table gives no rows.  A source's taken words differ
    from its target by less than its last one or two documents' sizes, and no
    document is taken more than ``repeats`` times.  The same rows and seed
    give the same mix.
    """
    units = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    # Equal rows may change places, so the last number, which spreads them over the ranges, doesn't change the mix.
    # Written first, as sampling the ranges would count the words once more.
    units = written(units.withColumn("tie_", F.monotonically_increasing_id()), "units")
    units = numbered(units, ["doc_id", "source", "size", "tie_"]).drop("tie_")
    out = _planned(units, seed, block, repeats)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The documents as the mix takes them: none, one or several equal rows of each, all columns kept.

    Rows are numbered in the order of id, text and the rest, so rows that
    repeat id and text, in one source or several, each get the copies drawn for
    them, and the same rows and seed give the same mix.
    """
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id_"), F.xxhash64(text, F.length(text)).alias("tid_"))
    # Equal rows may change places, so the last number, which spreads a hot group over the ranges, doesn't change the mix.
    whole = whole.withColumn("hash_", F.xxhash64("row")).withColumn("tie_", F.monotonically_increasing_id())
    whole = numbered(whole, ["id_", "tid_", "hash_", "tie_"]).select("row", "row_number")
    own = F.col("row")[text_col]
    units = whole.select("row_number", F.col("row")[source_col].cast("string").alias("source"), word_count(own).alias("size"))
    copies = _planned(written(units, "units"), seed, block, repeats).where("copies > 0").select("row_number", F.col("copies").cast("int").alias("copies"))
    return whole.join(copies, "row_number").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
