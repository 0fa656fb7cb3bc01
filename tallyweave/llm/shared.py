"""Batches of bounded size and connected components; the shared folder is that of the library."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.shared import new_path, shared_dir, written

__all__ = ["bounded_batches", "connected_components", "give_back", "new_path", "shared_dir", "written"]


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let no Arrow batch that goes to Python pass ``size`` bytes by more than one row: long texts come in smaller batches.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` for the session,
    unless it is smaller; batches are made when a result is read, so it can't be set back here.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if int(now.rstrip("kmg")) << unit not in range(1, size + 1):
        spark.conf.set(name, str(size))


def give_back() -> None:
    """Return to the system what this process has freed: a Python worker outlives its task and would keep it beside the next one's.

    Where the C library has no ``malloc_trim``, only Arrow's memory is returned.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); component is the smallest node.

    Alternates large-star and small-star (Kiveris et al., 2014): each round is
    linear in the edges and needs O(log n) rounds; no component is ever held
    by one task.  Each round is written to the shared folder.  Null ends and
    loops are ignored; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = written(edges.distinct(), "edges")
    for _ in range(most_rounds):
        # Stars are a fixed point: a node has one smaller neighbour, its centre, or is a centre.
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(current.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR (up = 1 AND low = 0)").isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        current = written(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
