"""Matrices in array files (.npy) as rows, and the other way round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    """(row, vector array<double>) of a matrix file, (row, vector) of one value a row for a vector file.

    The driver reads the header only; each task maps the file and reads the
    rows of its blocks, so all executors need to see ``path``.
    """
    n = np.load(path, mmap_mode="r").shape[0]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.load(path, mmap_mode="r")
        for frame in frames:
            for first in frame["first"]:
                part = np.asarray(whole[first : first + block], dtype=float)
                yield pd.DataFrame({"row": np.arange(first, first + len(part)), "vector": list(part.reshape(len(part), -1))})

    blocks = -(-n // block)
    firsts = spark.range(0, blocks, 1, max(1, blocks)).select((F.col("id") * block).alias("first"))
    return firsts.mapInPandas(rows, "row long, vector array<double>")


def write_matrix(df: DataFrame, path: str, width: int, row: str = "row", vector: str = "vector") -> None:
    """Write rows numbered from 0 without gaps as a matrix file of doubles, each in its place.

    The file is laid out first; tasks fill in their rows, and a task that runs
    again writes the same bytes.  All executors need to see ``path``.
    """
    low, high, n, rows = df.agg(F.min(row), F.max(row), F.count(row), F.count("*")).first()
    if rows and (low != 0 or high != rows - 1 or n != rows):
        raise ValueError("rows have to be numbered from 0 without gaps")
    np.lib.format.open_memmap(path, mode="w+", dtype=np.float64, shape=(rows, width)).flush()

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.lib.format.open_memmap(path, mode="r+")
        for frame in frames:
            if len(frame):
                whole[frame["row"].to_numpy()] = np.array(frame["vector"].tolist(), dtype=float).reshape(len(frame), width)
            yield pd.DataFrame({"n": [len(frame)]})
        whole.flush()

    if rows:
        done = df.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(fill, "n long").agg(F.sum("n")).first()[0]
        assert done == rows


def aligned(left: DataFrame, right: DataFrame, on: str = "row") -> DataFrame:
    """Rows of both sides with one number; a ValueError if a row is without its counterpart."""
    if not left.select(on).join(right.select(F.col(on).alias("other_")), F.col(on) == F.col("other_"), "full").where(f"`{on}` IS NULL OR other_ IS NULL").isEmpty():
        raise ValueError("the sides have different rows")
    return left.join(right, on)
