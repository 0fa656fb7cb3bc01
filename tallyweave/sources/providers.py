"""Vectors for texts from a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import unit

#: A provider maps a list of texts to vectors of one length, in order.
Embedder = Callable[[list[str]], list[list[float]]]


def hashed_letters(size: int = 64) -> Embedder:
    """A deterministic stand-in without a network: counts of three-letter runs by checksum."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * size
            for i in range(max(len(text) - 2, 1)):
                v[zlib.crc32(text[i : i + 3].encode()) % size] += 1.0
            out.append(v)
        return out

    return embed


def embedded(df: DataFrame, text: str, provider: Embedder, size: int = 500) -> DataFrame:
    """Rows with ``embedding``, of unit length: the provider is asked for at most ``size`` texts a call.

    Null and blank texts aren't sent: their embedding is null, as is that of a
    zero vector.  Task retries ask again, so a provider has to be idempotent.
    """
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                asked = part[text].map(lambda t: isinstance(t, str) and t.strip() != "")
                vectors = pd.Series([None] * len(part), index=part.index, dtype=object)
                if asked.any():
                    vectors[asked] = pd.Series(list(provider(part.loc[asked, text].tolist())), index=part.index[asked], dtype=object)
                yield part.assign(embedding=vectors)[[*columns, "embedding"]]

    schema = df.withColumn("embedding", F.lit(None).cast("array<double>")).schema
    return df.mapInPandas(run, schema).withColumn("embedding", unit("embedding"))
