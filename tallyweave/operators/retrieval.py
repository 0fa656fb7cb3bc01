"""Vector retrieval of known variables and the choice of a calibration source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a list column, by length; null vectors and those with a null component are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(lists).cast(pa.float64())
    owner = np.repeat(np.arange(len(size)), size)
    size = size.copy()
    size[owner[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    flat, out = values.to_numpy(zero_copy_only=False), {}
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        out[int(d)] = at, flat[size[owner] == d].reshape(len(at), d)
    return out


def nearest_of_blocks(asked: pa.Table, sent: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    """(query_id, vec_id, similarity): the k best of ``sent`` for each row of ``asked``; at most k rows a query leave.

    A product of the two blocks finds who may be among the k best, with room
    for its rounding; only those are summed again in order, so that results are
    equal to the bit to a sum over the components.
    """
    queries, vectors = _matrices(asked["q"]), _matrices(sent["v"])
    # Ids are compared by their place in the order of both blocks' ids, so any type will do.
    ids = pa.chunked_array([*asked["query_id"].cast(sent["vec_id"].type).chunks, *sent["vec_id"].chunks]).combine_chunks()
    place = np.unique(pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(), return_inverse=True)[1] if len(ids) else np.zeros(0, int)
    own, other = place[: asked.num_rows], place[asked.num_rows :]
    from_rows, to_rows, scores = [], [], []
    for d in queries.keys() & vectors.keys():
        (rows, q), (at, v) = queries[d], vectors[d]
        rough = q @ v.T
        if exclude_self:
            rough[own[rows][:, None] == other[at][None, :]] = -np.inf
        with np.errstate(invalid="ignore"):
            room = 4e-16 * (d + 1) * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0)
            least = np.partition(rough, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(rows), -np.inf)
            x, y = np.nonzero(((rough >= (least - 2 * room)[:, None]) & (rough > -np.inf)) | np.isnan(rough))
        for low in range(0, len(x), 1 << 16):
            i, j = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
            from_rows.append(rows[i])
            to_rows.append(at[j])
            scores.append(np.add.accumulate(q[i] * v[j], axis=1)[:, -1] + 0.0)
    if not scores:
        return pa.table({"query_id": asked["query_id"].slice(0, 0), "vec_id": sent["vec_id"].slice(0, 0), "similarity": pa.array([], pa.float64())})
    x, y, s = np.concatenate(from_rows), np.concatenate(to_rows), np.concatenate(scores)
    order = np.lexsort((other[y], np.where(np.isnan(s), -np.inf, -s), x))
    x, y, s = x[order], y[order], s[order]
    first = np.searchsorted(x, x)  # x is sorted: where its run begins
    kept = np.arange(len(x)) - first < k
    return pa.table({"query_id": asked["query_id"].take(pa.array(x[kept])), "vec_id": sent["vec_id"].take(pa.array(y[kept])), "similarity": pa.array(s[kept])})


def similar(queries: DataFrame, index: DataFrame, k: int, block: int = 2048, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k most similar index rows of each query, ties to the smaller id.

    ``queries`` has query_id and q, ``index`` vec_id and v.  Both are dealt into
    blocks of about ``block`` rows, and each pair of blocks is a key of its own,
    so tasks grow in number, not in size, with either side.  A pair of blocks is
    one matrix product, and only k rows a query leave it.  Vectors that are
    null, have a null component or another length than the query's are no
    candidates; not a number counts as the largest.
    """
    asked_blocks, blocks = (max(1, -(-df.count() // block)) for df in (queries, index))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "q", deal("query_id", asked_blocks).alias("asked_"), each(blocks).alias("block_"))
    sent = index.select("vec_id", "v", deal("vec_id", blocks).alias("block_"), each(asked_blocks).alias("asked_"))
    schema = T.StructType([asked.schema["query_id"], sent.schema["vec_id"], T.StructField("similarity", T.DoubleType())])
    pair = ["asked_", "block_"]
    scored = asked.groupBy(*pair).cogroup(sent.groupBy(*pair)).applyInArrow(lambda x, y: nearest_of_blocks(x, y, k, exclude_self), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def usable_anchor(n_categories: Column, max_share: Column, kind: str = "likert") -> Column:
    """Whether a variable's distribution can serve: three categories and no share over .85, or for binary items two and .95."""
    if kind == "binary":
        return (n_categories == 2) & (max_share <= 0.95)
    return (n_categories >= 3) & (max_share <= 0.85)


def retrieval_choice(candidates: DataFrame, high: float = 0.75, low: float = 0.5, most: int = 5, forced: bool = True) -> DataFrame:
    """One row per query: method, vec_id, top1, n_min, years_min, n_used and forced_degenerate.

    ``candidates`` has query_id, rank, vec_id, similarity, n, years, usable and
    quality.  At top1 >= high the first usable candidate in rank order is
    taken, or the first at all as forced degenerate; from low on, the first
    ``most`` of quality if there are two; otherwise none.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.withColumn("good", F.when(F.col("quality"), F.sum(F.col("quality").cast("int")).over(order)))
    best = F.when(F.col("usable"), F.col("rank"))
    used = F.col("good") <= most
    item = rows.groupBy("query_id").agg(
        F.min_by("similarity", "rank").alias("top1"),
        F.min_by(F.struct("vec_id", "n", "years"), "rank").alias("first"),
        F.min_by(F.when(F.col("usable"), F.struct("vec_id", "n", "years")), best).alias("best"),
        F.sum(F.when(used, 1).otherwise(0)).alias("n_good"),
        F.min(F.when(used, F.col("n"))).alias("good_n"),
        F.min(F.when(used, F.col("years"))).alias("good_years"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(used, F.struct("rank", "vec_id")))), lambda s: s["vec_id"].cast("string")), "+").alias("names"),
    )
    single, middle = F.col("top1") >= high, (F.col("top1") >= low) & (F.col("top1") < high)
    have, blend = F.col("best").isNotNull(), middle & (F.col("n_good") >= 2)
    pick = F.coalesce("best", "first")
    one = single & (have | F.lit(forced))
    return item.select(
        "query_id",
        F.when(one, "single_best").when(blend, "ensemble").otherwise("none").alias("method"),
        F.when(one, pick["vec_id"].cast("string")).when(blend, F.col("names")).alias("matched"),
        "top1",
        F.when(one, pick["n"]).when(blend, F.col("good_n")).alias("n_min"),
        F.when(one, pick["years"]).when(blend, F.col("good_years")).alias("years_min"),
        F.when(one, F.lit(1)).when(blend, F.col("n_good")).otherwise(0).cast("bigint").alias("n_used"),
        ((single & ~have) | (middle & ~blend)).alias("forced_degenerate"),
    )


def ensemble_weights(similarity: Column, by: str = "query_id") -> Column:
    """Similarities over 0 normalised within the query; equal weights if none is over 0."""
    over = Window.partitionBy(by)
    positive = F.greatest(similarity, F.lit(0.0))
    total = F.sum(positive).over(over)
    return F.when(total > 0, positive / total).otherwise(1.0 / F.count("*").over(over))


#: Right-closed similarity bins.
ERROR_BINS = (0.0, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 1.01)


def bin_table(spark, edges=ERROR_BINS) -> DataFrame:
    return spark.createDataFrame(list(zip(edges[:-1], edges[1:], strict=True)), "lo double, hi double")


def error_lookup(cases: DataFrame, bins: DataFrame, similarity: str = "similarity", error: str = "error") -> DataFrame:
    """(lo, hi, n, avg_error, error_std): cases by right-closed bin; sample SD; empty bins have n 0."""
    s = F.col(similarity)
    joined = F.broadcast(bins).join(cases, (s > F.col("lo")) & (s <= F.col("hi")), "left")
    return joined.groupBy("lo", "hi").agg(F.count(error).alias("n"), F.avg(error).alias("avg_error"), F.stddev_samp(error).alias("error_std"))


def expected_error(items: DataFrame, lookup: DataFrame, similarity: str, least: int = 10) -> DataFrame:
    """Items with expected_error, expected_error_std and expected_error_n; bins of fewer than ``least`` cases give nulls."""
    s = F.col(similarity)
    joined = items.join(F.broadcast(lookup), (s > F.col("lo")) & (s <= F.col("hi")), "left")
    enough = F.col("n") >= least
    return joined.select(
        *items.columns, F.when(enough, F.col("avg_error")).alias("expected_error"), F.when(enough, F.col("error_std")).alias("expected_error_std"), F.coalesce("n", F.lit(0)).alias("expected_error_n")
    )
