"""Exact top-k search by tiled matrix products.

Queries are cut into blocks and rows into shards; a tile is the integer matrix product of
one block and one shard.  From each tile a partial selection keeps k rows for each query,
and the lists of a query are merged in a tree, ``FAN`` shards at a time, until one is
left.  No step needs more memory than a tile or ``FAN`` lists of a block.

Scores are inner products of floor(64 * x).  They are exact: a tile is multiplied in
float32 where every partial sum stays below 2**24, in float64 below 2**53, and else in
Python integers held to the range of a long.

Edge cases: a vector that is null, or holds null or non-finite components, takes no part,
nor does one without an id; of vectors of unequal length the missing components count as
0; ties go to the smaller id; a repeated id is one query (its smallest vector), and every
row with another id is a candidate of its own; with fewer candidates all are returned; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.storage import materialize, shuffle_width

#: Rows of a query block and of a shard, and lists merged at once.
BLOCK, SHARD, FAN = 2048, 8192, 16
_LISTS = "block int, shard int, query_id long, vec_id long, score long"


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors))
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    width = min(q.shape[1], c.shape[1])
    if not width:
        return np.zeros((len(q), len(c)), np.int64)
    q, c = q[:, :width], c[:, :width]
    most = np.abs(q).max() * np.abs(c).max() * width
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best of each row, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    if n > k:
        # the k-th best score of each row; all above it stay, of its ties the first ones
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above, tied = scores > floor, scores == floor
        room = k - above.sum(1, keepdims=True)
        keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
        return np.nonzero(keep)[1].reshape(len(scores), k)
    return np.broadcast_to(np.arange(n), (len(scores), n))


def _tile(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _LISTS.split(", ")})
        rows = rows.sort_values("vec_id", kind="stable")
        ids, c = rows["vec_id"].to_numpy(), _matrix(rows["v"])
        parts = []
        for at in range(0, len(queries), 256):  # a strip of the tile at a time
            some = queries.iloc[at : at + 256]
            own, scores = some["query_id"].to_numpy(), _products(_matrix(some["qv"]), c)
            # the query's own rows lie together; they are asked for besides and dropped
            extra = int((np.searchsorted(ids, own, "right") - np.searchsorted(ids, own)).max(initial=0))
            best = _select(scores, ids, k + extra)
            got, width = ids[best], best.shape[1]
            frame = pd.DataFrame({"query_id": np.repeat(own, width), "vec_id": got.ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})
            parts.append(_best(frame[frame["query_id"] != frame["vec_id"]], k))
        out = pd.concat(parts)
        return out.assign(block=key[0], shard=key[1])[[c.split()[0] for c in _LISTS.split(", ")]]

    return run


def _best(lists: pd.DataFrame, k: int) -> pd.DataFrame:
    order = np.lexsort((lists["vec_id"].to_numpy(), -lists["score"].to_numpy(), lists["query_id"].to_numpy()))
    sorted_ = lists.iloc[order]
    return sorted_[sorted_.groupby("query_id").cumcount() < k]


def _merge(k: int):
    return lambda lists: _best(lists, k)


def integers(column: str = "embedding") -> Column:
    """floor(64 * x) of each component as double; null where a vector takes no part."""
    cells = F.transform(column, lambda x: F.floor(x.cast("double") * 64).cast("double"))
    sound = ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & sound, cells)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` best other rows of every query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select("vec_id", integers().alias("v"), is_query.alias("q")).where("v is not null and vec_id is not null"), "topk-vectors")
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    queries = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    width = shuffle_width(spark)
    # each query meets each shard once and each row each block once: the tiles' inputs
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.pmod(F.hash("vec_id"), F.lit(blocks)).alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = (
        asked.repartition(width, "block", "shard").groupBy("block", "shard")
        .cogroup(held.select("block", "shard", "vec_id", "v").repartition(width, "block", "shard").groupBy("block", "shard"))
        .applyInPandas(_tile(k), _LISTS)
    )
    while shards > 1:  # a level of the tree
        shards = -(-shards // FAN)
        # sub-blocks spread a block's queries, so the last level keeps all cores busy
        level = lists.withColumns({"shard": F.expr(f"shard div {FAN}").cast("int"), "sub": F.pmod(F.hash("query_id"), F.lit(8))})
        lists = level.groupBy("block", "sub", "shard").applyInPandas(_merge(k), _LISTS + ", sub int").drop("sub")
    return lists.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("l")).select(
        "query_id", F.posexplode("l").alias("_r", "_x")
    ).select("query_id", (F.col("_r") + 1).cast("int").alias("rank"), "_x.vec_id", "_x.score")
