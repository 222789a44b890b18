"""Exact cosine top-k of many questions, in tiles of question blocks and row shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from docloom.functions.text import sound_vector
from docloom.storage import shuffle_width

#: Questions and rows of a tile.  Each row is sent to every block of questions, so blocks are
#: as large as a task can hold (8 MB of 64 components each); scores are made in strips.
BLOCK, SHARD = 16_384, 8192
#: Scores of a strip.
STRIP = 1 << 20


def _padded(vectors, size: int) -> np.ndarray:
    return np.stack([np.pad(x, (0, size - len(x))) for x in vectors])


def chosen(scores: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's scores are among its k best, ties to the left."""
    if scores.shape[1] <= k:
        return np.isfinite(scores)
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
    above, tied = scores > kth, scores == kth
    return np.isfinite(scores) & (above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def tile_of(k: int, scoped: bool):
    """The k best rows of a tile for each of its questions."""

    def tile(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(asked) and len(held):
            held = held.sort_values("row_id")
            ids, size = held["row_id"].to_numpy(), max(max(map(len, asked["q"])), max(map(len, held["v"])))
            rows = _padded(held["v"], size)
            lengths = np.linalg.norm(rows, axis=1)[None]
            strip = max(1, STRIP // len(held))
            for at in range(0, len(asked), strip):  # a strip of the tile at a time
                some = asked.iloc[at : at + strip]
                questions = _padded(some["q"], size)
                norms = np.linalg.norm(questions, axis=1)[:, None] * lengths
                scores = np.round(np.divide(questions @ rows.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
                if scoped:
                    own = some["q_scope"].to_numpy()[:, None] == held["scope"].to_numpy()[None]
                    scores = np.where(some["q_scope"].isna().to_numpy()[:, None] | own, scores, -np.inf)
                line, column = np.nonzero(chosen(scores, k))
                parts.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[line], "row_id": ids[column], "score": scores[line, column]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "row_id": [], "score": []})

    return tile


def cosine_top(questions: DataFrame, rows: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank.  Both sides: an id and ``embedding``; an optional
    ``scope`` column on both restricts a question to rows of its scope before the top k
    (a question whose scope is null takes all).

    Vectors that are null, too short or not numbers take no part; a zero vector scores 0.
    Scores are rounded to 9 places so that ties are ties on every machine.
    """
    scoped = "scope" in questions.columns
    width = shuffle_width(rows.sparkSession)
    scope = F.col("scope") if scoped else F.lit("")
    q = questions.select("query_id", sound_vector(F.col("embedding")).alias("q"), scope.alias("q_scope")).where("q is not null")
    r = rows.select(F.col(key).alias("row_id"), sound_vector(F.col("embedding")).alias("v"), scope.alias("scope")).where("v is not null")
    blocks, shards = max(1, -(-q.count() // BLOCK)), max(1, -(-r.count() // SHARD))
    left = q.withColumn("block", F.pmod(F.hash("query_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = r.withColumn("shard", F.pmod(F.hash("row_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    tile = tile_of(k, scoped)
    tiles = left.repartition(width, "block", "shard").groupBy("block", "shard").cogroup(right.repartition(width, "block", "shard").groupBy("block", "shard")).applyInPandas(tile, "query_id long, row_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("row_id").alias(key), "score", "rank")
