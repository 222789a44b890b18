"""BM25 by field over postings, boosted fields, top k.

Questions meet the postings (``index.postings``) on the term.  Postings are dealt by
their text and the questions' words sent to them, so a term that half of all texts contain
is no hot key, and a task sums the scores of ``TASK_ROWS`` texts, about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docloom.functions.text import tokens
from docloom.storage import shuffle_width

K1, B = 1.2, 0.75
#: Texts whose scores a task sums, and words of questions up to which they are broadcast.
TASK_ROWS, BROADCAST_ROWS = 4096, 100_000


def bm25(questions: DataFrame, index: DataFrame, n_rows: int, key: str = "doc_id", means: dict[str, float] | None = None) -> DataFrame:
    """query_id, key, field, score.  ``questions``: query_id, text; ``index``: postings;
    ``means``: mean lengths by field, for an index that holds only the questions' words."""
    wanted = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    # a row's tf add up to its dl, so mean lengths are sums by field; only terms asked for are counted
    lengths = index.groupBy("field").agg((F.sum("tf") / n_rows).alias("mean"))
    if means is not None:
        lengths = index.sparkSession.createDataFrame(list(means.items()), "field string, mean double")
    asked = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(lengths), "field").select("field", "term", idf.alias("idf"), "mean")
    # a question's words are a small table; postings are dealt by their rows, so many rows to a
    # task, where all questions' scores of a row are summed without another shuffle
    small = wanted.count() <= BROADCAST_ROWS
    weights = F.broadcast(weights) if small else weights
    wanted = F.broadcast(wanted) if small else wanted
    parts = max(shuffle_width(index.sparkSession), -(-n_rows // TASK_ROWS))
    met = asked.repartition(parts, key).join(weights, ["field", "term"])
    part = F.col("idf") * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return met.select(key, "field", "term", part.alias("part")).join(wanted, "term").groupBy("query_id", key, "field").agg(F.sum("part").alias("score"))


def best_fields(scores: DataFrame, boosts: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score: the best boosted field.  ``boosts``: query_id, field, boost."""
    return scores.join(boosts, ["query_id", "field"]).groupBy("query_id", key).agg(F.max(F.col("score") * F.col("boost")).alias("score"))


def top(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each question, ties to the smaller key; ``rank`` from 1."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)

