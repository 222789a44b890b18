"""Fusing lexical and vector candidates, and the gates around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WEAK_LEXICAL, WEAK_FUSED, MIN_SCORE = 3.0, 0.2, 0.1


def min_max(score: str) -> Column:
    """Per question to 0..1; without a range 1 if anything is positive, else 0."""
    mine = W.partitionBy("query_id")
    lo, hi = F.min(score).over(mine), F.max(score).over(mine)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).when(hi > 0, 1.0).otherwise(0.0)


def fuse(lexical: DataFrame, vector: DataFrame, profiles: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, lexical_score, vector_score, score.

    ``lexical`` and ``vector``: query_id, key, score; ``profiles``: query_id,
    lexical_weight, vector_weight.  A side that lacks a candidate counts as 0 before
    normalising.  One shuffle by question serves merging, normalising and weighting.
    """
    both = lexical.select("query_id", key, F.col("score").alias("l"), F.lit(0.0).alias("v")).unionByName(vector.select("query_id", key, F.lit(0.0).alias("l"), F.col("score").alias("v")))
    merged = both.groupBy("query_id", key).agg(F.max("l").alias("lexical_score"), F.max("v").alias("vector_score"))
    scaled = merged.withColumns({"_l": min_max("lexical_score"), "_v": min_max("vector_score")})
    weighed = scaled.join(profiles.select("query_id", "lexical_weight", "vector_weight"), "query_id")
    return weighed.select("query_id", key, "lexical_score", "vector_score", (F.col("_l") * F.col("lexical_weight") + F.col("_v") * F.col("vector_weight")).alias("score"))


def vector_gate(profiles: DataFrame, lexical: DataFrame) -> DataFrame:
    """query_id, run: whether a question's vector side runs.

    ``profiles``: query_id, vector_weight, vector_mode; ``lexical``: query_id, score and
    strong_entity (a leading profile that matches the person asked for).
    """
    found = lexical.groupBy("query_id").agg(F.max("score").alias("best"), F.bool_or("strong_entity").alias("strong"))
    rows = profiles.join(found, "query_id", "left")
    weak = F.col("best").isNull() | (~F.coalesce("strong", F.lit(False)) & (F.col("best") < WEAK_LEXICAL))
    run = F.when((F.col("vector_weight") <= 0) | (F.col("vector_mode") == "disabled"), False).when(F.col("vector_mode") == "weak_lexical_fallback", weak).otherwise(True)
    return rows.select("query_id", run.alias("run"))


def retry_gate(questions: DataFrame, fused: DataFrame) -> DataFrame:
    """query_id, retry: whether a rewritten question is tried.

    ``questions``: query_id, intent, item (routed, may be null); ``fused``: query_id,
    score, item, rank, heading_overlap (boolean).
    """
    found = fused.join(questions.select("query_id", F.col("item").alias("_item")), "query_id").groupBy("query_id").agg(
        F.max("score").alias("best"), F.bool_or((F.col("item") == "Item 1A. Risk Factors")).alias("risk"), F.bool_or((F.col("rank") <= 4) & F.col("heading_overlap")).alias("heading"),
        F.bool_or((F.col("rank") <= 4) & (F.col("item") == F.col("_item"))).alias("in4"), F.bool_or((F.col("rank") <= 6) & (F.col("item") == F.col("_item"))).alias("in6"),
    )
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = questions.join(found, "query_id", "left")
    retry = (
        F.when(F.col("best").isNull() | (F.col("best") < WEAK_FUSED), True)
        .when(F.col("intent") == "heading_lookup", no("risk") | no("heading"))
        .when((F.col("intent") == "section_overview") & F.col("item").isNotNull(), no("in6"))
        .when((F.col("intent") == "narrative_explainer") & F.col("item").isNotNull(), no("in4"))
        .otherwise(False)
    )
    return rows.select("query_id", retry.alias("retry"))
