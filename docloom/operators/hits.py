"""Search hits as chunks, source ids, the report of a question set, streamed model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What a hit without these fields gets, and how a model's stream looks.
DEFAULTS = {"doc_id": "", "title": "Untitled", "section": "", "source_path": "", "source_uri": ""}
DATA, DONE = "data:", "[DONE]"


def first_score(*scores: Column) -> Column:
    """The first score that is neither null nor 0; 0 without one."""
    return F.coalesce(*[F.when(s != 0, s.cast("double")) for s in scores], F.lit(0.0))


def normalized(hits: DataFrame) -> DataFrame:
    """Chunks of search hits: those with blank or null content go, absent fields get their
    defaults, ``score`` is the first of lexical, vector and hit score that is not 0.

    ``hits``: the chunk's columns with ``hit_id``, ``hit_score``, ``lexical_score`` and
    ``vector_score``; a chunk without an id takes the hit's.  Other columns are kept.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fields = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in hits.columns}
    fields |= {c: F.lit(v) for c, v in DEFAULTS.items() if c not in hits.columns}
    fields |= {"chunk_id": F.coalesce("chunk_id", "hit_id"), "lexical_score": zero("lexical_score"), "vector_score": zero("vector_score")}
    kept = hits.where(F.col("content").rlike(r"(?U)\S"))
    return kept.withColumn("score", first_score(F.col("lexical_score"), F.col("vector_score"), F.col("hit_score"))).withColumns(fields).drop("hit_id", "hit_score")


def source_ids(sources: DataFrame) -> DataFrame:
    """query_id, source_ids: the ids of a question's sources in their order (six at most,
    as ``citations`` gives them); empty ids are left out."""
    row = F.when(F.col("source_id") != "", F.struct("source_rank", F.col("source_id").cast("string").alias("id")))
    return sources.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["id"]).alias("source_ids"))


def report(questions: DataFrame, rows: DataFrame, said: DataFrame, sources: DataFrame) -> DataFrame:
    """A line of a benchmark report for each question: query_id, question, intent,
    retrieval_k, fallback, answer, and chunks and sources as JSON arrays.

    ``questions``: query_id, question, intent, top_k; ``rows``: limited candidates with
    ``place``; ``said`` and ``sources``: what ``answers`` and ``citations`` give.
    """
    four = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    plain = [c for c in ("section", "item", "subsection", "subsubsection", "content_type", "table_name", "metric", "year", "entity_name", "entity_role", "page_start", "page_end") if c in rows.columns]
    chunk = F.struct("place", "chunk_id", four("score"), four("lexical_score"), four("vector_score"), *plain, F.left("content", F.lit(260)).alias("content_preview"))
    chunks = rows.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(chunk))).alias("retrieved_chunks"))
    cited = sources.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("source_rank", "source_id", "title", "snippet")))).alias("final_sources"))
    lines = questions.join(said.select("query_id", "answer"), "query_id", "left").join(chunks, "query_id", "left").join(cited, "query_id", "left")
    return lines.select("query_id", "question", "intent", F.col("top_k").alias("retrieval_k"), F.col("final_sources").isNull().alias("fallback"), "answer",
                        F.coalesce("retrieved_chunks", F.lit("[]")).alias("retrieved_chunks"), F.coalesce("final_sources", F.lit("[]")).alias("final_sources"))


def stream_deltas(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """key, order, delta, error: the text pieces of streamed model responses.

    Only ``data:`` lines count, blank ones and the end mark don't.  A piece is a string, or
    a list of strings and text parts that are joined; empty pieces go.  From the first line
    that is no JSON a response yields nothing more than that error.
    """
    data = F.trim(F.substr(F.col(line), F.lit(len(DATA) + 1)))
    rows = lines.where(F.startswith(F.col(line), F.lit(DATA))).select(key, order, data.alias("_d")).where(~F.col("_d").isin("", DONE))
    parsed = rows.withColumn("_v", F.try_parse_json("_d"))
    first_bad = F.min(F.when(F.col("_v").isNull(), F.col(order))).over(W.partitionBy(key))
    upto = parsed.withColumn("_bad", first_bad).where(F.col("_bad").isNull() | (F.col(order) <= F.col("_bad")))
    said = upto.withColumn("_c", F.try_variant_get("_v", "$.choices[0].delta.content", "variant"))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    part = lambda x: F.when(is_text(x), F.try_variant_get(x, "$", "string")).when(F.try_variant_get(x, "$.type", "string") == "text", F.try_variant_get(x, "$.text", "string"))
    joined = F.array_join(F.transform(F.try_variant_get("_c", "$", "array<variant>"), part), "")
    delta = F.when(is_text(F.col("_c")), F.try_variant_get("_c", "$", "string")).when(F.startswith(F.schema_of_variant("_c"), F.lit("ARRAY")), joined)
    error = F.when(F.col("_v").isNull(), F.lit("invalid JSON"))
    return said.select(key, order, delta.alias("delta"), error.alias("error")).where("delta <> '' or error is not null")
