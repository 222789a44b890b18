"""Questions to cited answers: routing, candidates, fusion, reranking, limits, answers.

All questions of a batch run in one plan; everything after candidate generation is
shuffled by question and holds at most a few dozen rows for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import rules
from docloom.functions.text import fold, token_set
from docloom.operators import answers as say, fusion, hits, index as postings, lexical, rerank, vector
from docloom.storage import materialize

#: Field boosts for all questions, and where an intent differs.
BOOSTS = {"title": 4, "section": 8, "item": 4, "subsection": 8, "subsubsection": 9, "table_name": 8, "metric": 6, "year": 5, "content": 4, "entity_name": 6, "entity_role": 4, "content_type": 3}
PHRASE_BOOSTS = {"title": 8, "section": 12, "item": 8, "subsection": 12, "subsubsection": 14, "table_name": 12, "metric": 10, "year": 8, "content": 6, "entity_name": 10, "entity_role": 6, "content_type": 4}
INTENT_BOOSTS = {
    "numeric_table": {"metric": 12, "table_name": 12, "year": 10},
    "entity_lookup": {"entity_name": 14, "entity_role": 10, "subsection": 10},
    "heading_lookup": {"subsection": 16, "subsubsection": 18, "section": 10},
    "section_overview": {"section": 14, "item": 14, "subsection": 14, "subsubsection": 12},
    "narrative_explainer": {"item": 10, "subsection": 12, "subsubsection": 14},
}
INTENT_PHRASE_BOOSTS = {"section_overview": {"section": 18, "item": 18, "subsection": 18, "subsubsection": 16}}
CANDIDATES, FUSED = 3, 2


def boost_table(spark, phrase: bool = False) -> DataFrame:
    """intent, field, boost (a table of fixed size)."""
    base, special = (PHRASE_BOOSTS, INTENT_PHRASE_BOOSTS) if phrase else (BOOSTS, INTENT_BOOSTS)
    rows = [(intent, f, float({**base, **special.get(intent, {})}[f])) for intent, *_ in rules.PROFILES for f in base]
    return spark.createDataFrame(rows, "intent string, field string, boost double")


def routed(questions: DataFrame) -> DataFrame:
    """``questions`` (query_id, question, top_k) with search intent, item, text, profile."""
    q = F.col("question")
    rows = questions.withColumns({"search_intent": rules.search_intent(q), "routed_item": rules.routed_item(q)})
    rows = rows.withColumn("text", rules.expansion(q, F.col("search_intent")))
    profiles = rules.profile_table(questions.sparkSession).withColumnRenamed("intent", "search_intent")
    return rows.join(F.broadcast(profiles), "search_intent", "left")


def exact_boosts(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score from exact field values a question's route asks for."""
    spark = chunks.sparkSession
    wanted = [(item, field, value, float(b)) for item, _, _, _, boosts in rules.ITEM_RULES for field, value, b in boosts]
    table = spark.createDataFrame(wanted, "routed_item string, field string, value string, boost double")
    asked = questions.join(F.broadcast(table), "routed_item").select("query_id", "field", "value", "boost")
    heading = F.coalesce(rules.risk_heading_reference(F.col("question")), F.col("question"))
    head = questions.where("search_intent = 'heading_lookup'").select("query_id", F.inline(F.array(
        *[F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(float(b)).alias("boost")) for f, v, b in (("item", F.lit(rules.ITEM_1A), 30), ("section", F.lit(rules.ITEM_1A), 30), ("subsection", heading, 60))])))
    over = questions.where("search_intent = 'section_overview' and routed_item is not null").select("query_id", F.inline(F.array(
        *[F.struct(F.lit(f).alias("field"), F.col("routed_item").alias("value"), F.lit(35.0).alias("boost")) for f in ("item", "section")])))
    cells = chunks.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("item", "section", "subsection")]))).where("value is not null and length(value) <= 256")
    return cells.join(asked.unionByName(head).unionByName(over), ["field", "value"]).groupBy("query_id", "chunk_id").agg(F.sum("boost").alias("score"))


def candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, rank: the 3k best by words, phrases and exact fields."""
    fields = {f: f for f in BOOSTS}
    n = chunks.count()
    # the questions' words are all that is looked up
    words = questions.select(F.explode(F.array_union(token_set(F.col("text")), token_set(F.col("question")))).alias("term"))
    index = materialize(postings.postings(chunks, "chunk_id", fields, words), "postings")
    means = postings.mean_lengths(chunks, fields)
    spark = chunks.sparkSession
    per_query = lambda phrase: questions.join(F.broadcast(boost_table(spark, phrase)), questions["search_intent"] == F.col("intent")).select("query_id", "field", "boost")
    words = lexical.best_fields(lexical.bm25(questions.select("query_id", "text"), index, n, "chunk_id", means), per_query(False), "chunk_id")
    found = postings.phrases(questions.select("query_id", F.col("question").alias("text")), index, 1, "chunk_id")
    phrase = found.join(per_query(True), ["query_id", "field"]).groupBy("query_id", "chunk_id").agg(F.max("boost").alias("score"))
    scores = words.unionByName(phrase).unionByName(exact_boosts(questions, chunks)).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    most = scores.join(questions.select("query_id", "top_k"), "query_id")
    return lexical.top(most, CANDIDATES * _widest(questions), "chunk_id").where(F.col("rank") <= CANDIDATES * F.col("top_k")).select("query_id", "chunk_id", "score", "rank")


def _widest(questions: DataFrame) -> int:
    """The largest top_k asked for: a literal bound lets ranks be cut before the shuffle."""
    return questions.agg(F.max("top_k")).first()[0] or 1


def _strong_entity() -> Column:
    """Whether a profile is the person asked for; any profile is if nobody is named, or
    several are asked for."""
    plain = lambda c: F.trim(F.regexp_replace(fold(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    asked, name = F.regexp_extract(plain("question"), r"^who is (.*)$", 1), F.coalesce(plain("entity_name"), F.lit(""))
    same = (name != "") & (F.contains(name, asked) | F.contains(asked, name))
    return F.col("content_type").isin("profile_row", "profile_bio") & ((asked == "") | plain("question").startswith("who are ") | same)


def heading_overlap() -> Column:
    """Whether a candidate's subsection has the heading asked for, or four words of it."""
    plain = lambda c: F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))
    asked, sub = plain(F.coalesce(rules.risk_heading_reference(F.col("question")), F.col("question"))), fold(F.col("subsection"))
    shared = F.size(F.array_intersect(token_set(asked), token_set(sub)))
    return F.coalesce((sub != "") & (F.contains(asked, sub) | F.contains(sub, asked) | (shared >= 4)), F.lit(False))


def _sides(asked: DataFrame, chunks: DataFrame, vectors: DataFrame | None, dimensions: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidates by words and by vectors (query_id, chunk_id, score) of routed questions."""
    found = materialize(candidates(asked, chunks), "lexical")
    if vectors is None:
        return found, chunks.sparkSession.createDataFrame([], "query_id long, chunk_id string, score double")
    people = found.where("rank <= 3").join(chunks.select("chunk_id", "content_type", "entity_name"), "chunk_id").join(asked.select("query_id", "question", "search_intent"), "query_id")
    people = people.select("query_id", "score", ((F.col("search_intent") == "entity_lookup") & _strong_entity()).alias("strong_entity"))
    best = found.select("query_id", "score", F.lit(False).alias("strong_entity"))
    open_ = fusion.vector_gate(asked.select("query_id", "vector_weight", "vector_mode"), people.unionByName(best)).where("run")
    # of questions about an item, only its rows take part in the top k
    scope = F.when(F.col("search_intent").isin("narrative_explainer", "section_overview"), F.col("routed_item"))
    sound = vectors if dimensions is None else vectors.where(F.size("embedding") == dimensions)
    top = vector.cosine_top(sound.join(open_, "query_id", "left_semi").join(asked.select("query_id", scope.alias("scope")), "query_id"), chunks.where("embedding is not null").withColumn("scope", F.col("item")), CANDIDATES * _widest(asked))
    near = top.join(chunks.select("vec_id", "chunk_id"), "vec_id").join(asked.select("query_id", "top_k"), "query_id").where(F.col("rank") <= CANDIDATES * F.col("top_k"))
    return found, near.select("query_id", "chunk_id", ((1 + F.col("score")) / 2).alias("score"))


def _fused(found: DataFrame, near: DataFrame, asked: DataFrame) -> DataFrame:
    """The 2k best of both sides: query_id, chunk_id, scores, rank."""
    best = lexical.top(fusion.fuse(found, near, asked), FUSED * _widest(asked), "chunk_id")
    return best.join(asked.select("query_id", "top_k"), "query_id").where(F.col("rank") <= FUSED * F.col("top_k")).drop("top_k")


def retried(asked: DataFrame, chunks: DataFrame, fused: DataFrame, rewrites: DataFrame) -> DataFrame:
    """The routed questions to try again, with usable rewrites in place of their words; they
    keep their intent and weights, and take the rewrite's item."""
    seen = fused.join(chunks.select("chunk_id", "item", "subsection"), "chunk_id").join(asked.select("query_id", "question"), "query_id")
    gate = fusion.retry_gate(asked.select("query_id", F.col("search_intent").alias("intent"), F.col("routed_item").alias("item")), seen.withColumn("heading_overlap", heading_overlap()))
    again = asked.join(gate.where("retry").select("query_id"), "query_id").join(rewrites.select("query_id", "rewrite"), "query_id")
    again = again.withColumn("question", rules.usable_rewrite(F.col("question"), F.col("rewrite"))).where("question is not null").drop("rewrite")
    return again.withColumns({"routed_item": rules.routed_item(F.col("question")), "text": rules.expansion(F.col("question"), F.col("search_intent"))})


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, rewrites: DataFrame | None = None, dimensions: int | None = None) -> DataFrame:
    """Reranked, limited candidates of each question, with all columns.

    ``chunks``: the index's columns; ``vectors``: query_id, embedding of the questions (the
    chunks then carry ``embedding`` and an id ``vec_id``); without them, or where they
    haven't ``dimensions`` components, words decide alone.  ``rewrites``: query_id, rewrite
    and, if the vectors are to be asked too, its embedding; questions that found too little
    are asked again by their rewrite, and both passes are fused.
    """
    asked = materialize(routed(questions), "routed")
    found, near = _sides(asked, chunks, vectors, dimensions)
    fused = _fused(found, near, asked)
    if rewrites is not None:
        fused = materialize(fused, "fused")
        again = materialize(retried(asked, chunks, fused, rewrites), "retried")
        by_vector = rewrites.select("query_id", "embedding") if vectors is not None and "embedding" in rewrites.columns else None
        found2, near2 = _sides(again, chunks, by_vector, dimensions)
        both = _fused(found.unionByName(found2), near.unionByName(near2), asked).join(again.select("query_id"), "query_id", "left_semi")
        fused = fused.join(again.select("query_id"), "query_id", "left_anti").unionByName(both)
    kept = fused.where(F.col("score") >= fusion.MIN_SCORE).withColumnRenamed("rank", "candidate_pos")
    known = [c for c in chunks.columns if c not in ("embedding", "vec_id")]
    rows = kept.join(chunks.select(*known), "chunk_id").join(rerank.understood(questions.select("query_id", "question")), "query_id")
    return rerank.limit(rerank.rerank(rows))


def capture(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The benchmark report of a question set (query_id, question): see ``hits.report``."""
    asked = questions.select("query_id", "question", rules.answer_intent(F.col("question")).alias("intent"), rules.answer_top_k(F.col("question")).alias("top_k"))
    rows = materialize(retrieve(asked.drop("intent"), chunks, vectors), "retrieved")
    said, cited = _said(asked, rows)
    return hits.report(asked, rows, said, cited)


def _said(questions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = say.answers(rerank.understood(questions.select("query_id", "question")), rows)
    return said, say.citations(rows).join(said.where("mode <> 'fallback_stream'").select("query_id"), "query_id", "left_semi")


def answer(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, rewrites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, citations) of all questions; a fallback cites nothing."""
    return _said(questions, materialize(retrieve(questions, chunks, vectors, rewrites), "retrieved"))
