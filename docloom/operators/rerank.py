"""Feature reranking, tiered limits, and what is computed once for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.functions import rules
from docloom.functions.text import fold, keywords, token_set

#: Weights of shared keywords by field, and words too general for a heading.
OVERLAP = (("title", 3), ("section", 4), ("item", 4), ("subsection", 5), ("subsubsection", 6), ("metric", 6), ("table_name", 3), ("entity_name", 8))
GENERIC_HEADING_WORDS = ("could", "harm", "business", "may", "adversely", "affect")
EXECUTIVES = "executive officers and directors"
#: Columns of a candidate that the features read.
FIELDS = ("title", "section", "item", "subsection", "subsubsection", "content", "content_type", "table_name", "metric", "year", "entity_name")


def understood(questions: DataFrame) -> DataFrame:
    """``questions`` (query_id, question) with everything the answer side derives from it."""
    q = F.col("question")
    low = fold(q)
    bare = F.regexp_replace(low, r"""^[ ?."']+|[ ?."']+$""", "")
    base = questions.withColumns({
        "intent": rules.answer_intent(q), "words": keywords(q), "expected": rules.expected_items(q), "target": rules.entity_target(q), "low": low, "bare": bare,
        "heading": rules.risk_heading_reference(q),
    })
    heading_text = F.nullif(F.regexp_replace(F.trim(F.coalesce("heading", q)), r"^[?. ]+|[?. ]+$", ""), F.lit(""))
    return base.withColumns({
        "heading_text": F.when(F.col("intent") == "heading_lookup", heading_text),
        "specific": F.array_except(keywords(F.coalesce("heading", q)), F.array(*[F.lit(w) for w in GENERIC_HEADING_WORDS])),
        "years": F.regexp_extract_all(q, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)),
        "target_tokens": token_set(F.col("target")),
    })


def _any_in(words: Column, text: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: F.contains(fold(text), w)), F.lit(False))


def _in(value: str, items: str) -> Column:
    return F.coalesce(F.array_contains(items, F.col(value)), F.lit(False))


def big_properties_blob() -> Column:
    return F.coalesce((F.col("item") == rules.ITEM_2) & (F.length("content") > 350) & F.col("subsection").isNull(), F.lit(False))


def matches_target() -> Column:
    """All words of the person asked for are in the entity's name, or in the content."""
    has = F.size("target_tokens") > 0
    name, body = token_set(F.col("entity_name")), token_set(F.col("content"))
    inside = ((F.size(name) > 0) & (F.size(F.array_except("target_tokens", name)) == 0)) | (F.size(F.array_except("target_tokens", body)) == 0)
    return F.col("target").isNotNull() & has & inside


def _points(*terms: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, points in terms:
        total = total + F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    return total


def features(rows: DataFrame) -> DataFrame:
    """Add ``priority``, ``overlap``, ``bonus``, ``penalty``.

    ``rows``: candidates joined to their ``understood`` question.
    """
    intent, sub = F.col("intent"), F.col("subsection")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    is_ = lambda *names: intent.isin(*names)
    shared = lambda c: F.size(F.array_intersect("words", token_set(F.col(c))))
    overlap = F.when(has("year") & F.array_contains("words", F.lower("year")), 6).otherwise(0)
    for field, weight in OVERLAP:
        overlap = overlap + shared(field) * weight
    some = F.size("expected") > 0
    narrative = is_("narrative_explainer", "section_overview")
    sub_tokens = token_set(sub)
    specific = F.size(F.array_intersect("specific", sub_tokens))
    generic = F.size(F.array_intersect(F.array_except("words", "specific"), sub_tokens))
    executive = fold(F.concat_ws(" ", "section", "subsection", "table_name", "entity_name", F.left("content", F.lit(220))))
    heading, numeric, entity = is_("heading_lookup"), is_("numeric_table"), is_("entity_lookup")
    who_is, who_are = F.col("low").startswith("who is "), F.col("low").startswith("who are ")
    named = has("entity_name")
    exact_name = fold(F.col("entity_name")) == fold(F.col("target"))
    asks = lambda hints, *bare: F.arrays_overlap("words", F.array(*[F.lit(h) for h in hints])) | F.col("bare").isin(*bare)
    exact_sub = fold(sub) == F.col("low")
    bonus = _points(
        (some & _in("item", "expected"), 18),
        (is_("section_overview") & _in("section", "expected"), 12),
        (narrative & (F.col("item") == rules.ITEM_1) & sub.isin("General", "Consumers") & asks(rules.ANSWER_BUSINESS, "business", "item 1", "item 1 business"), 14),
        (narrative & (F.col("item") == rules.ITEM_3) & asks(rules.ANSWER_LEGAL, "legal proceedings", "item 3", "item 3 legal proceedings"), 20),
        (numeric & has("metric") & F.contains(F.col("low"), fold(F.col("metric"))), 6),
        (numeric & has("year") & F.contains(F.col("question"), F.col("year")), 6),
        (has("subsection") & _any_in(F.col("words"), sub), 3),
        (has("subsubsection") & _any_in(F.col("words"), F.col("subsubsection")), 5),
        (entity & F.contains(executive, F.lit(EXECUTIVES)), 20),
        (entity & named & _any_in(F.col("words"), F.col("entity_name")), 10),
        (entity & who_is & named & exact_name, 40),
        (entity & ~(who_is & named) & who_are & (F.col("content_type") == "profile_row"), 12),
        (heading & has("subsection") & F.contains(F.col("low"), fold(sub)), 25),
        (heading & has("subsection") & exact_sub, 50),
        (is_("narrative_explainer") & (F.col("item") == rules.ITEM_7), 10),
    ) + F.when(heading, specific * 12).otherwise(0)
    penalty = _points(
        (some & has("item") & ~_in("item", "expected"), 10),
        (is_("section_overview") & (F.col("content_type") == "table_row"), 8),
        (is_("narrative_explainer") & big_properties_blob() & ~_in("item", "expected"), 24),
        (numeric & (F.col("metric") == "Net sales") & has("year") & (F.col("year") != "2019") & F.contains(F.col("question"), F.lit("2019")), 20),
        (numeric & ~F.col("section").eqNullSafe(F.lit(rules.ITEM_6)), 15),
        (entity & who_is & named & F.col("target").isNotNull() & ~F.coalesce(exact_name, F.lit(False)) & ~matches_target(), 40),
        (entity & (F.col("content_type") == "table_row"), 10),
        (entity & (F.col("content_type") == "narrative") & ~named, 8),
        (heading & ~F.col("section").eqNullSafe(F.lit(rules.ITEM_1A)), 25),
        (heading & ~has("subsection"), 30),
        (heading & has("subsection") & ~exact_sub & ~F.contains(fold(sub), F.col("low")), 20),
        (heading & (F.size("specific") > 0) & (specific == 0), 35),
        (heading & (generic > 0) & (specific == 0), 20),
    )
    return rows.withColumns({"priority": rules.type_priority(intent, F.col("content_type")), "overlap": overlap, "bonus": bonus, "penalty": penalty})


def rerank(rows: DataFrame) -> DataFrame:
    """Add ``rank`` from 1 for each question; ties keep ``candidate_pos``.

    A question without keywords and intent keeps its candidates' order.
    """
    scored = features(rows)
    plain = (F.size("words") == 0) & (F.col("intent") == "general_lookup")
    keys = ("priority", F.col("bonus") + F.col("overlap") - F.col("penalty"), F.col("lexical_score") + F.col("vector_score"), "score", -F.col("penalty"))
    order = [F.when(plain, 0).otherwise(k if isinstance(k, Column) else F.col(k)).desc() for k in keys]
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order, F.col("candidate_pos"))))


def limit(rows: DataFrame) -> DataFrame:
    """Keep the first non-empty tier of each question, up to the tier's limit.

    ``rows``: reranked candidates.  Tiers are (condition on the row, limit) in order of
    preference; one window finds the first tier with any row, another ranks within it.
    """
    intent, kind = F.col("intent"), F.col("content_type")
    mine = W.partitionBy("query_id")
    some = lambda c: F.coalesce(c, F.lit(False))
    profile = kind.isin("profile_row", "profile_bio")
    item6 = (F.col("section") == rules.ITEM_6) & kind.isin("table_row", "table_block")
    exact_row = item6 & (kind == "table_row") & ((F.size("years") == 0) | F.array_contains("years", F.col("year"))) & F.arrays_overlap(token_set(F.col("metric")), F.col("words"))
    prose = kind.isin("narrative", "fact", "table_block")
    wants = lambda item: F.array_contains("expected", F.lit(item))
    there = {i: F.max(F.when(some(prose & (F.col("item") == i)), 1).otherwise(0)).over(mine) == 1 for i in (rules.ITEM_7A, rules.ITEM_8)}
    missing = (wants(rules.ITEM_7A) & ~there[rules.ITEM_7A]) | (wants(rules.ITEM_8) & ~there[rules.ITEM_8])
    in_item = prose & _in("item", "expected")
    any_item = F.max(F.when(some(in_item), 1).otherwise(0)).over(mine) == 1
    narrative = intent.isin("narrative_explainer", "section_overview")
    strict = wants(rules.ITEM_7A) | wants(rules.ITEM_8)
    most = F.when(intent == "section_overview", 6).otherwise(5)
    tiers = [
        ((intent == "entity_lookup") & profile & matches_target(), F.lit(4)),
        ((intent == "entity_lookup") & F.col("low").startswith("who are ") & (kind == "profile_row"), F.lit(8)),
        ((intent == "entity_lookup") & profile, F.lit(6)),
        (intent == "entity_lookup", F.lit(6)),
        ((intent == "heading_lookup") & (F.col("section") == rules.ITEM_1A) & (F.col("subsection") != ""), F.lit(4)),
        (intent == "heading_lookup", F.lit(4)),
        ((intent == "numeric_table") & exact_row, F.lit(4)),
        ((intent == "numeric_table") & F.contains(F.col("low"), F.lit("selected consolidated financial data")) & item6 & (kind == "table_block"), F.lit(2)),
        ((intent == "numeric_table") & item6, F.lit(5)),
        (intent == "numeric_table", F.lit(5)),
        (narrative & any_item & in_item & ~(missing & (F.col("item") == rules.ITEM_1A)), most),
        (narrative & any_item, F.lit(3)),
        (narrative & strict & prose & ~big_properties_blob() & ~F.col("item").eqNullSafe(F.lit(rules.ITEM_1A)), F.lit(3)),
        (narrative & ~strict & prose & ~big_properties_blob(), most),
        (narrative & ~strict & prose, most),
        (narrative & ~strict, most),
        (~intent.isin("entity_lookup", "heading_lookup", "numeric_table", "narrative_explainer", "section_overview"), F.lit(6)),
    ]
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c, _ in tiers])
    limits = F.array(*[most_.cast("int") for _, most_ in tiers])
    flagged = rows.withColumn("_f", flags).withColumn("_t", F.array_position("_f", F.lit(True)))
    best = flagged.withColumn("tier", F.min(F.when(F.col("_t") > 0, F.col("_t"))).over(mine)).where(F.expr("tier is not null and try_element_at(_f, cast(tier as int))"))
    placed = best.withColumn("_n", F.row_number().over(mine.orderBy("rank"))).where(F.col("_n") <= F.element_at(limits, F.col("tier").cast("int")))
    return placed.drop("_f", "_t").withColumnRenamed("_n", "place")
