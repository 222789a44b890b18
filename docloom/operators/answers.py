"""Grounded answers and citations, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.functions import rules
from docloom.functions.text import clean_summary, first_sentence, fold, token_set

#: What is said, and how citations rank by type.
FALLBACK = "I do not have enough grounded context in the available documents to answer that confidently yet."
EXCERPTS = "Based on the Item 1A excerpts available in this 18-page filing extract"
EXCERPT = "Based on the limited Item 1A excerpt available in this 18-page filing extract"
ONLY_THEME = ", I can only summarize the risk theme that is actually present in the indexed material rather than all of Item 1A."
CROSS_REFERENCE = "The available context indicates there were legal proceedings, but it only provides a cross-reference to another section and does not include enough grounded detail to say more confidently."
SYSTEM_PROMPT = "You are a customer support knowledge assistant. Answer only from the provided context. If the context is insufficient, say that you do not have enough grounded context. Do not fabricate details."
NUMERIC_PROMPT = " Prefer exact numeric answers from structured table rows when available."
CITATION_RANK = {"table_row": 5, "profile_row": 5, "profile_bio": 4, "fact": 4, "table_block": 3, "narrative": 2}
MAX_SOURCES, MIN_HEADING_OVERLAP = 6, 4


def _has(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def is_cross_reference() -> Column:
    return F.lower(F.trim("content")).rlike(r"^(see item |see note |refer to )") & F.col("content_type").isin("narrative", "fact", "table_block")


def heading_overlap() -> Column:
    """How well a risk-factor row fits the heading asked for; 100 if it is that heading."""
    sub = fold(F.col("subsection"))
    usable = F.col("heading_text").isNotNull() & (F.col("section") == rules.ITEM_1A) & _has("subsection")
    return F.when(usable & (fold(F.col("heading_text")) == sub), 100).when(usable, F.size(F.array_intersect("specific", token_set(F.col("subsection"))))).otherwise(0)


def title() -> Column:
    """The citation's title by content type."""
    kind, joined = F.col("content_type"), lambda *c: F.concat_ws(" - ", *c)
    inferred = F.col("heading_text").isNotNull() & (F.col("section") == rules.ITEM_1A)
    return (
        F.when((kind == "table_row") & _has("metric") & _has("year"), F.concat("section", F.lit(" - "), "metric", F.lit(" ("), "year", F.lit(")")))
        .when((kind == "profile_row") & _has("entity_name"), F.concat(F.lit("Executive Officers and Directors - "), "entity_name"))
        .when((kind == "profile_bio") & _has("entity_name"), F.concat(F.lit("Executive Officers and Directors - "), "entity_name", F.lit(" - Biography")))
        .when((kind == "table_block") & _has("table_name") & _has("subsection"), joined("title", "section", "subsection"))
        .when((kind == "table_block") & _has("table_name"), joined("title", "table_name"))
        .when(_has("subsubsection"), joined("title", "section", F.coalesce("subsection", F.lit("None")), "subsubsection"))
        .when(_has("subsection"), joined("title", "section", "subsection"))
        .when(kind == "fact", joined("title", "section", F.lit("Fact")))
        .when(inferred, joined("title", "section", "heading_text"))
        .when(_has("section"), joined("title", "section"))
        .otherwise(F.col("title"))
    )


def snippet() -> Column:
    led = lambda head: F.left(F.concat(head, F.lit(": "), F.left("content", F.lit(180))), F.lit(220))
    return (
        F.when(F.col("content_type").isin("table_row", "profile_row", "profile_bio", "fact"), F.left("content", F.lit(220)))
        .when(_has("subsubsection"), led(F.col("subsubsection")))
        .when(_has("subsection"), led(F.col("subsection")))
        .when(F.col("heading_text").isNotNull() & (F.col("section") == rules.ITEM_1A), led(F.col("heading_text")))
        .otherwise(F.left("content", F.lit(220)))
    )


def _key(*columns) -> Column:
    return F.concat_ws(":", *[F.coalesce(c if isinstance(c, Column) else F.col(c).cast("string"), F.lit("None")) for c in columns])


def semantic_key() -> Column:
    kind = F.col("content_type")
    return (
        F.when(kind == "table_row", _key("doc_id", "content_type", "subsection", "metric", "year"))
        .when(kind.isin("profile_row", "profile_bio"), _key("doc_id", "content_type", "entity_name"))
        .when(kind == "table_block", _key("doc_id", "content_type", "section", "subsection", "table_name"))
        .when(kind == "fact", _key("doc_id", "content_type", "section", "subsection", "subsubsection", F.left("content", F.lit(80))))
        .otherwise(_key("doc_id", "content_type", "section", "subsection", "subsubsection"))
    )


def citations(rows: DataFrame) -> DataFrame:
    """Up to six sources of each question, best first.

    ``rows``: limited candidates with their question's columns and ``place``.  The greedy
    choice is a fold: a row is taken unless its semantic key was taken, or it is a narrative
    whose place in the document was.  Only rows that can be chosen reach the fold, however
    many there are: with six sources at most six keys of each sort are taken, so the seventh
    row of a key is never chosen, and at most (6 + 6) * 7 rows are passed over.
    """
    rank = F.lit(1)
    for kind, value in CITATION_RANK.items():
        rank = F.when(F.col("content_type") == kind, value).otherwise(rank)
    fit = rows.withColumn("_o", heading_overlap())
    fit = fit.join(fit.groupBy("query_id").agg(F.max("_o").alias("_best")), "query_id")
    heading = F.col("intent") == "heading_lookup"
    kept = fit.where(~(heading & (F.col("_best") < MIN_HEADING_OVERLAP)) & (~heading | (F.col("_best") == 0) | (F.col("_o") == F.col("_best"))))
    row = F.struct((-rank).alias("r"), (-F.col("score")).alias("s"), F.col("place").alias("p"), F.col("chunk_id").alias("id"), semantic_key().alias("semantic"), _key("doc_id", "section", "item", "subsection", "subsubsection").alias("diverse"), (F.col("content_type") == "narrative").alias("prose"))
    seven, most = MAX_SOURCES + 1, 2 * MAX_SOURCES * (MAX_SOURCES + 1) + MAX_SOURCES
    able = kept.select("query_id", row.alias("row")).groupBy("query_id", "row.semantic", "row.diverse", "row.prose").agg(F.min("row").alias("row"))
    nth = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy("row"))
    able = able.withColumn("_n", nth("semantic")).where(F.col("_n") <= seven).withColumn("_n", nth("diverse", "prose")).where(~F.col("prose") | (F.col("_n") <= seven))
    able = able.withColumn("_n", nth()).where(F.col("_n") <= most)
    lists = able.groupBy("query_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    empty = F.array().cast("array<string>")

    def take(state: Column, x: Column) -> Column:
        taken = F.array_contains(state["semantic"], x["semantic"]) | (x["prose"] & F.array_contains(state["diverse"], x["diverse"])) | (F.size(state["ids"]) >= MAX_SOURCES)
        grown = F.struct(F.concat(state["ids"], F.array(x["id"])).alias("ids"), F.concat(state["semantic"], F.array(x["semantic"])).alias("semantic"), F.concat(state["diverse"], F.array(x["diverse"])).alias("diverse"))
        return F.when(taken, state).otherwise(grown)

    chosen = F.aggregate("rows", F.struct(empty.alias("ids"), empty.alias("semantic"), empty.alias("diverse")), take, lambda s: s["ids"])
    order = lists.select("query_id", F.posexplode(chosen).alias("at", "chunk_id"))
    return kept.join(order, ["query_id", "chunk_id"]).select(
        "query_id", (F.col("at") + 1).alias("source_rank"), F.col("chunk_id").alias("source_id"), title().alias("title"), snippet().alias("snippet"),
        "content_type", "item", "subsection", "page_start", "page_end", "entity_name", "metric", "year", "table_name",
    )


def source_line() -> Column:
    """``- title [item | subsection | pp. a-b | metric (year)]: snippet``."""
    pages = F.when((F.col("page_start") > 0) & (F.col("page_end") > 0), F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("pp. "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))))
    figure = F.when(_has("metric") & _has("year"), F.concat("metric", F.lit(" ("), "year", F.lit(")"))).when(_has("metric"), F.col("metric")).when(_has("year"), F.col("year"))
    details = F.concat_ws(" | ", F.when(_has("item"), F.col("item")), F.when(_has("subsection"), F.col("subsection")), pages, figure)
    return F.concat(F.lit("- "), "title", F.when(details != "", F.concat(F.lit(" ["), details, F.lit("]"))).otherwise(""), F.lit(": "), "snippet")


def answers(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, answer, mode: deterministic answers, else summaries, else the fallback.

    ``questions``: ``understood``; ``rows``: limited candidates of them.
    """
    words_in = F.arrays_overlap(token_set(F.col("metric")), F.col("words"))
    exact = (F.col("content_type") == "table_row") & _has("metric") & _has("year") & words_in & F.contains(F.col("question"), F.col("year"))
    figure = F.concat("metric", F.lit(" in "), "year", F.lit(" were **"), "value_raw", F.when(_has("unit"), F.concat(F.lit(" "), "unit")).otherwise(""), F.lit("**."))
    risk_sub = F.when((F.col("item") == rules.ITEM_1A) & _has("subsection"), F.col("subsection"))
    facts = rows.groupBy("query_id").agg(
        F.count_if(exact).alias("exact"), F.max(F.when(exact, figure)).alias("figure"), F.max(heading_overlap()).alias("overlap"),
        F.sort_array(F.collect_set(risk_sub)).alias("subs"), F.bool_or(F.coalesce(F.array_contains("expected", F.col("item")), F.lit(False))).alias("covered"),
        F.min_by(is_cross_reference(), "place").alias("cross"), F.count("*").alias("n"),
    )
    found = questions.join(facts, "query_id", "left").join(summaries(rows), "query_id", "left")
    narrative = F.col("intent").isin("narrative_explainer", "section_overview")
    only = lambda item: (F.size("expected") == 1) & (F.col("expected")[0] == item)
    listed = F.array_join(F.transform(F.slice("subs", 1, 3), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    unseen = F.concat(F.lit("I do not see **"), F.coalesce("heading_text", F.lit("that specific risk heading")), F.lit("** in the available excerpts from Item 1A in this 18-page filing extract."),
                      F.when(F.size("subs") > 0, F.concat(F.lit(" The indexed Item 1A coverage here is limited to subsection(s) such as "), listed, F.lit("."))).otherwise(""))
    has_rows = F.coalesce(F.col("n"), F.lit(0)) > 0
    fixed = (
        F.when((F.col("intent") == "numeric_table") & (F.col("exact") == 1), F.col("figure"))
        .when((F.col("intent") == "heading_lookup") & (F.col("overlap") < MIN_HEADING_OVERLAP), unseen)
        .when(narrative & has_rows & (F.size("expected") > 0) & ~F.col("covered"), FALLBACK)
        .when(narrative & has_rows & only(rules.ITEM_1A) & (F.size("subs") < 2), F.concat(F.lit(EXCERPT), F.lit(ONLY_THEME)))
        .when(narrative & has_rows & only(rules.ITEM_3) & F.col("cross"), CROSS_REFERENCE)
    )
    fixed = F.when(~has_rows, FALLBACK).otherwise(fixed)
    lead = F.when(only(rules.ITEM_1A), F.concat(F.when(F.size("subs") >= 2, EXCERPTS).otherwise(EXCERPT), F.lit(", these are the supported themes I can ground:\n"))).when(
        (F.col("intent") == "section_overview") & (F.col("themes") == 1), F.concat(F.lit("Based on available context in "), "lead_item", F.lit(", this is the grounded section summary I can provide:\n"))
    ).when(F.col("intent") == "section_overview", F.concat(F.lit("Based on available context in "), "lead_item", F.lit(", these are the grounded themes I can provide:\n"))).otherwise(
        F.concat(F.lit("The available context in "), "lead_item", F.lit(" highlights these supported themes:\n"))
    )
    least = F.when(F.col("intent") == "section_overview", 1).otherwise(2)
    summary = F.when(narrative & (F.col("themes") >= least), F.concat(lead, "bullets"))
    answer = F.coalesce(fixed, summary, F.lit(FALLBACK))
    mode = F.when(answer == FALLBACK, "fallback_stream").otherwise("deterministic_stream")
    return found.select("query_id", answer.alias("answer"), mode.alias("mode"))


def summaries(rows: DataFrame) -> DataFrame:
    """query_id, lead_item, themes, bullets: the best row of each of up to four themes."""
    usable = F.col("content_type").isin("narrative", "fact") & ~is_cross_reference() & ((F.size("expected") == 0) | F.coalesce(F.array_contains("expected", F.col("item")), F.lit(False)))
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("subsection", "subsubsection", "section", "title")])
    labelled = rows.where(usable).withColumn("label", label)
    first = labelled.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "label").orderBy(F.col("score").desc(), "place"))).where("_n = 1")
    top = first.withColumn("_t", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "place"))).where("_t <= 4")
    text = first_sentence(clean_summary(F.col("content")))
    line = F.when(text != "", F.concat(F.lit("- "), "label", F.lit(": "), text))
    return top.groupBy("query_id").agg(
        F.min_by(F.coalesce(F.nullif("item", F.lit("")), F.nullif("section", F.lit("")), F.lit("the filing")), "_t").alias("lead_item"),
        F.count(line).alias("themes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_t", line.alias("line")))), lambda x: x["line"]), "\n").alias("bullets"),
    )


def context(rows: DataFrame) -> DataFrame:
    """query_id, context: the limited candidates as labelled blocks, in order."""
    line = lambda name, c: F.when(_has(c), F.concat(F.lit(f"{name}: "), F.col(c)))
    score = lambda name, c: F.when(F.col(c) != 0, F.format_string(f"{name}: %.4f", F.col(c)))
    pages = F.when((F.col("page_start") > 0) & (F.col("page_end") > 0), F.concat(F.lit("Pages: "), F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Source "), F.col("place").cast("string"), F.lit(":")), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Section: "), F.coalesce(F.nullif("section", F.lit("")), F.lit("General"))),
        line("Item", "item"), line("Subsection", "subsection"), line("Subsubsection", "subsubsection"), pages, line("Content Type", "content_type"), score("Lexical Score", "lexical_score"), score("Vector Score", "vector_score"),
        line("Table", "table_name"), line("Metric", "metric"), line("Year", "year"), line("Value", "value_raw"), line("Unit", "unit"), F.concat(F.lit("Content: "), "content"),
    )
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def messages(question: Column, context_: Column) -> Column:
    """The prompt of a text generator: system and user message."""
    system = F.concat(F.lit(SYSTEM_PROMPT), F.when(rules.is_numeric_question(question), NUMERIC_PROMPT).otherwise(""))
    user = F.concat(F.lit("Answer the question using only the provided context. If the context is insufficient, say that you do not have enough grounded context.\n\nQuestion: "), question, F.lit("\n\nContext:\n"), context_)
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
