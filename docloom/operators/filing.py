"""Structured filings: page lines to typed blocks (native).

A filing's lines keep a total order; headings open islands (a running count of heading
flags), and everything below is one row for each line or island.  Per-document windows
are as large as one filing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.functions import rules
from docloom.functions.text import collapse, content_id, fold, let, number
from docloom.storage import materialize

# --- Fixed values: titles, headings, patterns and units of the filing ---------------------
TITLES = {
    "Item 1.": "Business", "Item 1A.": "Risk Factors", "Item 1B.": "Unresolved Staff Comments", "Item 2.": "Properties", "Item 3.": "Legal Proceedings", "Item 4.": "Mine Safety Disclosures",
    "Item 5.": "Market for the Registrant's Common Stock, Related Shareholder Matters, and Issuer Purchases of Equity Securities", "Item 6.": "Selected Consolidated Financial Data",
    "Item 7.": "Management's Discussion and Analysis of Financial Condition and Results of Operations", "Item 7A.": "Quantitative and Qualitative Disclosures About Market Risk",
    "Item 8.": "Financial Statements and Supplementary Data", "Item 9.": "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure", "Item 9A.": "Controls and Procedures", "Item 9B.": "Other Information",
}
RUN_ON = (
    (r"(?i)\bPART\s+IItem\b", "PART I Item"), (r"(?i)\bPART\s+IIItem\b", "PART II Item"), (r"(?i)\bItem\s+(\d+[A-Z]?)\.([A-Z])", "Item $1. $2"),
    (r"\bGeneralWe\b", "General We"), (r"\bConsumersWe\b", "Consumers We"), (r"\bSellersWe\b", "Sellers We"), (r"\bDevelopers and EnterprisesWe\b", "Developers and Enterprises We"),
    (r"\bContent CreatorsWe\b", "Content Creators We"), (r"\bCompetitionOur\b", "Competition Our"), (r"\bIntellectual PropertyWe\b", "Intellectual Property We"), (r"\bSeasonalityOur\b", "Seasonality Our"),
    (r"\bEmployeesWe\b", "Employees We"), (r"\bAvailable InformationOur\b", "Available Information Our"), (r"\bExecutive Officers and DirectorsThe\b", "Executive Officers and Directors The"), (r"\bBoard of DirectorsName\b", "Board of Directors Name"),
)
#: Where the glued words of ``RUN_ON`` (but its first three) come apart.
_GLUED = "(?<=[a-z])(?=(?:We|Our|The|Name)\\b)(?:" + "|".join(rf"(?<=\b{r.rsplit(' ', 1)[0]})(?={r.rsplit(' ', 1)[1]}\b)" for _, r in RUN_ON[3:]) + ")"
RUN_ON_HEADINGS = ("General", "Consumers", "Sellers", "Developers and Enterprises", "Content Creators", "Competition", "Intellectual Property", "Seasonality", "Employees", "Available Information", "Executive Officers and Directors", "Board of Directors")
HINTS = {
    rules.ITEM_1: ("general", "overview", "our business", "consumers", "sellers", "developers and enterprises", "content creators", "amazon web services", "competition", "human capital", "employees", "seasonality", "available information"),
    rules.ITEM_2: ("properties", "facilities", "headquarters", "offices", "fulfillment centers", "data centers"),
    rules.ITEM_3: ("legal proceedings", "litigation", "proceedings"),
    rules.ITEM_7A: ("market risk", "interest rate risk", "foreign exchange risk", "foreign currency risk", "equity investment risk"),
}
NOT_HEADINGS = ("see accompanying notes", "table of contents", "index", "form 10-k")
MDA_HEADINGS = ("Results of Operations", "Liquidity and Capital Resources", "Critical Accounting Policies", "Overview")
UNITS = {"Net sales": "million USD", "Operating income": "million USD", "Net income": "million USD", "Total assets": "million USD", "Basic earnings per share": "USD/share", "Diluted earnings per share": "USD/share"}
FACTS = r"(?i)\b(we serve|we operate|we own|we lease|we maintain|our business focuses on|we focus on|material legal proceedings|ordinary course of business|not currently a party|from time to time|market risk|interest rate risk|foreign exchange risk|foreign currency risk|equity investment risk)\b"
FRONT_MATTER = ("available information", "investor relations", "executive officers and directors", "seattle, washington")
STATEMENTS = r"(?i)^(Consolidated|Notes to Consolidated|Report of Independent Registered Public Accounting Firm|Financial Statements and Supplementary Data)"
HEADER_FOOTER = r"(?i)^([A-Z.]+\.COM,\s*INC\.?|FORM\s+10-K|Page\s+\d+|\d+)$"
TOC_LINE = r"(?i)^(INDEX|TABLE OF CONTENTS|PART\s+[IVX]+|Item\s+\d+[A-Z]?\.|\d+\s*|[A-Za-z].+\.{2,}\s*\d+)$"
FIGURE = r"(\(?\$?[\d,]+(?:\.\d+)?\)?)"
ITEM_6_METRICS = r"(?i)(Net sales|Operating income|Net income \(loss\)|Basic earnings per share(?: \(2\))?|Diluted earnings per share(?: \(2\))?|Basic|Diluted|Total assets|Total long-term obligations)"
ITEM_6_YEARS = ("2015", "2016", "2017", "2018", "2019")
BODY_START = r"^(Our|We|If|This) "
RISK_ENDING = "(?:Could Harm Our Business|May Harm Our Business|May Adversely Affect Our Business|Could Adversely Affect Our Business|Could Negatively Affect Our Business)"
_RISK_WORDS = r"[A-Z][A-Za-z0-9,;:'’\-()&/ ]+?"
RISK_OPENED = rf"(?:Risks Related to {_RISK_WORDS}|We Are Subject to {_RISK_WORDS}|We Face {_RISK_WORDS}|Our {_RISK_WORDS} Risks?)"
RISK_TITLE = rf"(?:{_RISK_WORDS}{RISK_ENDING}|{RISK_OPENED[3:]}"
RISK_BODY = r"(?:Our|We|This|If)\s+[a-z][A-Za-z0-9'’\-]*"
# -----------------------------------------------------------------------------------------


def is_toc_line(line: Column) -> Column:
    return let(collapse(line), lambda text: (text != "") & (text.rlike(TOC_LINE) | F.contains(text, F.lit(". .")) | text.rlike(r"\.{3,}\s*\d+$")))


def clean_line(line: Column) -> Column:
    """A page line without headers, footers and decoration; null if nothing is left."""
    headed = lambda text: F.when(F.upper(F.left(text, F.lit(40))).startswith("TABLE OF CONTENTS"), F.trim(F.substring(text, F.lit(18), F.length(text)))).otherwise(text)
    kept = lambda text: F.when((text != "") & ~text.rlike(HEADER_FOOTER) & text.rlike(r"[\p{L}\p{N}]"), text)
    return let(let(collapse(line), headed), kept)


def content_pages(pages: DataFrame) -> DataFrame:
    """Drop index pages.  ``pages``: doc_id, page_no, lines array<string>."""
    # an index page has at most two lines besides those of a table of contents
    listed = lambda toc: (F.size(F.filter(toc, lambda x: x)) >= 4) & (F.size(F.filter(toc, lambda x: ~x)) <= 2)
    told = lambda text: F.contains(text, F.lit("TABLE OF CONTENTS")) | (F.contains(text, F.lit("INDEX")) & F.contains(text, F.lit("ITEM 1.")) & F.contains(text, F.lit("PART I")))
    headed = F.exists("lines", lambda x: F.upper(x).isin("INDEX", "TABLE OF CONTENTS")) | let(F.upper(F.array_join("lines", " ")), told)
    return pages.where(~(headed | let(F.transform("lines", is_toc_line), listed)))


def _parts_of(line: Column) -> Column:
    """A cleaned line cut at the headings inside it."""
    known = "|".join(map(re.escape, RUN_ON_HEADINGS))
    glued = lambda text: F.regexp_replace(text, _GLUED, " ")

    def items(text: Column) -> Column:
        for pattern, replacement in RUN_ON[:3]:
            text = F.regexp_replace(text, pattern, replacement)
        return F.split(glued(text), r"(?i)(?<=\S)\s*(?=(?:PART\s+[IVX]+\s+)?(?<!PART I )(?<!PART II )Item\s+\d+[A-Z]?\.)")

    # most lines name no item, and need no search for one at each of their places
    cut = let(line, lambda text: F.when(text.rlike("(?i)item"), items(text)).otherwise(F.array(glued(text))))
    cut = F.flatten(F.transform(cut, lambda p: F.split(p, rf"(?<=\S)\s+(?=\b(?:{known})\b\s*\S)")))
    return F.filter(F.transform(cut, collapse), lambda p: p != "")


def ordered_lines(pages: DataFrame) -> DataFrame:
    """doc_id, line_no, page_no, text: cleaned lines, glued headings apart, in order."""
    # a line is cleaned and cut inside the generator; a plain column would be again in every use
    cut = lambda line: let(clean_line(line), lambda text: F.when(text.isNotNull(), _parts_of(text)))
    rows = pages.select("doc_id", "page_no", F.posexplode(F.transform("lines", cut)).alias("at", "parts"))
    cut = rows.select("doc_id", "page_no", "at", F.posexplode("parts").alias("part", "text"))
    return cut.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "at", "part"))).drop("at", "part")


def item_heading(text: Column) -> Column:
    """(item, remainder) of a line that opens an item, else null."""
    number_, rest = F.regexp_extract(text, r"(?i)^(Item\s+\d+[A-Z]?\.)(.*)$", 1), F.trim(F.regexp_extract(text, r"(?i)^(Item\s+\d+[A-Z]?\.)(.*)$", 2))
    prefix = F.concat(F.lit("Item "), F.upper(F.regexp_extract(number_, r"(?i)Item\s+(.*)", 1)))
    return F.when(number_ != "", let(F.struct(prefix.alias("prefix"), rest.alias("rest")), _titled_item))


def _titled_item(x: Column) -> Column:
    prefix, rest = x["prefix"], x["rest"]
    titles = F.create_map(*[F.lit(v) for pair in TITLES.items() for v in pair])
    tail = r"(?i)^([A-Za-z][A-Za-z ,’'\-()&/]+?)(?:\s{2,}|\s+The following|\s+This |\s+Our |\s+We |\s+Year Ended|\s+December 31,|$)(.*)$"
    glued = lambda c: F.replace(fold(c), F.lit(" "), F.lit(""))

    def split(title: Column) -> Column:
        known = F.coalesce(glued(rest).startswith(glued(title)), F.lit(False))
        name = F.when(known, title).otherwise(F.coalesce(F.nullif(F.trim(F.regexp_extract(rest, tail, 1)), F.lit("")), rest))
        remainder = F.when(known, F.trim(F.substring(rest, F.length(title) + 1, F.length(rest)))).otherwise(F.trim(F.regexp_extract(rest, tail, 2)))
        return F.struct(F.trim(F.concat_ws(" ", prefix, name)).alias("item"), remainder.alias("remainder"))

    return let(F.try_element_at(titles, prefix), split)


def skeleton(lines: DataFrame) -> DataFrame:
    """Lines with ``block_id``, ``part``, ``item``, ``label``; heading lines only as far as
    text follows in them.  Headings without a body leave no line and so no block."""
    part = F.upper(F.regexp_extract("text", r"(?i)^PART\s+([IVX]+)\b", 1))
    flagged = lines.withColumns({"_part": F.when(part != "", F.concat(F.lit("PART "), part)), "_item": item_heading(F.col("text"))})
    flagged = flagged.withColumn("_item", F.when(F.col("_part").isNull(), F.col("_item")))
    mine = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    opens = F.when(F.col("_part").isNotNull() | F.col("_item").isNotNull(), 1).otherwise(0)
    blocks = flagged.withColumns({"block_id": F.sum(opens).over(mine), "part": F.last("_part", True).over(mine), "_open": opens})
    inside = W.partitionBy("doc_id", "block_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    named = blocks.withColumns({"item": F.last("_item.item", True).over(inside), "_by_part": F.max("_part").over(inside)})
    named = named.withColumn("label", F.coalesce("item", "_by_part", F.lit("Overview")))
    body = F.when(F.col("_open") == 0, F.col("text")).when(F.col("_item").isNotNull(), F.nullif(F.col("_item.remainder"), F.lit("")))
    return named.withColumn("text", body).where("text is not null").select("doc_id", "block_id", "line_no", "page_no", "part", "item", "label", "text")


def is_table_line(line: Column) -> Column:
    row = rf"(?i)^[A-Za-z][A-Za-z0-9 ,.'’\-()&/]+?\s+{FIGURE}\s+{FIGURE}\s+{FIGURE}"
    years = r"2015\s+2016\s+2017\s+(?:\(\d+\)\s+)?2018\s+2019|2019\s+2018\s+2017\s+2016\s+2015"
    return let(collapse(line), lambda text: (text != "") & (text.rlike(years) | text.rlike(r"^20\d{2}(?:\s+20\d{2}){2,}$") | text.rlike(r"(?i)\(in\s+millions(?:,\s*except\s+per\s+share\s+data)?\)") | text.rlike(row)))


def is_heading(line: Column, hints: Column | None = None) -> Column:
    """A heading: a closing colon, a hint, or capitals in all words but one."""
    return let(collapse(line), lambda text: let(F.split(text, " "), lambda words: _is_heading(text, words, hints)))


def _is_heading(text: Column, words: Column, hints: Column | None) -> Column:
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    hinted = F.coalesce(F.array_contains(hints, fold(text)), F.lit(False)) if hints is not None else F.lit(False)
    refused = (F.size(words) > 12) | text.endswith(".") | (text.rlike(r"\b(2015|2016|2017|2018|2019)\b") & (F.size(words) > 4)) | is_table_line(text)
    return F.when((text == "") | fold(text).isin(*NOT_HEADINGS), False).when(text.endswith(":"), True).when(refused, False).otherwise(hinted | (capital >= F.greatest(F.lit(1), F.size(words) - 1)))


def is_mda_heading(line: Column) -> Column:
    words = F.split(line, " ")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return line.isin(*MDA_HEADINGS) | (F.size(words).between(2, 12) & (capital >= F.greatest(F.lit(2), F.size(words) - 1)) & ~line.rlike(r"\b(2015|2016|2017|2018|2019)\b"))


def sections(lines: DataFrame, heading: Column, keep_front: bool = True, inline: Column | None = None) -> DataFrame:
    """Islands between headings: doc_id, block_id, subsection, content, page_start, page_end.

    ``heading`` flags heading lines; ``inline`` may give (heading, body) of lines that have
    both.  ``keep_front`` keeps what stands before the first heading.  Headings without
    text below them leave nothing.
    """
    both = inline if inline is not None else F.lit(None).cast("struct<heading:string,body:string>")
    flagged = lines.withColumn("_in", both).withColumn("_h", F.when(F.col("_in").isNotNull(), F.col("_in.heading")).when(heading, F.col("text")))
    mine = W.partitionBy("doc_id", "block_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    islands = flagged.withColumns({"_s": F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(mine), "_head": F.last("_h", True).over(mine)})
    body = islands.withColumn("_b", F.when(F.col("_in").isNotNull(), F.col("_in.body")).when(F.col("_h").isNull(), F.col("text"))).where("_b is not null")
    if not keep_front:
        body = body.where("_head is not null")
    grouped = body.groupBy("doc_id", "block_id", "part", "item", "label", "_s").agg(
        F.first("_head").alias("subsection"), F.sort_array(F.collect_list(F.struct("line_no", "_b"))).alias("l"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end")
    )
    return grouped.select("doc_id", "block_id", "part", "item", "label", F.regexp_replace("subsection", ":+$", "").alias("subsection"), F.transform("l", lambda x: x["_b"]).alias("lines"), "page_start", "page_end")


def inline_heading(hints: dict[str, tuple]) -> Column:
    """(heading, body) where a line begins with a hint of its item, the longest first."""
    words = F.create_map(*[x for item, some in hints.items() for x in (F.lit(item), F.array(*[F.lit(h) for h in sorted(some, key=len, reverse=True)]))])

    def split(text: Column) -> Column:
        rest = lambda hint: F.trim(F.substring(text, F.length(hint) + 1, F.length(text)))
        begun = let(fold(text), lambda low: F.filter(F.try_element_at(words, F.col("item")), lambda h: low.startswith(F.concat(h, F.lit(" "))) & (rest(h) != "")))
        made = lambda hint: F.struct(F.left(text, F.length(hint)).alias("heading"), rest(hint).alias("body"))
        return let(F.get(begun, F.lit(0)), lambda hint: F.when(hint.isNotNull() & ~is_table_line(text), made(hint)))

    return F.when(F.col("item").isin(*hints), let(collapse(F.col("text")), split))


def facts(rows: DataFrame, phrases: str = FACTS, tables: bool = False, tidy=collapse) -> DataFrame:
    """Explode ``lines`` and keep statements of fact, one row each: lines with one of
    ``phrases``, tidied by ``tidy``, without those of tables unless ``tables``."""
    # an exploded row is tidied once; a plain column would be again in every condition
    each = rows.withColumn("content", F.explode(F.transform("lines", tidy)))
    dollars = F.length("content") - F.length(F.replace(F.col("content"), F.lit("$"), F.lit("")))
    colons = F.length("content") - F.length(F.replace(F.col("content"), F.lit(":"), F.lit("")))
    told = F.length("content").between(30, 500) & (colons <= 2) & (dollars <= 2) & F.col("content").rlike(phrases)
    return each.where(told if tables else told & ~is_table_line(F.col("content"))).withColumn("content_type", F.lit("fact"))


def unpivot_rows(lines: DataFrame) -> DataFrame:
    """Statement tables: a row for each metric and year (the first three years).

    A statement heading opens a table; table lines and long lines extend it; anything else
    ends it.  The first line of years in a table names its columns.
    """
    text = collapse(F.col("text"))
    mine = W.partitionBy("doc_id", "block_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    flagged = lines.withColumns({"text": text, "_open": text.rlike(STATEMENTS), "_more": is_table_line(text) | (F.size(F.split(text, " ")) > 6)})
    tabled = flagged.withColumn("_t", F.sum(F.when(F.col("_open") | ~F.col("_more"), 1).otherwise(0)).over(mine))
    whole = W.partitionBy("doc_id", "block_id", "_t")
    tabled = tabled.withColumns({"table_name": F.max(F.when(F.col("_open"), F.col("text"))).over(whole), "_n": F.count("*").over(whole), "_numeric": F.max(is_table_line(F.col("text")).cast("int")).over(whole)})
    tabled = tabled.where("table_name is not null and _n >= 2 and _numeric = 1")
    years = F.regexp_extract_all(F.when(F.col("text").rlike(r"(^|[^\d])20\d{2}(\s+(\(\d+\)\s+)?20\d{2}){2,}$"), F.col("text")), F.lit(r"\b(20\d{2})\b"), F.lit(1))
    tabled = tabled.withColumn("years", F.min_by(years, F.when(years.isNotNull() & (F.size(years) > 0), F.col("line_no"))).over(whole))
    row = rf"(?i)^([A-Za-z][A-Za-z0-9 ,.'’\-()&/]+?)\s+{FIGURE}\s+{FIGURE}\s+{FIGURE}"
    figures = tabled.where(F.col("text").rlike(row) & (F.size("years") > 0)).withColumn("metric", F.regexp_extract("text", row, 1))
    pairs = F.arrays_zip(F.slice("years", 1, 3).alias("year"), F.array(*[F.regexp_extract("text", row, i) for i in (2, 3, 4)]).alias("value_raw"))
    return _valued(figures.withColumn("p", F.explode(pairs)).where("p.year is not null").select("doc_id", "block_id", "page_no", "part", "item", "table_name", "metric", F.col("p.year").alias("year"), F.col("p.value_raw").alias("value_raw")), F.lit(None).cast("string"))


def _valued(rows: DataFrame, unit: Column) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return rows.withColumns({
        "value_normalized": number(F.col("value_raw")), "unit": F.coalesce(F.try_element_at(known, F.col("metric")), unit),
        "content": F.concat("metric", F.lit(" for "), "year", F.lit(": "), "value_raw"), "content_type": F.lit("table_row"),
    })


def five_year_rows(blocks: DataFrame) -> DataFrame:
    """The five-year table: ``blocks`` (doc_id, block_id, part, item, page_start, lines)."""
    text = collapse(F.array_join("lines", "\n"))
    found = blocks.where(F.col("item") == rules.ITEM_6).withColumn("_text", text).where(F.col("_text").rlike(r"\b(2015|2016|2017|2018|2019)\b"))
    down = F.col("_text").rlike(r"2019\s+2018\s+2017\s+2016\s+2015")
    years = F.when(down, F.array(*[F.lit(y) for y in reversed(ITEM_6_YEARS)])).otherwise(F.array(*[F.lit(y) for y in ITEM_6_YEARS]))
    row = ITEM_6_METRICS + rf"\s+{FIGURE}" + rf"\s+{FIGURE}" * 4
    rows = found.select("doc_id", "block_id", F.col("page_start").alias("page_no"), "part", "item", F.lit(rules.ITEM_6).alias("table_name"), "_text", years.alias("_y"), F.explode(F.regexp_extract_all("_text", F.lit(f"({row})"), F.lit(1))).alias("_r"))
    metric = F.regexp_replace(collapse(F.regexp_extract("_r", row, 1)), r" \(2\)$", "")
    pairs = F.arrays_zip(F.col("_y").alias("year"), F.array(*[F.regexp_extract("_r", row, i) for i in range(2, 7)]).alias("value_raw"))
    unit = F.when(F.col("_text").rlike(r"(?i)\(in\s+millions(?:,\s*except\s+per\s+share\s+data)?\)"), "million USD")
    cells = rows.withColumns({"metric": metric, "_u": unit}).withColumn("p", F.explode(pairs))
    return _valued(cells.select("doc_id", "block_id", "page_no", "part", "item", "table_name", "metric", F.col("p.year").alias("year"), F.col("p.value_raw").alias("value_raw"), "_u"), F.col("_u")).drop("_u")


def risk_sections(blocks: DataFrame) -> DataFrame:
    """Risk factors by heading: doc_id, block_id, subsection, content.

    A fold over the block's lines: a line with heading and body opens a section with its
    first line; a short line right below a heading that is no body continues it; a line in
    the form of a heading opens the next one; everything else is body.
    """
    embedded = rf"^({RISK_TITLE})\s+({RISK_BODY}.*)$"
    head, body = F.regexp_extract, lambda x: F.regexp_extract(x, embedded, 2)
    seen = lambda t: F.struct(t.alias("t"), let(head(t, embedded, 1), lambda h: F.when(rules.is_risk_heading(h), h)).alias("h"), body(t).alias("b"), rules.is_risk_heading(t).alias("is"))
    lines = F.transform("lines", lambda x: let(collapse(x), seen))
    empty = F.array().cast("array<struct<h:string,ls:array<string>>>")
    none = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("h"), none.alias("ls"))
    closed = lambda s: F.when(s["h"].isNotNull() & (F.size(s["ls"]) > 0), F.concat(s["done"], F.array(F.struct(s["h"].alias("h"), s["ls"].alias("ls"))))).otherwise(s["done"])

    def add(s: Column, x: Column) -> Column:
        make = lambda done, h, ls: F.struct(done.alias("done"), h.alias("h"), ls.alias("ls"))
        continues = s["h"].isNotNull() & (F.size(s["ls"]) == 0) & ~x["t"].rlike(BODY_START) & (F.size(F.split(F.concat_ws(" ", s["h"], x["t"]), " ")) <= 30)
        return (
            F.when(x["h"].isNotNull() & (x["b"] != ""), make(closed(s), x["h"], F.array(x["b"])))
            .when(continues, make(s["done"], F.concat_ws(" ", s["h"], x["t"]), s["ls"]))
            .when(x["is"], make(closed(s), x["t"], none))
            .when(s["h"].isNotNull(), make(s["done"], s["h"], F.concat(s["ls"], F.array(x["t"]))))
            .otherwise(s)
        )

    folded = F.aggregate(F.filter(lines, lambda x: x["t"] != ""), start, add, closed)
    rows = blocks.where(F.col("item") == rules.ITEM_1A).select("doc_id", "block_id", "part", "item", "page_start", "page_end", F.explode(folded).alias("s"))
    return rows.select("doc_id", "block_id", "part", "item", "page_start", "page_end", F.col("s.h").alias("subsection"), F.array_join(F.concat(F.array("s.h"), "s.ls"), "\n").alias("content"), F.lit("narrative").alias("content_type"))


def full_text_sections(blocks: DataFrame) -> DataFrame:
    """Risk factors whose heading runs on inside a line: doc_id, block_id, subsection,
    content, as ``risk_sections`` has them.

    One scan with a look-ahead over the block's joined text: a section is a title, the
    start of a sentence, and what follows up to the next title with one.  The first
    section of each title counts.
    """
    text = collapse(F.regexp_replace(F.array_join("lines", " "), r"(?<=[a-z)])(?=[A-Z])", " "))

    def sections_of(title: str):
        start, one = rf"(?:{title})\s+{RISK_BODY}", rf"({title})\s+({RISK_BODY}.*)"
        read = lambda s: F.struct(collapse(F.regexp_extract(s, one, 1)).alias("subsection"), collapse(F.regexp_extract(s, one, 2)).alias("body"))
        return lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"({start}.*?)(?={start}|$)"), F.lit(1)), read)

    # only a text with one of the endings has titles that are told by their end, for which
    # every capital is followed to the end of its sentence
    found = let(text, lambda x: F.when(x.rlike(RISK_ENDING), sections_of(RISK_TITLE)(x)).otherwise(sections_of(RISK_OPENED)(x)))
    rows = blocks.where(F.col("item") == rules.ITEM_1A).select("doc_id", "block_id", "part", "item", "page_start", "page_end", F.posexplode(found).alias("_at", "_s"))
    rows = rows.select("*", "_s.subsection", F.col("_s.body").alias("_body")).where("subsection <> '' and _body <> ''")
    first = rows.groupBy("doc_id", "block_id", "part", "item", "page_start", "page_end", "subsection").agg(F.min_by("_body", "_at").alias("_body"))
    return first.select("doc_id", "block_id", "part", "item", "page_start", "page_end", "subsection", F.concat_ws("\n", "subsection", "_body").alias("content"), F.lit("narrative").alias("content_type"))


def all_risk_sections(blocks: DataFrame) -> DataFrame:
    """The sections of the line fold, and of the full text those whose heading it missed."""
    by_line = materialize(risk_sections(blocks), "risk-sections")
    # headings repeat, so their file is small at any number of rows; without the hint it is broadcast for that
    known = by_line.select("doc_id", "block_id", "subsection").hint("merge")
    missed = full_text_sections(blocks).join(known, ["doc_id", "block_id", "subsection"], "left_anti")
    return by_line.unionByName(missed)


def profiles(blocks: DataFrame, roster: list[str]) -> DataFrame:
    """Officers: a profile row (name, age, role) and a biography for each name of a roster."""
    text = collapse(F.array_join("lines", " "))
    found = blocks.withColumn("_t", text).where(F.contains(F.lower("_t"), F.lit("executive officers and directors")))
    names = "|".join(re.escape(n) for n in roster)
    row = rf"({names})\s+(\d{{2}})\s+(.*?)(?=(?:{names})\s+\d{{2}}|(?:{names})\.|Board of Directors|$)"
    rows = found.select("doc_id", "block_id", "page_start", F.explode(F.regexp_extract_all("_t", F.lit(f"({row})"), F.lit(1))).alias("_r"))
    role = F.regexp_replace(F.regexp_extract("_r", row, 3), r"^[ .:]+|[ .:]+$", "")
    rows = rows.select("doc_id", "block_id", "page_start", F.lit("profile_row").alias("content_type"), F.regexp_extract("_r", row, 1).alias("entity_name"), F.regexp_extract("_r", row, 2).alias("year"), role.alias("entity_role"))
    rows = rows.where("entity_role <> ''").withColumn("content", F.format_string("%s, age %s, serves as %s.", "entity_name", "year", "entity_role"))
    bio = rf"({names})\. (.*?)(?=(?:{names})\. |Board of Directors|$)"
    bios = found.select("doc_id", "block_id", "page_start", F.explode(F.regexp_extract_all("_t", F.lit(f"({bio})"), F.lit(1))).alias("_r"))
    bios = bios.select("doc_id", "block_id", "page_start", F.lit("profile_bio").alias("content_type"), F.regexp_extract("_r", bio, 1).alias("entity_name"), F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("entity_role"), F.trim("_r").alias("content"))
    return rows.unionByName(bios)


def metadata(pages: DataFrame) -> DataFrame:
    """doc_id, filing_type, fiscal_year, company_name from a filing's first page; the name
    stands above the words that say so on a form's cover."""
    first = pages.groupBy("doc_id").agg(F.min_by("lines", "page_no").alias("lines")).withColumn("_t", F.array_join("lines", " "))
    year = F.nullif(F.regexp_extract("_t", r"(?i)fiscal year ended [A-Za-z]+ \d{1,2}, (20\d{2})", 1), F.lit(""))
    name = F.nullif(collapse(F.regexp_extract(F.array_join("lines", "\n"), r"(?i)([^\n]+)\n\s*\(exact name of registrant", 1)), F.lit(""))
    return first.select("doc_id", F.when(F.upper("_t").contains("10-K"), "10-K").alias("filing_type"), F.coalesce(year, F.lit("2019")).alias("fiscal_year"), name.alias("company_name"))


def filing_chunks(pages: DataFrame, roster: list[str] | None = None) -> DataFrame:
    """Pages to typed chunks: the whole filing pipeline.

    doc_id, chunk_id, content_type, part, item, section, subsection, content, page_start,
    page_end, table_name, metric, year, value_raw, value_normalized, unit, entity_name,
    entity_role, and the filing's type, year and company.  Repeated chunk ids collapse.
    """
    # written once: a dozen branches read them
    lines = materialize(skeleton(ordered_lines(content_pages(pages))), "filing-lines")
    blocks = lines.groupBy("doc_id", "block_id", "part", "item", "label").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    blocks = materialize(blocks.withColumn("lines", F.transform("l", lambda x: x["text"])).drop("l"), "filing-blocks")
    hinted = F.lit(None).cast("array<string>")
    for item, words in HINTS.items():
        hinted = F.when(F.col("item") == item, F.array(*[F.lit(w) for w in words])).otherwise(hinted)
    special = F.coalesce(F.col("item").isin(rules.ITEM_1A, rules.ITEM_6, rules.ITEM_7, rules.ITEM_8), F.lit(False)) | (F.col("label") == "Overview")
    plain = sections(lines.where(~special), is_heading(F.col("text"), hinted), inline=inline_heading(HINTS))
    mda = sections(lines.where(F.col("item") == rules.ITEM_7), is_mda_heading(F.col("text")), keep_front=False)
    prose = plain.unionByName(mda).withColumns({"content": F.array_join("lines", "\n"), "content_type": F.lit("narrative")})
    front = blocks.where(F.col("label") == "Overview").withColumn("lines", F.filter("lines", lambda x: rules.mentions(fold(x), FRONT_MATTER))).where(F.size("lines") > 0)
    front = front.select("doc_id", "part", "item", F.lit("Overview").alias("section"), F.array_join("lines", "\n").alias("content"), F.lit("fact").alias("content_type"), "page_start", "page_end")
    five, statements = five_year_rows(blocks), unpivot_rows(lines.where(F.col("item") == rules.ITEM_8))
    block_of = lambda rows: rows.select("doc_id", "part", "item", "table_name").distinct().withColumns({"content_type": F.lit("table_block"), "content": F.col("table_name")})
    out = None
    for rows in (prose.drop("lines", "label", "block_id"), facts(plain).drop("lines", "label", "block_id"), front, all_risk_sections(blocks).drop("block_id"), five.drop("block_id").withColumnsRenamed({"page_no": "page_start"}),
                 statements.drop("block_id").withColumnsRenamed({"page_no": "page_start"}), block_of(five), block_of(statements), profiles(blocks, roster).drop("block_id") if roster else None):
        if rows is not None:
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    section = F.coalesce("section", "item", F.when(F.col("content_type").startswith("profile"), "Executive Officers and Directors"), F.col("part"), F.lit("Overview"))
    out = out.withColumns({"section": section, "page_end": F.coalesce("page_end", "page_start")})
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.col("content_type")
    key = (
        F.when(kind == "table_row", F.concat_ws("|", blank("item"), blank("table_name"), blank("metric"), blank("year")))
        .when(kind == "table_block", F.concat_ws("|", blank("item"), blank("table_name")))
        .when(kind.startswith("profile"), F.concat_ws("|", blank("section"), blank("entity_name")))
        .when(kind == "fact", F.concat_ws("|", blank("section"), blank("subsection"), F.col("content")))
        .otherwise(F.concat_ws("|", blank("section"), blank("subsection"), blank("page_start"), blank("page_end"), F.col("content")))
    )
    # the id holds the type; as a key beside it, a type that isn't asked for needs no work
    chunked = out.withColumn("chunk_id", content_id(F.col("doc_id").cast("string"), kind, key)).dropDuplicates(["content_type", "chunk_id"])
    return chunked.join(metadata(pages), "doc_id", "left")
