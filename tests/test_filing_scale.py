"""Filings: what is asked for is all that is made, and lines are cut as by all patterns in turn."""

import random
import re

from docloom.operators import filing
from docloom.plans import fixtures as fx


def test_lines_are_made_once_and_other_types_not_at_all(spark):
    pages = spark.createDataFrame([(d, n, list(lines)) for d in range(3) for n, lines in fx.PAGES], "doc_id int, page_no int, lines array<string>")
    chunks = filing.filing_chunks(pages, ["Dana Whitfield", "Lee Park"])
    rows = chunks.where("content_type = 'table_row'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "risk" not in plan.lower()
    every = chunks.toPandas()
    assert len(rows.toPandas()) == (every.content_type == "table_row").sum() > 0 and every.chunk_id.is_unique


def test_glued_words_come_apart_as_by_all_patterns_in_turn(spark):
    draw = random.Random(3)
    words = ["General", "We", "Our", "The", "Name", "Competition", "Seasonality", "Employees", "Board of Directors", "Executive Officers and Directors", "Available Information", "Item 1A.", "PART IItem 2.", "PART II", " ", ".", "x", "general", "ß"]
    lines = ["".join(draw.choice(words) for _ in range(6)) + "w" for _ in range(400)]
    pages = spark.createDataFrame([(1, 1, [x]) for x in lines], "doc_id int, page_no int, lines array<string>").selectExpr("row_number() over (order by lines) as doc_id", "page_no", "lines")
    got = {}
    for r in filing.ordered_lines(pages).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for r in pages.collect():
        text = re.sub(r"\s+", " ", r.lines[0]).strip()
        for pattern, replacement in filing.RUN_ON:
            text = re.sub(pattern, replacement.replace("$", "\\"), text)
        assert "".join(got.get(r.doc_id, [])).replace(" ", "") == text.replace(" ", "")
        known = "|".join(map(re.escape, filing.RUN_ON_HEADINGS))
        items = re.split(r"(?i)(?<=\S)\s*(?=(?:PART\s+[IVX]+\s+)?(?<!PART I )(?<!PART II )Item\s+\d+[A-Z]?\.)", text)
        want = [re.sub(r"\s+", " ", p).strip() for i in items for p in re.split(rf"(?<=\S)\s+(?=\b(?:{known})\b\s*\S)", i)]
        assert got.get(r.doc_id, []) == [p for p in want if p]


def test_titles_told_by_their_end_and_by_their_opening_are_found(spark):
    texts = ["x Loss Could Harm Our Business We rely on it. We Face Much Competition Our rivals are many.", "x We Face Much Competition Our rivals are many.", "Nothing"]
    blocks = spark.createDataFrame([(i, 0, "PART I", filing.rules.ITEM_1A, 1, 1, [x]) for i, x in enumerate(texts)], "doc_id int, block_id int, part string, item string, page_start int, page_end int, lines array<string>")
    got = sorted((r.doc_id, r.subsection) for r in filing.full_text_sections(blocks).collect())
    assert got == [(0, "Loss Could Harm Our Business"), (0, "We Face Much Competition"), (1, "We Face Much Competition")]
