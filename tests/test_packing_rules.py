"""Greedy packing, deltas, constraints, run-on headings and containment."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import chunking, filing, index


def folded(parts, joiner, most, many):
    done, open_, n = [], None, 0
    for p in parts:
        if open_ is None:
            open_, n = p, 1
        elif len(open_) + len(joiner) + len(p) > most or (many and n >= many):
            done.append(open_)
            open_, n = p, 1
        else:
            open_, n = open_ + joiner + p, n + 1
    return done if open_ is None else [*done, open_]


@pytest.mark.parametrize("joiner, most, many", [("\n", 50, None), ("\n\n", 80, 3), ("", 10, None), (" ", 1, 2)])
def test_packing_is_the_fold(spark, joiner, most, many):
    draw = random.Random(most)
    rows = [None, [], [""], ["", "", "x" * 200, ""]] + [["é" * draw.choice([0, 1, 5, 20, 90]) for _ in range(draw.randrange(40))] for _ in range(60)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, parts array<string>")
    got = {r.i: r.c for r in frame.select("i", chunking.packed(F.col("parts"), joiner, most, many).alias("c")).collect()}
    assert got == {i: None if r is None else folded(r, joiner, most, many) for i, r in enumerate(rows)}


def test_a_million_lines_take_time_in_proportion():
    lengths = np.random.default_rng(1).integers(0, 120, 1_000_000)
    began = time.process_time()
    starts = chunking.breaks(lengths, 1, 800, None)
    small = time.process_time() - began
    assert 50_000 < len(starts) < 200_000 and starts[0] == 0 and small < 5
    text = "One two three. Four five! " * 40_000
    began = time.process_time()
    pieces = chunking.cut(text, 12, 40)
    assert "".join(pieces) == text and time.process_time() - began < 20


def whole_text_cut(text, least, most):
    """The rule as stated, on the open piece as a whole."""
    out, open_ = [], ""
    for t in re.findall(r"\S+\s*|\s+", text, re.ASCII):
        for token in (t[i : i + most] for i in range(0, len(t), most)):
            if open_ and len(open_) + len(token) > most:
                out.append(open_)
                open_ = ""
            open_ += token
            if len(open_.strip(" ")) >= least and re.search(r"([.!?;:]\s*|\n+)\Z", open_, re.ASCII):
                out.append(open_)
                open_ = ""
    return [*out, open_] if open_ else out


def test_deltas_follow_the_rule():
    draw = random.Random(9)
    for _ in range(300):
        text = "".join(draw.choice(["word", "a", " ", "  ", ". ", "!", "\n", "é", "x" * 50, "; "]) for _ in range(draw.randrange(60)))
        assert chunking.cut(text, 12, 40) == whole_text_cut(text, 12, 40)


def test_constraints_in_one_pass(spark):
    item6 = chunking.UNIQUE[1][1]
    rows = [("a", "fact", "Overview", None, "table of contents"), ("a", "fact", "Overview", None, "x"), ("b", "table_block", item6, None, "y"), ("c", "table_block", item6, None, "z"), ("d", "fact", item6, None, "TABLE OF CONTENTS")]
    frame = spark.createDataFrame(rows, "chunk_id string, content_type string, section string, subsection string, content string")
    found = chunking.violations(frame)
    assert {tuple(r) for r in found.collect()} == {("any: chunk_id", "a", 2), ("table_block: section", item6, 2), (chunking.NOISE, "table of contents", 1)}
    assert chunking.violations(frame.where("false")).count() == 0
    plan = frame.sparkSession._jvm.PythonSQLUtils.explainString(chunking.violations(frame)._jdf.queryExecution(), "simple")
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange ") == 1


def blocks(spark, *lines):
    frame = spark.createDataFrame([(1, 0, "PART I", rules.ITEM_1A, 10, 10, list(lines))], "doc_id int, block_id int, part string, item string, page_start int, page_end int, lines array<string>")
    return {r.subsection: r.content for r in filing.all_risk_sections(frame).collect()}


def test_headings_that_the_lines_miss(spark):
    got = blocks(spark, "Patent Claims and Disputes About Copying of Designs", "Our games rely in part on licensed artwork from others.", "We Face Fierce Rivalry Our markets are changing fast and are crowded, with many rivals in every region.")
    assert set(got) == {"Patent Claims and Disputes About Copying of Designs", "We Face Fierce Rivalry"}
    inside = blocks(spark, "The year was a good one for all of us, and many things were done that had been left undone. Risks Related to Shipping This is what can go wrong at seaRisks Related to Storms If ships sink we lose goods.")
    assert inside == {"Risks Related to Shipping": "Risks Related to Shipping\nThis is what can go wrong at sea", "Risks Related to Storms": "Risks Related to Storms\nIf ships sink we lose goods."}
    assert blocks(spark) == {} and blocks(spark, "", "Nothing here.") == {}


def test_sets_are_contained(spark):
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices("abcdefgh", k=draw.randrange(9)))) for i in range(200)] + [(900, None), (901, "")]
    sets = [(i, " ".join(draw.choices("abcdefgh", k=draw.randrange(1, 5)))) for i in range(20)] + [(50, ""), (51, None), (52, "a absent"), (53, "a a a")]
    made = index.postings(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", {"text": "text"})
    got = {tuple(r) for r in index.containing(spark.createDataFrame(sets, "set_id long, text string"), made).collect()}
    assert got == {(s, d) for s, w in sets for d, t in docs if (w or "").split() and set(w.split()) <= set((t or "").split())}
