"""The search index against plain Python: postings, pruned top k, phrases, upkeep."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import index

FIELDS = {"body": "text", "head": "title"}


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def corpus(n, seed, vocabulary=60):
    """Texts whose words follow a steep law, of one to three hundred words."""
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = [(i, " ".join(draw.choices(names, weights, k=draw.choice([1, 5, 30, 300]))), " ".join(draw.choices(names, k=2))) for i in range(n)]
    return [*out, (n, None, ""), (n + 1, "", None), (n + 2, "!?", "w1"), (n + 3, "Straße W1-w2", "w1 w2 w1")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, title string")


def test_postings_hold_every_place(spark):
    rows = corpus(30, 1)
    got = {(r.id, r.field, r.term): (r.tf, r.dl, r.pos) for r in index.postings(frame(spark, rows), "id", FIELDS).collect()}
    want = {}
    for i, text, title in rows:
        for field, value in (("body", (text or "").replace("ß", "ss")), ("head", title)):
            ws = words(value)
            for w in set(ws):
                places = [p for p, x in enumerate(ws) if x == w]
                want[i, field, w] = (len(places), len(ws), places)
    assert got == want
    assert index.postings(frame(spark, rows).where("false"), "id", FIELDS).count() == 0


def scored(rows, questions, k):
    docs = {i: words((t or "").replace("ß", "ss")) for i, t, _ in rows}
    n, mean = len(rows), sum(map(len, docs.values())) / len(rows)
    df = collections.Counter(w for ws in docs.values() for w in set(ws))
    out = set()
    for q, text in questions:
        best = []
        for i, ws in docs.items():
            tf = collections.Counter(ws)
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words(text)) if tf[w]]
            if parts:
                best.append((-round(sum(parts), 6), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(best)[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_pruned_top_is_the_whole_top(spark, k):
    rows, draw = corpus(1500, 2, 400), random.Random(3)
    questions = [(q, " ".join(f"w{int(draw.paretovariate(0.5)) % 400}" for _ in range(draw.choice([1, 2, 12, 40])))) for q in range(25)] + [(98, "nothing here"), (99, None), (97, "w0 w1"), (96, "w0")]
    made = index.postings(frame(spark, rows), "id", {"body": "text"})
    top, report = index.pruned_top(spark.createDataFrame(questions, "query_id long, text string"), made, len(rows), k, "id")
    assert {(r.query_id, r.id, r["rank"]) for r in top.collect()} == scored(rows, questions, k)
    told = report.collect()
    assert all(r.postings >= r.rows or r.rows is None for r in told)
    if k == 10:  # most postings of long questions are not met
        assert sum(r.read for r in told) < 0.75 * sum(r.postings for r in told)


def test_pruned_top_of_nothing(spark):
    made = index.postings(frame(spark, []), "id", {"body": "text"})
    top, report = index.pruned_top(spark.createDataFrame([(1, "w1")], "query_id long, text string"), made, 0, 5, "id")
    assert top.count() == 0 and report.count() == 0


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_by_the_rarest_word(spark, slop):
    rows = corpus(150, 4, 12)
    draw = random.Random(5)
    asked = [" ".join(f"w{draw.randrange(12)}" for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5)] + ["w0 w0", "w1 w2 w1", "", None, "w0 absent", "strasse w1"]
    made = index.postings(frame(spark, rows), "id", FIELDS)
    got = {tuple(r) for r in index.phrases(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), made, slop, "id").collect()}
    want = set()
    for q, text in enumerate(asked):
        ask = words(text)
        for i, body, title in rows:
            for field, value in (("body", (body or "").replace("ß", "ss")), ("head", title)):
                ws = words(value)
                starts = range(-slop, len(ws))
                if ask and any(all(any(ws[p] == w for p in range(max(0, s + j), min(len(ws), s + j + slop + 1))) for j, w in enumerate(ask)) for s in starts):
                    want.add((q, i, field))
    assert got == want and len({f for _, _, f in want}) == 2


def test_other_words_are_met_in_candidates_only(spark):
    """A thousand rows of a common word, three of which hold the rare one."""
    rows = [(i, "common " * 5 + ("rare common" if i % 400 == 0 else ""), None) for i in range(1000)]
    made = index.postings(frame(spark, rows), "id", {"body": "text"})
    found = index.phrases(spark.createDataFrame([(1, "rare common")], "query_id long, text string"), made, 0, "id")
    assert {r.id for r in found.collect()} == {0, 400, 800}


def held(spark, path):
    t = index.read(spark, path)
    return {name: sorted(map(str, (tuple(r[c] for c in sorted(t[name].columns)) for r in t[name].collect()))) for name in t}


def test_upkeep_equals_a_new_index(spark, tmp_path):
    old, path = corpus(120, 6), str(tmp_path / "index")
    index.build(frame(spark, old), path, "id", FIELDS)
    fresh = [(i, f"fresh w1 {i}", "w2") for i in range(0, 200, 7)] + [(3, None, None), (4, "", "")]
    gone = [(i,) for i in (5, 6, 8, 9999)]
    index.replace(frame(spark, fresh), path, "id", FIELDS, spark.createDataFrame(gone, "id long"))
    now = {r[0]: r for r in old} | {r[0]: r for r in fresh}
    left = [r for i, r in now.items() if (i,) not in gone]
    index.build(frame(spark, left), str(tmp_path / "new"), "id", FIELDS)
    assert held(spark, path) == held(spark, str(tmp_path / "new"))
    index.replace(frame(spark, []), path, "id", FIELDS, frame(spark, left).select("id"))  # everything goes
    assert held(spark, path) == {"postings": [], "lengths": [], "terms": []}
    index.replace(frame(spark, left), path, "id", FIELDS)
    assert held(spark, path) == held(spark, str(tmp_path / "new"))


def test_upkeep_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index.build(frame(spark, corpus(40, 7)), path, "id", FIELDS)
    before = held(spark, path)
    put = index._put

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_put", lambda table, at, name: dies() if name == "terms" else put(table, at, name))
        with pytest.raises(RuntimeError, match="lost"):
            index.replace(frame(spark, [(1, "fresh", "fresh")]), path, "id", FIELDS)
    after = held(spark, path)
    assert after != before and [x for x in after["terms"] if "fresh" in x] and index.read(spark, path)["terms"].where(F.col("term") == "fresh").count() == 2
    with monkeypatch.context() as m:  # lost before everything was there to write
        m.setattr(index, "_at", lambda *_: dies())
        with pytest.raises(RuntimeError, match="lost"):
            index.replace(frame(spark, [(2, "newer", None)]), path, "id", FIELDS)
    assert held(spark, path) == after
