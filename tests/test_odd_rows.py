"""Queries against their SQL on rows that the given tables don't have."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import lines
from docloom.operators import ann, chunking, index, lexical, vector
from docloom.plans import queries as registry, search


def both(spark, tmp_path, name, docs):
    """The query's rows and its SQL's, over ``docs`` (doc_id, text)."""
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_entity_target_at_line_ends(spark, tmp_path):
    # doc_id % 15 = 5 asks "Who is"; each fifth question goes on with the text's first 40 characters
    texts = ["x\n", "x\n\n", "a\nb", "x\r", "x?\r", "x\u0085", "x ", "x? ", "x　", "\n", "", None, "x. ?"]
    got, want = both(spark, tmp_path, "entity_target", [(5 + 15 * i, texts[i % len(texts)]) for i in range(26)])
    assert got == want and len(got) > 10


def test_fact_filter_takes_the_lines_of_its_sql(spark, tmp_path):
    more = "and so on, with many more words"
    lines = [
        f"Net sales 12 13 14 from time to time {more}", f"we own 2015 2016 2017 2018 2019 {more}", f"12 (in millions) we serve {more}", f"we focus on what {more}", f"interest rate risks {more}",
        f"this is in the ordinary course of business {more}", f"\u00e9we own {more}", f"we own\u00e9 {more}", f"we\u00a0own {more}", f"WE OWN {more}", f"xwe own {more}", "we own" + "\u00a0" * 24, "we own\u00a0\u00a0" + "x" * 22,
        "we  own" + " " * 30, "we own\x0b\x0b" + "x" * 22, "from time to time: a: b: c: d " + more, "$1 $2 $3 we own " + more, "we own " + "x" * 493, "we own " + "x" * 494, f"{more}\r", "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
    ]
    docs = [(3 * i + k, line) for i, line in enumerate(lines) for k in (0, 1)] + [(300, "\n".join(lines)), (301, "\n".join(lines)), (302, None), (304, "")]
    got, want = both(spark, tmp_path, "fact_filter", docs)
    assert got == want and len(got) > 20


def test_links_in_crowded_buckets_are_all_found(spark):
    draw = random.Random(7)
    some = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = []
    for start in ("samest", "others", "thirds"):
        end = some(14)
        # two edits in the other two segments: this start is all that the two lines share
        twin = "".join(chr(97 + (ord(c) - 96) % 26) if i in (3, 10) else c for i, c in enumerate(end))
        texts += [start + end, start + twin, *(start + some(14) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in lines.deduplicate_lines(docs).where("n_dropped > 0").collect()}
    assert gone == {1, 303, 605}


def test_tiles_of_cells_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 8)
    made = vector.tile_of

    def bounded(k, scoped):
        tile = made(k, scoped)

        def checked(asked, held):
            assert len(asked) <= 30
            return tile(asked, held)

        return checked

    monkeypatch.setattr(vector, "tile_of", bounded)
    draw = random.Random(3)
    rows = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(400)], "vec_id long, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    cells = ann.build(rows, cells=4)
    assert ann.top(asked, cells, 3).count() == ann.top(asked, cells, 3, 2).count() == 1200


def test_deltas_of_more_texts_than_a_slice(spark):
    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else f"Words {i} end here. " * (i % 9 + 1) for i in range(2 * chunking.TEXTS + 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.d for r in rows.select("id", chunking.deltas(F.col("text")).alias("d")).collect()}
    assert got == {i: None if t is None else chunking.cut(t, 12, 40) for i, t in enumerate(texts)}


def test_postings_leave_python_in_pieces(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    index.postings(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", {"text": "text"})
    texts = [f"a{i} b c a{i}" for i in range(40_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "_f0"])
    parts = list(taken[0](iter([batch])))
    assert max(p.num_rows for p in parts) < 40_000 and sum(p.num_rows for p in parts) == 120_000
    rows = [r for p in parts for r in p.to_pylist()]
    assert all(r["pos"] == {"a": [0, 3], "b": [1], "c": [2]}[r["term"][0]] and r["dl"] == 4 for r in rows)


def test_scores_are_summed_by_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_ROWS", 10, raising=False)
    docs = spark.createDataFrame([(i, f"a b{i % 7}") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b3"), (2, "b1 zz")], "query_id long, text string")
    scores = lexical.bm25(asked, index.postings(docs, "doc_id", {"text": "text"}), 300)
    assert scores.rdd.getNumPartitions() == 30 and scores.count() == 300 + 43


def test_only_the_words_asked_for_are_indexed(spark, monkeypatch):
    made, kept = index.postings, []
    monkeypatch.setattr(index, "postings", lambda *a, **k: kept.append(made(*a, **k)) or kept[-1])
    fields = {f: None for f in search.BOOSTS} | {"chunk_id": "c", "content": "net sales rose while many others fell", "title": "net words"}
    chunks = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{f} string" for f in fields))
    asked = search.routed(spark.createDataFrame([(1, "net sales?", 4)], "query_id long, question string, top_k int"))
    assert [r.chunk_id for r in search.candidates(asked, chunks).collect()] == ["c"]
    words = {r.term for r in kept[0].select("term").collect()}
    assert {"net", "sales"} <= words and not words & {"rose", "while", "many", "others", "fell"}
