"""Behaviours of single operators."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules, text
from docloom.operators import chunking, ingest, sessions
from docloom.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [
    ("  a \t b\n", "a b"), ("", ""), ("a b", "a b"),
])
def test_collapse(spark, given, want):
    assert one(spark, text.collapse(F.col("t")), t=given) == want


def test_redaction_takes_dates_before_digits(spark):
    assert one(spark, text.redact(F.col("t")), t="born 09-11-1985 or 1985-11-09, pin 4321, 12345") == "born [REDACTED_DATE] or [REDACTED_DATE], pin [REDACTED_4_DIGITS], 12345"


@pytest.mark.parametrize("question, want", [
    ('Tell me more about "Item 2"?', "Item 2"), ("please explain: (Risk Factors).", "Risk Factors"), ("Net sales", "Net sales"), ("?!", None), ("explain describe x", "x"),
])
def test_reference_is_peeled(spark, question, want):
    assert one(spark, rules.reference(F.col("q")), q=question) == want


@pytest.mark.parametrize("line, want", [
    ("We Face Intense Competition", True), ("Risks Related to Our Supply", True), ("Our business is fine.", False), ("The loss of the founder could harm us", True), ("In 2019 the loss of the year", False), ("Short line", False),
])
def test_risk_heading_form(spark, line, want):
    assert one(spark, rules.is_risk_heading(F.col("t")), t=line) is want


def test_packing_keeps_every_line_and_never_cuts_one(spark):
    lines = [("x" * n) for n in (10, 790, 5, 900, 1, 400, 399)]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(chunking.packed(F.col("l"), "\n").alias("c")).first()["c"]
    assert "\n".join(row).split("\n") == lines
    assert [len(c) for c in row] == [10, 796, 900, 402, 399]


def test_at_most_three_paragraphs(spark):
    docs = spark.createDataFrame([("d.md", "d.md", "a\n\nb\n \nc\n\nd\n\n")], "path string, name string, text string")
    assert [r.content for r in files.text_chunks(docs).orderBy("content").collect()] == ["a\n\nb\n\nc", "d"]


def test_last_value_wins_at_first_position(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("j", 2, "x"), ("k", 3, "new")], "key string, pos int, v string")
    assert {tuple(r) for r in chunking.last_wins(rows, "key", "pos").collect()} == {("k", 1, "new"), ("j", 2, "x")}


def test_last_ten_messages(spark):
    rows = spark.createDataFrame([("s", i) for i in range(12)], "session string, turn int")
    assert {r.turn for r in chunking.last_messages(rows, "session", ["turn"]).collect()} == set(range(2, 12))


def test_sources_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("One.\n\nTwo.")
    (tmp_path / "in/b.exe").write_text("no")
    with zipfile.ZipFile(tmp_path / "in/c.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>you</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in/d.docx").write_text("broken")
    docs, rejected = files.read_documents(spark, str(tmp_path / "in"))
    assert {r["name"]: r["text"] for r in docs.collect()} == {"a.md": "One.\n\nTwo.", "c.docx": "Hello\nyou"}
    assert {r.path.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in rejected.collect()} == {"b.exe": "Unsupported document type", "d.docx": "BadZipFile"}
    index = str(tmp_path / "index")
    for _ in range(2):  # writing again replaces, it does not add
        files.write_index(files.text_chunks(docs), index)
    found = files.read_index(spark, index)
    assert found.count() == 2 and found.select("chunk_id").distinct().count() == 2
    assert files.missing_columns(found, {"content": "string", "embedding": "array<float>"}) == ["embedding"]


def test_orders_file_and_lookup(spark, tmp_path):
    order = {"customer_id": "c", "full_name": "Ada  Byron", "dob": "1985-11-09", "ssn_last4": "4321", "order_id": "A", "shipment_status": "on its way", "carrier": "Post", "estimated_delivery": "2030-01-02"}
    (tmp_path / "orders.json").write_text(json.dumps([order]))
    keyed = sessions.keyed_orders(files.read_orders(spark, str(tmp_path / "orders.json")))
    assert keyed.first()["customer_ref"] == "CUSTOMER#ada byron#1985-11-09#4321"


def test_embedding_seam(spark):
    rows = spark.createDataFrame([("a",), ("bb",)], "content string")
    got = files.embed(rows, lambda texts: [[float(len(t))] * 8 for t in texts], 8).collect()
    assert {r.content: r.embedding[0] for r in got} == {"a": 1.0, "bb": 2.0}


def test_streamed_dialogue_equals_batch(spark, tmp_path):
    from docloom.plans.fixtures import DIALOGUE
    from docloom.streaming.workflow import reply_stream

    rows = spark.createDataFrame([d[:3] for d in DIALOGUE], "session_id string, turn long, message string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    query = reply_stream(stream).writeStream.format("memory").queryName("replies").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    order = ["session_id", "turn"]
    assert spark.table("replies").orderBy(*order).collect() == sessions.dialogue(rows).orderBy(*order).collect()


def test_ingestion_is_done_once(spark, tmp_path):
    from docloom.streaming.ingestion import ingest_stream, read_state

    body = json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "a.md", "versionId": "1"}}}, {"s3": {"bucket": {"name": "b"}, "object": {"key": "x.exe", "versionId": "1"}}}]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text(body)
    (tmp_path / "in/2.txt").write_text(body)
    worked = []

    def work(claimed):
        worked.append(claimed.count())
        return claimed.select("pk", "sk", F.lit(3).cast("long").alias("indexed_doc_count"), F.lit(None).cast("string").alias("error_message"))

    bodies = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).select(F.col("value").alias("body"))
    ingest_stream(bodies, str(tmp_path / "state"), str(tmp_path / "cp"), work).awaitTermination(120)
    state = read_state(spark, str(tmp_path / "state")).collect()
    assert worked == [1, 0]
    assert [(r.pk, r.status, r.indexed_doc_count) for r in state] == [("DOC#b#a.md", "completed", 3)]


def test_a_claim_is_seen_while_it_is_worked_on(spark, tmp_path):
    from docloom.streaming.ingestion import ingest_batch, read_state

    path = str(tmp_path / "state")
    body = json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "a.md", "versionId": "1"}}}]})
    bodies = spark.createDataFrame([(body,)], "body string")
    seen = []

    def dies(claimed):
        seen.append([r.status for r in read_state(spark, path).collect()])
        raise RuntimeError("lost")

    def works(claimed):
        seen.append(claimed.count())
        return claimed.select("pk", "sk", F.lit(1).cast("long").alias("indexed_doc_count"), F.lit(None).cast("string").alias("error_message"))

    with pytest.raises(RuntimeError, match="lost"):
        ingest_batch(bodies, 0, path, dies)
    ingest_batch(bodies, 1, path, works)  # somebody else is at it
    ingest_batch(bodies, 0, path, works)  # the batch that failed runs again
    assert seen == [["processing"], 0, 1]
    assert [r.status for r in read_state(spark, path).collect()] == ["completed"]


def test_index_of_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("One.\n\nTwo.")
    (tmp_path / "in/b.md").write_text("Three.")
    index, source = str(tmp_path / "index"), [str(tmp_path / "in")]
    provider = lambda texts: [[1.0] * 8 for _ in texts]
    ids = spark.createDataFrame([("x",)], "doc_id string")
    assert [tuple(r) for r in files.count_by_document(spark, index, ids).collect()] == [("x", 0)]
    assert files.index_paths(spark, source, index, provider, 8) == 2
    (tmp_path / "in/b.md").write_text(" ")  # no chunk any more: its old one goes
    assert files.index_paths(spark, source, index, provider, 8) == 1
    held = files.read_index(spark, index).select("doc_id")
    assert held.count() == 1
    files.verify_index(spark, index, held, ids)
    with pytest.raises(RuntimeError, match="x is not in the index"):
        files.verify_index(spark, index, ids)
    with pytest.raises(RuntimeError, match="is still in the index"):
        files.verify_index(spark, index, held, held)
    with pytest.raises(ValueError, match="embedding"):
        files.ensure_index(spark, index, {"embedding": "array<double>"})


def test_streamed_model_output(spark):
    from docloom.operators import hits

    said = lambda c: "data: " + json.dumps({"choices": [{"delta": {"content": c}}]})
    lines = [": ping", said("[1]"), "", said(["a", {"type": "text", "text": "b"}, {"type": "image"}]), said(None), said(""), "data: {}", "data: [DONE]", "data: 3", "data: {", said("late")]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "id string, at int, line string")
    assert [(r.at, r.delta, r.error) for r in hits.stream_deltas(rows, "id", "at").orderBy("at").collect()] == [(1, "[1]", None), (3, "ab", None), (9, None, "invalid JSON")]


def test_blank_hits_go_and_defaults_are_filled(spark):
    from docloom.operators import hits

    rows = spark.createDataFrame([(None, "h1", " \u2003", None, 1.0, 1.0, 1.0), (None, "h2", "x", None, 0.0, None, 3.0)], "chunk_id string, hit_id string, content string, title string, lexical_score double, vector_score double, hit_score double")
    got = hits.normalized(rows).collect()
    assert [(r.chunk_id, r.title, r.section, r.score, r.vector_score) for r in got] == [("h2", "Untitled", "", 3.0, 0.0)]


def test_vector_scope_is_optional_by_question(spark):
    from docloom.operators import vector

    base = [1.0] * 8
    rows = spark.createDataFrame([(1, base, "a"), (2, base, "b")], "vec_id long, embedding array<double>, scope string")
    asked = spark.createDataFrame([(7, base, "b"), (8, base, None)], "query_id long, embedding array<double>, scope string")
    assert {(r.query_id, r.vec_id) for r in vector.cosine_top(asked, rows, 5).collect()} == {(7, 2), (8, 1), (8, 2)}


def test_failure_is_recorded_short(spark):
    claimed = spark.createDataFrame([("p", "s", "processing")], "pk string, sk string, result string")
    done = spark.createDataFrame([("p", "s", None, "e" * 3000)], "pk string, sk string, indexed_doc_count long, error_message string")
    row = ingest.outcome(claimed, done, F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))).first()
    assert row.status == "failed" and len(row.error_message) == 1000 and row.completed_at is None


def test_lost_work_is_failed(spark):
    claimed = spark.createDataFrame([("p", "s", "processing")], "pk string, sk string, result string")
    done = spark.createDataFrame([], "pk string, sk string, indexed_doc_count long, error_message string")
    row = ingest.outcome(claimed, done, F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))).first()
    assert row.status == "failed" and row.completed_at is None and row.error_message


def test_uniqueness_is_by_section(spark):
    item6, item8 = "Item 6. Selected Consolidated Financial Data", "Item 8. Financial Statements and Supplementary Data"
    rows = [("a", "table_row", item6, None, "Net sales", "2019"), ("b", "table_row", item8, "Income", "Net sales", "2019"), ("c", "table_row", item8, "Income", "Net sales", "2019")]
    frame = spark.createDataFrame(rows, "chunk_id string, content_type string, section string, subsection string, metric string, year string")
    assert [(r.constraint, r.n) for r in chunking.violations(frame).collect()] == [("table_row: section, subsection, metric, year", 2)]


def test_entry_module_without_corpus(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "docloom.llm", None)
    module = importlib.reload(importlib.import_module("__spark_entry__"))
    assert not [n for n in module.queries() if n.startswith("op") or n == "pipeline"]
    monkeypatch.undo()
    importlib.reload(module)
