"""The operators on small literal inputs whose results follow from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules, text, validate
from docloom.operators import ingest, sessions
from docloom.plans import fixtures as fx


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([q[:2] for q in fx.QUESTIONS], "query_id long, question string")


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_questions(spark, questions):
    q = F.col("question")
    assert by_id(questions.select("query_id", rules.search_intent(q))) == {r[0]: r[2] for r in fx.QUESTIONS}
    assert by_id(questions.select("query_id", rules.answer_intent(q))) == {r[0]: r[3] for r in fx.QUESTIONS}
    assert {k: tuple(v) for k, v in by_id(questions.select("query_id", rules.expected_items(q))).items() if v} == fx.EXPECTED
    assert {k: v for k, v in by_id(questions.select("query_id", rules.overview_item(q))).items() if v} == fx.OVERVIEWS
    assert {k: v for k, v in by_id(questions.select("query_id", rules.explicit_item(q))).items() if v} == fx.NAMED_ITEMS
    assert {k: v for k, v in by_id(questions.select("query_id", rules.entity_target(q))).items() if v} == {2: "Dana Whitfield", 12: "the directors"}


def test_figures(spark):
    rows = spark.createDataFrame([(r,) for r, _ in fx.NUMBERS], "raw string")
    assert by_id(rows.select("raw", text.number(F.col("raw")))) == dict(fx.NUMBERS)


def test_fields(spark):
    v, m = F.col("v"), F.col("m")
    rows = spark.createDataFrame([(i[0],) for i in fx.IDENTITIES], "v string")
    assert {tuple(r) for r in rows.select("v", validate.full_name(v)["is_valid"], validate.date_of_birth(v)["normalized_value"], validate.ssn_last4(v)["is_valid"]).collect()} == set(fx.IDENTITIES)
    said = spark.createDataFrame([(i[0],) for i in fx.MESSAGES], "m string")
    assert {tuple(r) for r in said.select("m", validate.find_name(m), validate.find_birth_date(m), validate.find_ssn_last4(m)).collect()} == set(fx.MESSAGES)


def test_dialogue(spark):
    rows = spark.createDataFrame([d[:3] for d in fx.DIALOGUE], "session_id string, turn long, message string")
    orders = spark.createDataFrame(list(fx.ORDERS), "customer_id string, full_name string, dob string, ssn_last4 string, order_id string, shipment_status string, carrier string, estimated_delivery string")
    said = sessions.with_orders(sessions.dialogue(rows), sessions.keyed_orders(orders))
    assert {(r.session_id, r.turn, r.answer) for r in said.collect()} == {(s, n, a) for s, n, _, a in fx.DIALOGUE}
    log = sessions.message_log(rows, said, F.to_timestamp(F.lit("2026-01-01T00:00:00Z")))
    assert {tuple(r) for r in log.select("session_id", "turn", "part", "role", "content", "contains_pii", "tool_result_summary").collect()} == set(fx.MESSAGE_LOG)
    events = sessions.turn_events(said).select("session_id", "turn", "seq", F.get_json_object("log_event", "$.event_type"))
    assert {tuple(r) for r in events.collect()} == set(fx.LOG_EVENTS)


def test_claims(spark):
    events = spark.createDataFrame([(k, "v", k) for k, *_ in fx.INGEST] * 2, "pk string, sk string, key string")
    state = spark.createDataFrame([(k, "v", s, a) for k, s, a, _ in fx.INGEST if s], "pk string, sk string, status string, started_at string")
    got = ingest.claim(events, state, F.to_timestamp(F.lit("2026-01-01T00:20:00Z"))).select("key", "result")
    assert sorted(map(tuple, got.collect())) == sorted((k, r) for k, _, _, r in fx.INGEST)


def test_company_of_a_filing(spark):
    from docloom.operators import filing

    pages = spark.createDataFrame([("f", 1, ["FORM 10-K", "For the fiscal year ended December 31, 2021", " ACME  Stores, Inc.", "(Exact name of registrant as specified in its charter)"]), ("g", 1, ["A letter"])], "doc_id string, page_no int, lines array<string>")
    assert {tuple(r) for r in filing.metadata(pages).collect()} == {("f", "10-K", "2021", "ACME Stores, Inc."), ("g", None, "2019", None)}


def test_vectors_are_all_or_none(spark):
    from docloom.sources import files

    def fails(texts):
        if any("bad" in t for t in texts):
            raise OSError("no answer")
        return [[1.0] * 8 for _ in texts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "content string")
    assert [r.embedding for r in files.embed(rows, fails, 8).collect()] == [None] * 3
    assert all(r.embedding for r in files.embed(rows.where("content <> 'bad'"), fails, 8).collect())


def test_the_index_lies_in_buckets(spark, tmp_path):
    from docloom.sources import files

    docs = spark.createDataFrame([(f"d{i}.md", f"d{i}.md", f"text {i}") for i in range(300)], "path string, name string, text string")
    path = str(tmp_path / "index")
    files.write_index(files.text_chunks(docs), path)
    assert len(list((tmp_path / "index/index_version=1").glob("bucket=*"))) <= files.BUCKETS
    files.write_index(files.text_chunks(docs.where("name = 'd7.md'").withColumn("text", F.lit("new\n\nlines"))), path)
    held = files.read_index(spark, path)
    assert held.count() == 300 and held.where("content = 'new\n\nlines'").count() == 1
    assert files.remove_documents(spark, path, held.where("title <> 'd8'").select("doc_id")) == 299
    assert [r.title for r in files.read_index(spark, path).collect()] == ["d8"]
    assert files.remove_documents(spark, path, files.read_index(spark, path).select("doc_id")) == 1 and files.read_index(spark, path).count() == 0
