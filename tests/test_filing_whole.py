"""Filings: a document's own lines take part, and no table that grows with documents is broadcast."""

import duckdb

from docloom.operators import filing
from docloom.plans import queries as registry


def test_own_lines_make_facts_as_by_the_sql(spark, tmp_path):
    texts = ["We lease 40 floors in the old town hall\nwe lease floors in the old town hall\nNothing here", "From time to time there is a market risk; and more\n \nshort we own", None, "", "A table of contents, and we operate a mill by the river",
             "\n".join(["we maintain " + "word " * 120, "WE OWN\ta house by the wide river", "we own a house by the wide river", "we owned a house by the wide river"])]
    documents = spark.createDataFrame([(i, x, "en", "web", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["filing_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['filing_chunks']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    own = [r[0] for r in got if r[1:3] == ("fact", "Item 2. Properties")]
    assert sorted(own) == [0, 0, 1, 1, 2, 3, 5, 5]


def test_risk_sections_are_not_broadcast_for_a_small_file(spark):
    one = "doc_id int, block_id int, part string, item string, page_start int, page_end int, lines array<string>"
    blocks = spark.createDataFrame([(i, 0, "PART I", filing.rules.ITEM_1A, 1, 1, ["We Face Much Competition", "Our rivals are many."]) for i in range(3)], one)
    found = filing.all_risk_sections(blocks)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
