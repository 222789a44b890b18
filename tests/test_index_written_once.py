"""Upkeep of the index: postings are written once to build it, and what is pending is moved."""

import glob

from docloom.operators import index

FIELDS = {"body": "text"}


def test_build_writes_postings_once_and_upkeep_moves_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i} w{i % 7} common") for i in range(300)], "id long, text string")
    path, made = str(tmp_path / "index"), []
    real = index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, name: made.append(name) or real(df, name))
    index.build(rows, path, "id", FIELDS)
    assert made == []
    files = glob.glob(f"{path}/postings/bucket=*/*.parquet")
    assert len(files) == len({f.split("/")[-2] for f in files}) == index.BUCKETS
    tasks = {f.split("part-")[1][:5] for f in files}
    assert len(tasks) == index.BUCKETS  # no task has two buckets
    pending = {}
    finish = index._finish
    monkeypatch.setattr(index, "_finish", lambda s, p: (pending.setdefault("names", set()).update(f.rsplit("/", 1)[1] for f in glob.glob(f"{p}/_pending/postings/bucket=*/*.parquet")), finish(s, p))[1])
    index.replace(spark.createDataFrame([(5, "fresh")], "id long, text string"), path, "id", FIELDS)
    now = {f.rsplit("/", 1)[1] for f in glob.glob(f"{path}/postings/bucket=*/*.parquet")}
    assert pending["names"] and pending["names"] <= now  # the files themselves are in place
    assert {r.term for r in index.read(spark, path)["postings"].where("id = 5").collect()} == {"fresh"}
