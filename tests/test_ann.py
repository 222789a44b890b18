"""Approximate vector search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ann, vector

DATA = "/root/testdata/sf0.01"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def asked_of(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 24))
    return centres[rng.integers(30, size=n)] + 0.4 * rng.normal(size=(n, 24))


@pytest.mark.parametrize("given", ["table", "clusters", "crowd"])
def test_recall(spark, given):
    """On the given table (no clusters at all), on clusters, and where a third is one crowd."""
    crowd = np.vstack([clustered(800), clustered(1)[:1] + 0.01 * np.random.default_rng(2).normal(size=(400, 24))])
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet") if given == "table" else rows_of(spark, clustered(1500) if given == "clusters" else crowd)
    cells = ann.build(rows)
    probes = ann.probes_for(cells, 0.95, 10)
    want = {(r.query_id, r.vec_id) for r in vector.cosine_top(asked_of(rows), rows, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in ann.top(asked_of(rows), cells, 10, probes).collect()}
    assert len(got & want) >= 0.9 * len(want)
    if given == "clusters":
        assert probes <= len(cells.centres) / 3
    assert [tuple(r) for r in ann.top(asked_of(rows), cells, 10).orderBy("query_id", "rank").collect()] == [tuple(r) for r in vector.cosine_top(asked_of(rows), rows, 10).orderBy("query_id", "rank").collect()]


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vector, "SHARD", 50)
    rows = rows_of(spark, clustered(600, 3))
    cells = ann.build(rows, cells=2)
    assert ann.top(asked_of(rows), cells, 5).orderBy("query_id", "rank").collect() == vector.cosine_top(asked_of(rows), rows, 5).orderBy("query_id", "rank").collect()


def test_odd_vectors(spark):
    assert ann.top(rows_of(spark, []).withColumnRenamed("vec_id", "query_id"), ann.build(rows_of(spark, [])), 3).count() == 0
    vectors = [None, [], [1.0] * 7, [0.0] * 8, [1.0] * 8, [1.0] * 8, [2.0] * 12, [float("nan")] * 8, [-1.0] * 8]
    rows = rows_of(spark, vectors)
    asked = rows.withColumnRenamed("vec_id", "query_id")
    assert {r.vec_id for r in ann.top(asked, ann.build(rows), 9).collect()} == {3, 4, 5, 6, 8}
    rows, asked = rows.where("vec_id <> 7"), asked.where("query_id <> 7")
    assert ann.top(asked, ann.build(rows), 4).orderBy("query_id", "rank").collect() == vector.cosine_top(asked, rows, 4).orderBy("query_id", "rank").collect()


def test_ties_go_to_the_left():
    assert vector.chosen(np.array([[1.0, 3, 3, 2, 3], [0, 0, 0, 0, -np.inf]]), 2).tolist() == [[False, True, True, False, False], [True, True, False, False, False]]
