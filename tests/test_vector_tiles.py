"""Exact cosine top k: rows are sent to few blocks of questions, and strips change nothing."""

import random

import numpy as np

from docloom.operators import vector


def test_few_blocks_and_strips_give_the_whole_top(spark, monkeypatch):
    assert -(-30_000 // vector.BLOCK) <= 2  # copies of each row for 30,000 questions
    monkeypatch.setattr(vector, "STRIP", 100)
    draw = random.Random(3)
    rows = [(i, [float(draw.randrange(-3, 4)) for _ in range(16)]) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in vector.cosine_top(frame.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), frame, 7).collect()}
    held = np.array([v for _, v in rows])
    norms = np.linalg.norm(held, axis=1)
    want = set()
    for q in range(0, 90, 20):
        both = norms[q] * norms
        scores = np.round(np.divide(held @ held[q], both, out=np.zeros(90), where=both > 0), 9)
        want |= {(q, n, int(i)) for n, i in enumerate(np.lexsort((np.arange(90), -scores))[:7], 1)}
    assert got == want
