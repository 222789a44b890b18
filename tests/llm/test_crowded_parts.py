"""Near duplicates: members of a crowded bucket read out prefixes of their parts alone, and lose no pair."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import order_minhash as omh


def test_prefixes_find_all_pairs_and_are_short(spark, monkeypatch):
    """Unlike texts around one passage, and sets around the threshold."""
    rng, sets = random.Random(41), []
    passage = list(range(100))
    sets += [passage[:70] + [rng.randrange(10**9) + 1000 for _ in range(70)] for _ in range(150)]
    for _ in range(10):
        base = [rng.randrange(10**9) + 1000 for _ in range(60)]
        sets += [base[k:] + [rng.randrange(10**9) + 1000 for _ in range(k)] for k in (0, 2, 5, 7)]
    rows = [(bytearray(b""), bytearray(i.to_bytes(2, "big")), bytearray(i.to_bytes(2, "big")), len(s), 0, 0, 4 * len(s), s) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "centre binary, node binary, root binary, n int, n_centre int, common int, weight long, parts array<long>")
    made, real = {}, omh.materialize
    monkeypatch.setattr(omh, "materialize", lambda df, name: made.setdefault(name, real(df, name)))
    got = {(bytes(r.a), bytes(r.b)) for r in omh._by_parts(frame).collect()}
    key = [bytes(r[1]) for r in rows]
    want = {(key[i], key[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert want <= got and len(want) > 20
    read = made["omh-prefixes"].agg(F.sum(F.size("prefix"))).first()[0]
    assert read < 0.25 * sum(map(len, sets))
    assert made["omh-told"].count() < 0.05 * sum(map(len, sets))  # the passage's parts meet nobody


def test_sketches_leave_some_texts_at_a_time():
    n = 2 * omh.TEXTS + 5
    texts = ["", "one two", *[" ".join(f"w{i}.{k}" for k in range(12)) for i in range(n - 2)]]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, n)], pa.int64()), pa.array([b"k"] * n, pa.binary()), pa.array(texts)], ["doc_id", "text_key", "text"])
    got = list(omh._sketches([batch]))
    assert [b.num_rows for b in got] == [omh.TEXTS, omh.TEXTS, 5]
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in rows] == [None, *range(1, n)] and rows[0]["sketch"] is None and len({r["node"] for r in rows}) == n
    for r, text in zip(rows[1:], texts[1:], strict=True):
        s = omh.shingles(omh.word_hashes(text))
        assert r["n"] == len(s) and r["sketch"] == [*omh.sketch(s), *omh.short_buckets(s)]
