"""The transaction log, the embedding cells and the filter audit against brute force, and on
nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import embedding_cells as cells, filter_audit, txlog

CLASHING = ("seq", "txn", "rank", "part", "key", "crc", "node", "n", "v", "h", "mask", "step", "kind", "_text", "_n", "level")
LONG = "word soup " * 40_000


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# --- transaction log ------------------------------------------------------------------


def replayed(docs, toxic, epoch=txlog.EPOCH):
    """The log, record by record; equal ids by source, deletions first, then by checksum."""
    out, store, open_, commits = [], {}, collections.defaultdict(list), 0
    told = []
    for doc, text, source in docs:
        if doc is not None:
            h = zlib.crc32(str(doc).encode())
            key = h // 100 % txlog.KEYS
            crc = None if text is None or doc in toxic else zlib.crc32(f"{key}:{text}".encode())
            told.append((doc, "n" if source is None else f"s{source}", -1 if crc is None else crc, h % 17, key))
    for doc, source, crc, kind, key in sorted(told):
        mine = open_[source]
        if kind <= 1:
            commits += 1
            for x in mine:
                if x and x[2] < 0:
                    store.pop(x[1], None)
                elif x:
                    store[x[1]] = x[2]
            mine.clear()
            if commits % epoch == 0:
                out.append(("state", commits // epoch, len(store), sum(store.values())))
        elif kind == 2:
            out += [("abort", x[0], doc, x[1]) for x in mine if x]
            mine.clear()
        elif kind <= 4:
            mine.append(None)
        elif kind <= 6:
            while mine and mine[-1]:
                x = mine.pop()
                out.append(("rollback", x[0], doc, x[1]))
        else:
            mine.append((doc, key, crc))
    out += [("abort", x[0], None, x[1]) for mine in open_.values() for x in mine if x]
    if commits % epoch:
        out.append(("state", commits // epoch + 1, len(store), sum(store.values())))
    return sorted(out, key=str)


def reassembled(spark, docs, labels):
    rows = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    told = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted((tuple(r) for r in txlog.reassemble(rows, told).collect()), key=str)


@pytest.mark.parametrize("n, sources, keys", [(3000, 5, 30_000), (2500, 1, 7), (400, 400, 3)])
def test_log_equals_its_replay(spark, monkeypatch, n, sources, keys):
    monkeypatch.setattr(txlog, "KEYS", keys)
    rng = np.random.default_rng(n)
    ids = rng.choice(10 * n, n, replace=False) - n
    hot = lambda: None if rng.random() < 0.1 else "hot" if rng.random() < 0.33 else f"s{rng.integers(sources)}"
    docs = [(int(i), None if rng.random() < 0.1 else "" if rng.random() < 0.1 else f"text {rng.integers(50)}", hot()) for i in ids]
    toxic = [int(i) for i in rng.choice(ids, n // 10)]
    labels = [(i, 1, 1) for i in toxic] + [(toxic[0], 0, 0), (None, 1, 1), (int(ids[-1]), None, None)]
    assert reassembled(spark, docs, labels) == replayed(docs, set(toxic))


def test_log_edge_cases(spark):
    assert reassembled(spark, [], []) == []
    docs = [(i, LONG if i % 50 == 0 else "t", None if i % 3 else "") for i in range(300)]
    docs += docs[40:160] + [(None, "no id", "a")] * 3 + [(i, f"other {i}", "b") for i in range(100, 130)]  # repeated rows and ids
    assert reassembled(spark, docs, []) == replayed(docs, set())
    uncommitted = [d for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 17 > 1]
    got = reassembled(spark, uncommitted, [])
    assert got == replayed(uncommitted, set()) and {r[0] for r in got} == {"abort", "rollback"}


# --- embedding cells ------------------------------------------------------------------


def linked(vectors, threshold=0.9):
    """id row -> (links, smallest reachable id, kept) by comparing everything."""
    ok = [i for i, (k, v) in enumerate(vectors) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(vectors[i][1]) for i in ok), default=1)
    m = np.array([list(vectors[i][1]) + [0.0] * (width - len(vectors[i][1])) for i in ok]).reshape(-1, width)
    m = m / np.abs(m).max(1, keepdims=True) if len(m) else m
    s = (m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.array([min(label[i], *label[s[i]]) if s[i].any() else label[i] for i in range(len(ok))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (k, _) in enumerate(vectors):
        if i in (at := {row: a for a, row in enumerate(ok)}):
            root = min(vectors[ok[j]][0] for j in np.flatnonzero(label == label[at[i]]))
            out.append((k, int(s[at[i]].sum()), root, k == root))
        else:
            out.append((k, 0, k, True))
    return sorted(out, key=str)


def deduplicated(spark, vectors, **options):
    df = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    return sorted((tuple(r) for r in cells.near_duplicates(df, **options).collect()), key=str)


def crowds(rng, n, d, groups):
    """Random vectors, some of them with crowds of near copies around the threshold."""
    out = [rng.normal(size=d) for _ in range(n)]
    for _ in range(groups):
        base = rng.normal(size=d)
        for _ in range(rng.integers(2, 30)):
            out.append(base + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.33, 0.45]))
    return out


@pytest.mark.parametrize("d, sigmas", [(64, 4.0), (64, None), (8, 4.0), (2, 4.0)])
def test_cells_find_all_links(spark, monkeypatch, d, sigmas):
    monkeypatch.setattr(cells, "BLOCK", 40)  # many tiles in a cell
    rng = np.random.default_rng(d)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(crowds(rng, 150, d, 12))]
    vectors += [(1000 + i, vectors[3][1]) for i in range(100)] + [(2000, [2 * x for x in vectors[3][1]])]  # copies
    assert deduplicated(spark, vectors, sigmas=sigmas) == linked(vectors)


def test_recall_at_the_threshold(spark):
    """Pairs of exactly the cosine that is hardest to find, among vectors without clusters."""
    rng, vectors = np.random.default_rng(5), []
    unit = lambda x: x / np.linalg.norm(x)
    for i in range(1500):
        x = unit(rng.normal(size=64))
        y = rng.normal(size=64)
        y = unit(y - (y @ x) * x)
        vectors += [(2 * i, (10 * x).tolist()), (2 * i + 1, (0.9000001 * x + math.sqrt(1 - 0.9000001**2) * y).tolist())]
    got = deduplicated(spark, vectors)
    assert sum(r[1] == 1 for r in got) >= 0.999 * len(vectors)
    assert sum(r[1] for r in deduplicated(spark, vectors[:600], sigmas=None)) == 600


def test_cells_edge_cases(spark):
    assert deduplicated(spark, []) == []
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    assert deduplicated(spark, odd) == linked(odd)
    vectors = odd + [(7, [1e300, 1e300]), (8, [1e-300, 1e-300]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.1]), (7, [1e300, 1e300]), (10, [-1.0, -1.0]), (11, [3.0]), (12, [9.0, math.sqrt(19.0)]), (13, [0.0, 1.0])]
    assert deduplicated(spark, vectors) == linked(vectors)


def test_near_copies_share_a_cell():
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    points = np.vstack([base + rng.normal(size=(500, 64)) * 0.05, rng.normal(size=(500, 64))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = cells.fit(points, 60)
    assert len(set((points[:500] @ centres.T).argmax(axis=1))) == 1 and 30 < len(centres) <= 60
    assert np.triu(centres @ centres.T, 1).max() < cells.APART


# --- filter audit ---------------------------------------------------------------------


def audited(docs, labels):
    """Every document through every order, one step at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = collections.defaultdict(lambda: dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), 0))
    for d, t, source in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and text in least and d > least[text]}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[source or "", order, step]
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                row["redundant"] += fails[f] and gone
                row["removed"] += (now := fails[f] and not gone)
                row["good_lost"] += now and d in good
                row["toxic_lost"] += now and d in toxic
                gone = gone or fails[f]
                row["kept"] += not gone
    total = collections.Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row["removed"]
    for (part, order, step), row in out.items():
        row["shapley"] = total[part, order[step - 1]]
    return dict(out)


def audit(spark, docs, labels):
    rows = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    told = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [r.asDict() for r in filter_audit.interactions(rows, told).collect()]
    return {(r.pop("part"), r.pop("filter_order"), r.pop("step")): r for r in got}


def test_audit_equals_running_every_order(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t", LONG, "Ünï #1", "A B C D", "Ä" * 30] + [" ".join(rng.choice(["one", "Two", "x$", "THREE", f"w{rng.integers(99)}", f"z{rng.integers(99)}"], rng.integers(1, 120))) for _ in range(40)]
    docs = [(i if i % 29 else None, texts[rng.integers(len(texts))], [None, "", "a", "b"][rng.integers(4)]) for i in range(240)]
    docs += [(77, texts[8], "a"), (77, texts[8], "b"), (77, texts[8], "b"), (-5, texts[9], "c"), (-5, texts[9], "c")] + [(1000 + i, texts[8], "hot") for i in range(120)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 240, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    got, want = audit(spark, docs, labels), audited(docs, labels)
    assert got.keys() == want.keys() and [(k, got[k], want[k]) for k in want if got[k] != want[k]][:3] == []


def test_audit_of_nothing(spark):
    assert audit(spark, [], []) == {}
    only = audit(spark, [(1, "x", "s")], [])
    assert len(only) == 600 and only["s", "ABCDE", 1]["removed"] == 1 and only["s", "BACDE", 1]["kept"] == 1 and only["s", "ABCDE", 1]["shapley"] == 120


def test_outcomes_of_a_step_are_a_partition():
    m = filter_audit.incidence()
    assert {v.shape for v in m.values()} == {(32, 600)}
    assert (m["kept"] + m["removed"] + m["redundant"] <= 1).all() and (m["unique_fails"] <= m["removed"]).all()
    assert len(set(filter_audit.ORDERS)) == math.factorial(5) and pd.Series(filter_audit.ORDERS).str.len().eq(5).all()


# --- faults mended in the other operators ----------------------------------------------


def test_names_are_never_torn(spark):
    from docloom.llm import surrogates

    said = [
        (1, "Mr McDonald came; McDonald left, MCDONALD too."), (2, "Mrs O'Neil and Dr D’Arcy-Lee."), (3, "Señor Núñez-Díaz. NÚÑEZ-DÍAZ signed, and Núñez-Díaz again."),
        (4, "MR BRUN shouted. Mr Brun wrote. Herr BRUN, Brun's."), (5, "reach ::1 or ::ffff:1a2 now, std::vector and a :: add stay"), (6, "Miss the train; MISS THE TRAIN; MS DOS and Mr mcx stay"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    gone = ("McDonald", "Donald", "MCDONALD", "Neil", "Arcy", "Núñez", "Díaz", "NÚÑEZ", "DÍAZ", "BRUN", "Brun", "::1 ", "::ffff")
    assert [(n, w) for n in range(1, 6) for w in gone if w in got[n].text] == []
    first = re.fullmatch(r"Mr (\w+) came; (\w+) left, (\w+) too\.", got[1].text)
    assert first[1] == first[2] and first[3] == first[1].upper()
    loud = re.fullmatch(r"MR (\w+) shouted\. Mr (\w+) wrote\. Herr (\w+), (\w+)'s\.", got[4].text)
    assert loud[1] == loud[3] == loud[2].upper() and loud[2] == loud[4]
    assert got[6].text == said[5][1] and "std::vector and a :: add stay" in got[5].text


def test_many_small_contents_spill():
    from docloom.llm import grace

    rows = [(zlib.crc32(str(i).encode()) * 2654435761 % 2**64, b"%d" % (i % 4000), i, 1) for i in range(8000)]
    rows = [(zlib.crc32(c) * 2654435761 % 2**64, c, i, n) for _, c, i, n in rows]
    table = grace.ContentTable()
    table.add(*rows[0])
    assert table.bytes > grace.ENTRY_BYTES
    got = sorted((bytes(c), i, n) for _, c, i, n in grace.grace(iter(rows), limit=100_000))
    assert got == sorted((b"%d" % i, i, 2) for i in range(4000))


def test_codewords_of_many_languages_are_apart():
    import time

    from docloom.llm import langid

    began = time.process_time()
    code = langid.codewords(200)
    assert time.process_time() - began < 5 and code.shape == (200, 31) and len({tuple(r) for r in code}) == 200
    small = langid.codewords(12)
    assert min((small[i] != small[j]).sum() for i in range(12) for j in range(i)) >= 6
