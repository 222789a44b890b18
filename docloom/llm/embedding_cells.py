"""Near duplicates among embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one node first, with their number.  Cells are fitted on a bounded sample
and every node is assigned to the cell of its nearest centroid.  Two nodes with a cosine
of ``threshold`` may lie on both sides of a border, so a node close to a border also visits
the cell behind it: with m the distance of a node to the bisecting plane of two centroids,
|x - y| <= r makes m(x) + m(y) <= r, so one of both is within r / 2.  That bound is exact
(``sigmas=None``).  By default a node visits only cells within ``sigmas`` / sqrt(d) of it,
because the difference of two near vectors in d dimensions has about |x - y| / sqrt(d) in
any one direction; that keeps visits few and independent of the number of cells, and in up
to sigmas ** 2 dimensions is the exact bound again.

A cell is compared in tiles of ``BLOCK`` by ``BLOCK`` nodes, however large it is, so a
group of near copies that a third of all vectors belong to is many tiles, not one task.  A
tile gives a row for each of its nodes, with the number of its links and the smallest node
of its group in the tile, never a row for each pair; those stars are joined to components.

Broadcast and sent to the driver are the centroids and two counts for each cell, ``CELLS``
of them at most.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without vec_id, link with nothing and are kept; missing components of shorter vectors
count as 0; rows of one vec_id are vectors of their own; vectors of any length compare
without overflow; a cosine within 1e-9 of the threshold is computed anew, rounded once; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docloom.llm.components import components
from docloom.storage import Scratch, materialize, shuffle_width

#: Cells at most, vectors they are fitted on at most, rounds of fitting, nodes of a tile's side.
CELLS, SAMPLE, ROUNDS, BLOCK = 4096, 16_384, 8, 2048
#: Centroids closer than this are one, so that a crowd of near copies gets one cell.
APART = 0.8
_TILE = "node long, links long, least long"


def _unit(vectors, width: int) -> np.ndarray:
    """Unit vectors as rows, scaled first so that no square overflows or vanishes."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 5e-324)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _spread(points: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` points of which no two are closer than ``APART``."""
    chosen, at = points[:1], 1
    while len(chosen) < k and at < len(points):
        some = points[at : at + 512]
        at += 512
        for x in some[(some @ chosen.T).max(axis=1) < APART]:
            if len(chosen) < k and (chosen @ x).max() < APART:
                chosen = np.vstack([chosen, x])
    return chosen


def fit(points: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: at most ``k`` unit centroids of unit ``points``."""
    centres = _spread(points, k)
    for _ in range(ROUNDS):
        near = np.concatenate([(points[at : at + 1024] @ centres.T).argmax(axis=1) for at in range(0, len(points), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return _spread(centres, k)


def _assign(centres, width: int, reach: float):
    """A batch of nodes -> their cell and the cells they visit."""

    def run(batches):
        c = centres.value
        apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
        for batch in batches:
            homes, visits = [], []
            for at in range(0, len(batch), 512):
                cos = _unit(batch["v"].iloc[at : at + 512], width) @ c.T
                home = cos.argmax(axis=1)
                rows = np.arange(len(home))
                margin = (cos[rows, home][:, None] - cos) / apart[home]
                margin[rows, home] = np.inf
                homes.append(home)
                visits += [np.flatnonzero(m).astype(np.int32) for m in margin <= reach]
            yield pd.DataFrame({"node": batch["node"], "n": batch["n"], "v": batch["v"], "home": np.concatenate(homes).astype(np.int32) if homes else [], "visits": visits})

    return run


class _Groups:
    """Which nodes of a tile hang together."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, own: int, others: np.ndarray) -> None:
        met = self.label[others]
        least = min(met.min(), self.label[own])
        if self.label[own] != least or (met != least).any():
            self.label[np.isin(self.label, np.append(met, self.label[own]))] = least


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine, of sums that are rounded once."""
    x, y = x / max(np.abs(x).max(), 5e-324), y / max(np.abs(y).max(), 5e-324)
    size = min(len(x), len(y))
    return math.fsum(x[:size] * y[:size]) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _compare(threshold: float, width: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        cell, p, q = key
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        if p < 0:  # visitors of the cell against its own
            left, right = (np.flatnonzero(m) for m in ((rows["home"] != cell).to_numpy(), (rows["home"] == cell).to_numpy()))
        else:
            left, right = (np.flatnonzero((rows["block"] == b).to_numpy()) for b in (p, q))
        x, held, n = _unit(rows["v"], width), rows["v"], rows["n"].to_numpy()
        links, groups = np.zeros(len(rows), np.int64), _Groups(len(rows))
        met_before = None
        if p < 0:  # a pair of which both visit the other's cell is compared in the smaller cell
            home = rows["home"].to_numpy()
            lower = {int(h) for h in home[left] if h < cell}
            met_before = {h: np.array([h in set(v) for v in rows["visits"].iloc[right]], bool) for h in lower}
        for at in range(0, len(left) if len(right) else 0, 256):
            strip = left[at : at + 256]
            cos = x[strip] @ x[right].T
            linked = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):
                linked[i, j] = _exact(np.asarray(held[strip[i]]), np.asarray(held[right[j]])) >= threshold
            if p == q:
                linked &= strip[:, None] != right[None]
            for i, own in enumerate(strip):
                line = linked[i]
                if met_before is not None and (h := int(home[own])) in met_before:
                    line = line & ~met_before[h]
                if line.any():
                    others = right[line]
                    links[own] += n[others].sum()
                    if p != q:
                        links[others] += n[own]
                    groups.join(own, others)
        found = links > 0
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node[found], "links": links[found], "least": node[groups.label[found]]})

    return run


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): vec_id and the key of each row's vector, null where it takes no part;
    node, key, v, n (rows), first (smallest vec_id) of each distinct vector."""
    cells = F.transform("embedding", lambda x: x.cast("double"))
    sound = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    part = vectors.select("vec_id", cells.alias("_v")).select("vec_id", F.when(F.col("vec_id").isNotNull() & sound, F.col("_v")).alias("v"))
    rows = part.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    rows = materialize(rows, "cells-rows")
    # the copies of a vector are counted before they are shuffled
    distinct = rows.where("h is not null").groupBy("h", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return rows.drop("v"), materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "cells-nodes")


def centroids(known: DataFrame, n: int, width: int, k: int) -> np.ndarray:
    """At most ``k`` centroids, fitted in one task on at most ``SAMPLE`` vectors: those of
    the smallest hash."""
    wanted = min(1.0, 1.1 * SAMPLE / max(n, 1))
    drawn = known.select("v", F.xxhash64(F.lit(7), "h", "h2").alias("draw")).where(F.col("draw") < int((2 * wanted - 1) * (2**63 - 1)) if wanted < 1 else F.lit(True))

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("draw").iloc[:SAMPLE]
        return pd.DataFrame({"c": list(fit(_unit(sample["v"], width), k))})

    found = drawn.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "c array<double>").collect()
    return np.array([r.c for r in found]).reshape(-1, width)


def tiles(assigned: DataFrame, cells: int) -> DataFrame:
    """cell, p, q and a node for each tile the node is in: p and q are blocks of the cell,
    or p < 0 is a block of its visitors."""
    def blocks(counts: DataFrame, column: str):
        held = [0] * cells
        for r in counts.groupBy(column).count().collect():  # a row for each cell at most
            held[r[column]] = -(-r["count"] // BLOCK)
        return F.lit(held)

    own, guests = blocks(assigned, "home"), blocks(assigned.select(F.explode("visits").alias("c")), "c")
    rows = assigned.withColumns({"own": own, "guests": guests}).withColumn("block", F.pmod(F.hash("node"), F.get("own", "home")))
    return rows.selectExpr("node", "n", "v", "home", "visits", "block", """
        inline(concat(
          transform(sequence(0, own[home] - 1), j -> struct(home as cell, least(block, j) as p, greatest(block, j) as q)),
          if(guests[home] > 0, transform(sequence(1, guests[home]), u -> struct(home as cell, -u as p, block as q)), array()),
          flatten(transform(filter(visits, c -> own[c] > 0), c -> transform(sequence(0, own[c] - 1), j -> struct(c as cell, -1 - pmod(hash(node), guests[c]) as p, j as q))))))""")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sigmas: float | None = 4.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    with Scratch() as scratch:
        rows, known = nodes(vectors)
        n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
        if not n:
            return scratch.leave(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
        centres = centroids(known, n, width, min(CELLS, math.isqrt(n - 1) + 1))
        share = 1.0 if sigmas is None else min(1.0, sigmas / math.sqrt(width))
        reach = math.sqrt(2 - 2 * threshold) / 2 * share + 1e-9
        held = spark.sparkContext.broadcast(centres)
        assigned = materialize(
            known.select("node", "n", "v").repartition(4 * shuffle_width(spark)).mapInPandas(_assign(held, width, reach), "node long, n long, v array<double>, home int, visits array<int>"), "cells-assigned")
        dealt = tiles(assigned, len(centres))
        found = materialize(dealt.groupBy("cell", "p", "q").applyInPandas(_compare(threshold, width), _TILE), "cells-links")
        linked = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), "cells")
        grouped = known.drop("v").join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grouped = materialize(grouped, "cells-grouped")
        least = grouped.groupBy("root").agg(F.min("first").alias("component"))
        told = grouped.join(least, "root").select("h", "h2", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
        component = F.coalesce("component", "vec_id")
        out = rows.join(told, ["h", "h2"], "left").select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
        return scratch.leave(out)
