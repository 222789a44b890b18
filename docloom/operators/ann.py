"""Approximate cosine top k: coarse cells, probes by nearest centroid, exact scores.

Rows lie in the cell of their nearest centroid.  A question is compared with the rows of
the cells whose centroids are nearest to it, exactly; how many cells that takes for a
wanted recall is not guessed but read off the true neighbours of a bounded sample of rows.
All cells make the search exact.

Centroids, at most ``CELLS``, are fitted in one task on at most ``SAMPLE`` rows, and with a
count for each are what the driver and the tasks get.  A cell is compared in shards of
``vector.SHARD`` rows and blocks of ``vector.BLOCK`` questions, so one that holds most rows,
or that all ask for, is many tasks, and none holds more than a tile.

Vectors that are null, too short or not of finite numbers take no part; zero vectors are in the first
cell and score 0.
"""

from __future__ import annotations

from dataclasses import dataclass
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from docloom.functions.text import sound_vector
from docloom.operators import vector
from docloom.storage import materialize, shuffle_width

CELLS, SAMPLE, ROUNDS, ASKED = 1024, 20_000, 10, 256


def _unit(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: min(len(v), width)] = v[:width]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def spherical_means(points: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` unit centroids; a cell that gets empty takes the point farthest from
    its own."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(ROUNDS):
        near, best = np.empty(len(points), int), np.empty(len(points))
        for at in range(0, len(points), 1024):
            cos = points[at : at + 1024] @ centres.T
            near[at : at + 1024], best[at : at + 1024] = cos.argmax(axis=1), cos.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = points[np.argsort(best, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


@dataclass
class Cells:
    """Rows (row_id, v, cell) and their centroids."""

    rows: DataFrame
    centres: np.ndarray
    n: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _ranked(vectors: DataFrame, id_column: str, kind: str, column: str, cells: Cells | np.ndarray, most: int) -> DataFrame:
    """id, vector, cells: the ``most`` nearest cells of each vector, nearest first.  A
    vector leaves Python once, however many its cells are."""
    centres = cells if isinstance(cells, np.ndarray) else cells.centres
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                order = np.argsort(-(_unit(some[column], c.shape[1]) @ c.T), axis=1, kind="stable")[:, :most]
                yield pd.DataFrame({id_column: some[id_column].to_numpy(), column: some[column].to_numpy(), "cells": list(order.astype(np.int32))})

    return vectors.select(id_column, column).mapInPandas(run, f"{id_column} {kind}, {column} array<double>, cells array<int>")


def _sound(column: str):
    finite = F.forall(column, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, sound_vector(F.col(column)))


def build(rows: DataFrame, key: str = "vec_id", cells: int | None = None) -> Cells:
    """Cells of ``rows`` (key, embedding); by default about the root of their number."""
    sound = rows.select(F.col(key).cast("long").alias("row_id"), _sound("embedding").alias("v")).where("v is not null")
    sound = materialize(sound, "ann-rows")
    n, width = sound.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return Cells(sound.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 0)
    k = min(CELLS, cells or math.isqrt(n - 1) + 1)
    share = min(1.0, 1.1 * SAMPLE / n)
    drawn = sound.withColumn("draw", F.xxhash64("row_id")).where(F.pmod("draw", F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["draw", "row_id"]).iloc[:SAMPLE]
        points = _unit(sample["v"], width)
        return pd.DataFrame({"c": list(spherical_means(points, k))})

    found = drawn.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "c array<double>").collect()
    centres = np.array([r.c for r in found])
    placed = _ranked(sound.repartition(2 * shuffle_width(sound.sparkSession)), "row_id", "long", "v", centres, 1)
    placed = placed.select("row_id", "v", F.col("cells")[0].alias("cell"))
    return Cells(materialize(placed.sortWithinPartitions("cell"), "ann-cells"), centres, n)


def probes_for(cells: Cells, recall: float, k: int) -> int:
    """The fewest cells to probe so that ``recall`` of the true k nearest are found, by
    the places that the cells of true neighbours have for ``ASKED`` rows as questions."""
    one_in = max(1, cells.n // ASKED)
    asked = cells.rows.where(F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(one_in)) == 0)
    asked = materialize(asked.select(F.col("row_id").alias("query_id"), F.col("v").alias("embedding")), "ann-asked")
    true = vector.cosine_top(asked, cells.rows.withColumnRenamed("v", "embedding"), k, "row_id")
    places = _ranked(asked, "query_id", "long", "embedding", cells, len(cells.centres)).select("query_id", F.posexplode("cells").alias("place", "cell"))
    met = true.join(cells.rows.select("row_id", "cell"), "row_id").join(places, ["query_id", "cell"])
    counts = {r.place: r["count"] for r in met.groupBy("place").count().collect()}  # a number for each cell at most
    found, total = 0, sum(counts.values())
    for place in range(len(cells.centres)):
        found += counts.get(place, 0)
        if found >= recall * total:
            return place + 1
    return len(cells.centres)


def top(questions: DataFrame, cells: Cells, k: int, probes: int | None = None, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank: as ``vector.cosine_top``, over the rows of the
    ``probes`` nearest cells of each question (query_id, embedding); None: of all."""
    spark = questions.sparkSession
    width = shuffle_width(spark)
    q = questions.select(F.col("query_id").cast("long").alias("query_id"), _sound("embedding").alias("q")).where("q is not null")
    counts = {r.cell: r["count"] for r in cells.rows.groupBy("cell").count().collect()}  # a number for each cell
    counts = [counts.get(c, 0) for c in range(len(cells.centres))]
    if probes is None or probes >= len(counts):
        # all rows are asked for: cells that hold little are compared together
        before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        part_of = (before // vector.SHARD).tolist()
        asked = q.withColumn("part", F.explode(F.lit(sorted(set(part_of)))))
        n_asked = dict.fromkeys(part_of, q.count())
    else:
        part_of = list(range(len(counts)))
        asked = materialize(_ranked(q, "query_id", "long", "q", cells, probes), "ann-probes").withColumn("part", F.explode("cells")).drop("cells")
        n_asked = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}  # a number for each cell
    held = {part: 0 for part in part_of}
    for part, n in zip(part_of, counts, strict=True):
        held[part] += n
    most = max(part_of) + 1
    shards = F.lit([-(-held.get(p, 0) // vector.SHARD) for p in range(most)])
    blocks = F.lit([max(1, -(-n_asked.get(p, 0) // vector.BLOCK)) for p in range(most)])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # a tile is a shard of rows and a block of questions, of bounded size both
    left = asked.withColumns({"shards": F.get(shards, "part"), "block": F.pmod(F.hash("query_id"), F.get(blocks, "part"))}).where("shards > 0").withColumn("shard", every(F.col("shards"))).drop("shards")
    right = cells.rows.withColumn("part", F.get(F.lit(part_of), "cell")).drop("cell")
    right = right.withColumn("shard", F.pmod(F.hash("row_id"), F.get(shards, "part"))).withColumn("block", every(F.get(blocks, "part")))
    by = ("part", "shard", "block")
    tiles = left.repartition(width, *by).groupBy(*by).cogroup(right.repartition(width, *by).groupBy(*by)).applyInPandas(vector.tile_of(k, False), "query_id long, row_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("row_id").alias(key), "score", "rank")
