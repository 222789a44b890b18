"""Connected components of a link table, as DataFrame rounds (native).

Alternating large-star and small-star steps: every node's larger neighbours, then its
smaller ones, are linked to the smallest node it sees.  Each round is a few shuffles of
the links alone; depth shrinks geometrically, so rounds grow with the logarithm of the
longest chain.  Hot nodes combine before the shuffle (a minimum) and meet their links in
skew-splittable joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.storage import materialize


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger node has one link and is no other's smaller one: nothing is left
    to do, since links keep their component in every step."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionAll(links.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("ends"))
    return seen.where("ups > 1 OR (ups = 1 AND ends > 1)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, name: str) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every linked node; the root is the smallest."""
    current = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links"
    )
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # both uses of the large star read one shuffle
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mine = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mine, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(small.unionAll(mine.select("a", F.col("m").alias("b"))).distinct(), f"{name}-stars")
        if _are_stars(current):
            break
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
