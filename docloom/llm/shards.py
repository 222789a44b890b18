"""Proportional stratified interleaving into shards (native).

Rows of each source are shuffled by a seeded hash and ranked; the rank over the source's
size is a fraction in (0, 1); all rows are ordered by it and the order is cut into equal
stretches.  Every stretch then holds each source in proportion to its share.

Edge cases: a null source is a source of its own; null text has no bytes; an empty table
gives an empty result; repeated rows are separate rows with equal columns, so it does not
matter which of them gets which slot.  Other columns are carried when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docloom.llm.columns import running_totals, stratum
from docloom.storage import materialize, shuffle_width


def interleave(rows: DataFrame, shards: int, seed: int, identity: list[Column], source: str = "source") -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``; counts of shards are at most one apart.

    ``identity`` orders rows whose hash is equal; rows that agree in it are interchangeable.
    Two narrow shuffles: one for ranks within (source, bucket), one for positions within
    cells of the fraction.  No task holds more than a bucket or a cell.
    """
    taken = rows.withColumn("_k", stratum(source)).withColumn("_h", F.xxhash64(F.lit(seed), *identity))
    ranked = running_totals(taken, "_k", F.col("_h"), [F.col("_h"), *identity], F.lit(1))
    ranked = ranked.withColumn("_f", (2 * F.col("before") + 1) / (2 * F.col("total")))
    cells = 8 * shuffle_width(rows.sparkSession)
    celled = materialize(ranked.withColumn("_c", F.least(F.floor(F.col("_f") * cells), F.lit(cells - 1)).cast("int")), "shard-ranks")
    counts = celled.groupBy("_c").agg(F.count("*").alias("_n"))
    every = W.orderBy("_c")  # a row for each cell: bounded by the shuffle width
    offsets = counts.select(
        "_c",
        F.coalesce(F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"),
    )
    place = F.row_number().over(W.partitionBy("_c").orderBy("_f", "_k", "_h", *identity))
    placed = celled.join(offsets, "_c").withColumn("_p", F.col("_o") + place - 1)
    shard = F.expr(f"(_p * {shards}) div _all")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_p") - F.expr(f"(shard * _all + {shards - 1}) div {shards}"))
        .drop("_k", "_h", "_f", "_c", "_o", "_all", "_p", "before", "total")
    )


def digest(docs: DataFrame) -> DataFrame:
    """Narrow rows of ``documents``: id, source, size in bytes plus one, CRC of the text."""
    return docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
