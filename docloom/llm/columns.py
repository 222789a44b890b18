"""Column helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docloom.storage import shuffle_width

#: The separators of the corpus contracts: space and the ASCII controls TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-separators, as long."""
    parts = F.size(F.split(text, SPACE, -1))
    edges = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(parts - edges).cast("long")


def stratum(column: str) -> Column:
    """A join-safe key for a nullable label: null is a stratum of its own."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column)))


def running_totals(df: DataFrame, key: str, spread: Column, order: list[Column], value: Column) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows of the key) and ``total``.

    A window over a whole key would put a hot key into one task.  Rows are dealt by
    ``spread`` (a uniform hash) into buckets, several for each shuffle partition; bucket
    sums are small and get running offsets, and only rows of one bucket are ordered
    together.  The order within a key is (bucket, ``order``).
    """
    width = 8 * shuffle_width(df.sparkSession)
    dealt = df.withColumn("_b", F.pmod(spread, F.lit(width)).cast("int")).withColumn("_v", value.cast("long"))
    sums = dealt.groupBy(key, "_b").agg(F.sum("_v").alias("_s"))
    whole = W.partitionBy(key)
    earlier = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(key, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("total"))
    inside = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.join(offsets, [key, "_b"])
        .withColumn("before", F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_b", "_v", "_o")
    )
