"""Audit of how filters interact: every order of five filters at once, by matrix products.

A document is its mask, a bit for each filter it fails; a part of the corpus is three
histograms of 32 masks: all documents, those of good quality, and toxic ones.  Which of
the masks a step of an order keeps, removes, finds removed before, or alone removes does
not depend on the data, so each outcome is an integer matrix of 32 masks by 600 (order,
step), and the audit of all parts is the product of the stacked histograms with them.

Documents are read once, and only their digest, part and labels are shuffled.  Filters A
to D are functions of the text, so equal texts are counted together before anything is
grouped by text; a text that a third of all rows hold is a few rows by then.

Edge cases: a null text is empty and has no words; a null source is the empty string; an
empty text fails A alone (and E where a smaller doc_id is empty too); a row without doc_id
has no smaller row and is nobody's smaller row; rows of one doc_id and one text fail E only
if a smaller doc_id has the text; of several labels of a document any that says good or
toxic counts; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.llm.columns import SPACE, text_of

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def incidence() -> dict[str, np.ndarray]:
    """Outcome -> matrix of masks by (order, step), ones where a document of the mask has
    the outcome at the step.  ``shapley`` sums ``removed`` over all orders by filter."""
    bits = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1  # masks by filters
    order = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])  # orders by steps
    fails = bits[:, order]  # masks by orders by steps
    before = np.cumsum(fails, axis=2) - fails
    fails, gone = fails.astype(bool), before > 0
    alone = fails & (bits.sum(1) == 1)[:, None, None]
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": alone}
    out = {k: v.reshape(MASKS, -1).astype(np.int64) for k, v in out.items()}
    by_filter = (order.reshape(-1)[:, None] == np.arange(STEPS)).astype(np.int64)  # (order, step) by filters
    out["shapley"] = out["removed"] @ by_filter @ by_filter.T
    return out


def failures(text: Column, n_words: Column, n_distinct: Column) -> Column:
    """The mask of filters A to D; E is not a matter of one text."""
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    rules = (
        n_words < 50,
        100 * n_distinct < 65 * n_words,
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules)), F.lit(0)).cast("int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just those filters."""
    told = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    )
    text = text_of()
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"), words.alias("_words"))
        .select("doc_id", "part", F.sha2("_text", 256).alias("_digest"),
                failures(F.col("_text"), F.size("_words").cast("long"), F.size(F.array_distinct("_words")).cast("long")).alias("_mask"))
        .join(told, "doc_id", "left")
        .select("doc_id", "part", "_digest", "_mask", F.coalesce("_good", F.lit(0)).alias("_good"), F.coalesce("_toxic", F.lit(0)).alias("_toxic"))
    )
    # a row for each id first, so that repeated rows of the smallest id are known by number
    ids = rows.groupBy("_digest", "_mask", "part", "_good", "_toxic", "doc_id").agg(F.count("*").alias("_c"))
    like = ids.groupBy("_digest", "_mask", "part", "_good", "_toxic").agg(
        F.sum("_c").alias("_n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("_c")).otherwise(0)).alias("_without"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_c"))).alias("_least"),
    )
    # of one text: the smallest id of all parts and labels
    each = like.withColumn("_first", F.min("_least.doc_id").over(W.partitionBy("_digest")))
    stays = F.col("_without") + F.when(F.col("_least.doc_id") == F.col("_first"), F.col("_least._c")).otherwise(0)
    masked = each.select("part", "_good", "_toxic", F.inline(F.array(
        F.struct(F.col("_mask").alias("mask"), stays.alias("_n")),
        F.struct((F.col("_mask") + F.lit(1 << 4)).alias("mask"), (F.col("_n") - stays).alias("_n")),
    )))
    return masked.groupBy("part", "mask").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_good")).alias("good"), F.sum(F.col("_n") * F.col("_toxic")).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """``histograms`` -> a row for each part, order and step (``RESULT``), zeros included."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def multiply(batches):
        outcomes = incidence()
        orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for at in range(0, len(batch), 64):  # rows of the stacked matrix at a time
                some = batch.iloc[at : at + 64]
                stacked = np.zeros((3, len(some), MASKS), np.int64)
                for i, cells in enumerate(some["cells"]):
                    for cell in cells:
                        stacked[:, i, cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                every, good, toxic = stacked
                columns = {k: (every @ m).ravel() for k, m in outcomes.items()}
                columns |= {"good_lost": (good @ outcomes["removed"]).ravel(), "toxic_lost": (toxic @ outcomes["removed"]).ravel()}
                n = len(some)
                frame = pd.DataFrame({"part": np.repeat(some["part"].to_numpy(), len(orders)), "filter_order": np.tile(orders, n), "step": np.tile(steps, n)} | columns)
                yield frame[[c.split()[0] for c in RESULT.split(", ")]]

    return parts.mapInPandas(multiply, RESULT)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic)."""
    return audit(histograms(docs, labels))
