"""Mixing sources to target weights by a time-varying curriculum (native).

A source's schedule is a weight over training time, linear from ``start`` to ``end`` and
of mean one.  Its integral says how much of the source's demand is due by then; inverting
it turns a document's place in the source's word demand into a training position in
(0, 1).  Range-sorting by position is the training order.

How much is demanded: all sources share ``budget`` times all words by weight, none above
``most`` times its own words; what one cannot take is shared among the others by weight
(a water level, found in one pass over the table of sources).

Edge cases: a null source is a source of its own (last in code-point order); null or
wordless texts have size 0 and are taken 0 times; with no words at all every target is 0;
rows equal in id and text are interchangeable.  At most one document of each source is
cut, where the source's demand ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from docloom.llm.columns import SPACE, running_totals, stratum, text_of, word_count
from docloom.storage import shuffle_width

#: Weights, dealt to sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Schedules (start, end) dealt alike: falling, level, rising.  Each has mean one.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUDGET, MOST = 1.5, 2.0


def _dealt(values, index):
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index)


def targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """A row for each source: ``_k``, ``source_size``, ``target``, ``start``, ``end``.

    ``sizes`` has ``_k``, ``source`` and ``source_size``; it has as many rows as there are
    sources, so its unpartitioned windows stay small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    index = (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")
    weighed = sizes.withColumn("_i", index).withColumns({
        "_w": _dealt(WEIGHTS, F.col("_i")),
        "start": _dealt([s for s, _ in SCHEDULES], F.col("_i")),
        "end": _dealt([e for _, e in SCHEDULES], F.col("_i")),
        "_cap": F.lit(most) * F.col("source_size"),
        "_all": F.lit(budget) * F.sum("source_size").over(every),
    }).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filling = W.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    level = weighed.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    # levels fall from the first source that is not filled on, so the greatest is the level
    reached = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    return level.withColumn("target", F.least(F.col("_cap"), F.coalesce(reached, F.lit(float("inf"))) * F.col("_w"))).select("_k", "source_size", "target", "start", "end")


def assign(docs: DataFrame, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``taken`` and ``passes`` to every document.

    Of ``docs`` the columns ``keep`` are carried (all, if None): texts travel only if asked.

    ``passes`` is an array of (epoch, words, position), one entry for each time the mix
    takes the document.  Order within a source is a seeded shuffle.
    """
    carried = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"))  # so that no name clashes
    sized = carried.withColumn("_k", stratum("source")).withColumn("size", word_count(text_of()))
    sources = targets(sized.groupBy("_k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    tie = [F.col("_h"), F.col("doc_id"), F.col("_crc")]
    told = {"_h": F.xxhash64(F.lit(seed), "doc_id", "text"), "_crc": F.crc32(F.encode(text_of(), "UTF-8"))}
    shuffled = sized.withColumns(told).drop("text")
    ordered = running_totals(shuffled, "_k", F.col("_h"), tie, F.col("size")).drop("total", "_h", "_crc")
    placed = ordered.join(sources, "_k").withColumn("_due", F.floor(F.col("target") + 0.5).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("_due div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_due") - F.col("_e") * F.col("source_size") - F.col("before")))
    placed = placed.withColumn("_e", epochs).withColumn("_r", rest)

    def entry(epoch, words):
        share = (epoch * F.col("source_size") + F.col("before") + words / 2) / F.greatest(F.col("_due"), F.lit(1))
        slope = F.col("end") - F.col("start")
        curved = (F.sqrt(F.col("start") * F.col("start") + 2 * slope * share) - F.col("start")) / F.nullif(slope, F.lit(0.0))
        return F.struct(epoch.cast("int").alias("epoch"), words.cast("long").alias("words"), F.when(slope == 0, share).otherwise(curved).alias("position"))

    # at most ``most`` full passes, then the part of a pass that is still due
    turns = F.array(*[F.when(F.col("_e") > n, entry(F.lit(n), F.col("size"))) for n in range(int(MOST))], F.when(F.col("_r") > 0, entry(F.col("_e"), F.col("_r"))))
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("_e") * F.col("size") + F.col("_r"),
            "passes": F.filter(turns, lambda x: x.isNotNull() & (x["words"] > 0))}
    return placed.select(*[F.col(f"_row.`{c}`") for c in keep or docs.columns if c not in made], *[v.alias(c) for c, v in made.items()])


def training_order(df: DataFrame, position: str) -> DataFrame:
    """Range-sort by ``position``: partition i holds earlier positions than partition i+1.

    Ties, and rows without a position (first), have no order among each other; those rows
    are spread by hash.
    """
    spread = F.when(F.col(position).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.repartitionByRange(shuffle_width(df.sparkSession), F.col(position), spread).sortWithinPartitions(position)


def stream(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The training stream: documents once for each pass, in training order.

    Columns of ``docs`` only.  The one document of a source at which its demand ends is
    cut after the words due (its separators become single spaces); all others are whole.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    inner = docs.select("doc_id", "text", "source", own.alias("_own"))
    out = assign(inner, seed, ["_own"]).withColumn("_p", F.explode("passes")).withColumn("_at", F.col("_p.position"))
    text = F.col("_own.text")
    cut = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), F.lit(1), F.col("_p.words").cast("int")), " ")
    said = F.when(F.col("_p.words") < F.col("size"), cut).otherwise(text)
    rows = out.select(*[said.alias(c) if c == "text" else F.col(f"_own.`{c}`") for c in docs.columns], F.col("_at"))
    return training_order(rows, "_at").drop("_at")
