"""Reassembly of a transaction log into store states, in shards that DuckDB joins.

The log is dealt into ``STRETCHES`` stretches of ascending doc_id, between ids drawn by
hash (``DRAWN`` of them at any size; they decide how even the stretches are, nothing else).  Counts of transaction ends and of
commits are summed by stretch first, so a row's transaction and commit number need only
its own stretch; no source, and not the log, is ever in one task.  Then whole transactions
go to hash shards, where DuckDB ASOF-joins each change with the next rollback of its own
savepoint level and with its transaction's end.  Changes that stay are cut down to the
last of each key and epoch; hash shards of (key, run of epochs) ASOF-join each with the
key's previous version, which gives what an epoch adds to the store's count and checksum.
States are running sums of those, again by stretches.  Joins with tables that grow are
merge joins; what goes to the driver is the drawn ids and counts.

Rows that reach a shard are narrow: a text is its checksum from the scan on.  A shard gets
``ROWS`` rows on average; its memory is bounded by them, a transaction's length (ends are
dealt by hash of the id, so it is a few dozen rows) and DuckDB's limit.

Edge cases: a null source is a source of its own; a null text deletes its key, an empty one
is stored; deleting a key that isn't there changes nothing; of several labels of a document
any that says toxic counts; a row without doc_id is no record; records of one doc_id follow
each other by source, deletions first, then by checksum; without a commit there is no epoch;
an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docloom.llm.columns import stratum
from docloom.storage import materialize, shuffle_width

#: Rows of a shard on average, commits of an epoch, keys of the store, runs of epochs of a key.
ROWS, EPOCH, KEYS, RUNS = 100_000, 64, 30_000, 64
#: Stretches of the log and of the epochs (SIDE by SIDE), and ids drawn for their ends.
SIDE = 32
STRETCHES, DRAWN = SIDE * SIDE, 8192
RESULT = "kind string, id long, n long, value long"


def operation(h: Column) -> Column:
    """What a record is: commit, abort, savepoint, rollback or change."""
    kind = h % 17
    return F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").otherwise("change")


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tag (the source), op, key, crc: the log; a null crc deletes the key."""
    toxic = labels.where("doc_id is not null and toxic = 1").select("doc_id", F.lit(True).alias("_toxic")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    key = (F.floor(h / 100) % KEYS).cast("long")
    crc = F.when(F.col("text").isNotNull(), F.crc32(F.concat_ws(":", key.cast("string"), "text").cast("binary")))
    told = docs.where("doc_id is not null").select("doc_id", stratum("source").alias("tag"), operation(h).alias("op"), key.alias("key"), crc.alias("crc"))
    return told.join(toxic.hint("merge"), "doc_id", "left").select("doc_id", "tag", "op", "key", F.when(F.col("_toxic").isNull(), F.col("crc")).alias("crc"))


def _before(sums: DataFrame, column: str, *keys: str) -> DataFrame:
    """Sums of earlier stretches: one row for each stretch (and key), few of them."""
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn(column, F.coalesce(F.sum(column).over(earlier), F.lit(0)))


def stretch(ids: DataFrame) -> Column:
    """The number of a record's stretch, found in two steps of ``SIDE`` comparisons."""
    one_in = max(1, ids.count() // DRAWN)
    drawn = sorted({r.doc_id for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).limit(4 * DRAWN).collect()})
    ends = sorted({drawn[len(drawn) * i // STRETCHES] for i in range(1, STRETCHES)}) if drawn else []
    rows = [ends[at : at + SIDE] for at in range(0, len(ends), SIDE)]
    if not rows:
        return F.lit(0)
    passed = lambda held: F.size(F.filter(held, lambda end: end <= F.col("doc_id")))
    row = F.greatest(passed(F.lit([r[0] for r in rows])) - 1, F.lit(0))
    return row * SIDE + passed(F.get(F.array(*[F.lit(r) for r in rows]), row))


def numbered(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log, whose doc_ids are ``ids``, with ``seq`` (place), ``txn`` (number in its source) and ``rank`` (of a
    commit among all commits, from 1)."""
    dealt = materialize(log.withColumn("part", stretch(ids)), "log-stretches")
    ends, commit = F.col("op").isin("commit", "abort").cast("long"), (F.col("op") == "commit").cast("long")
    by_source = _before(dealt.groupBy("tag", "part").agg(F.sum(ends).alias("txn_from")), "txn_from", "tag")
    whole = dealt.groupBy("part").agg(F.count("*").alias("seq_from"), F.sum(commit).alias("rank_from"))
    whole = _before(_before(whole, "seq_from"), "rank_from")
    order = [F.col("doc_id"), F.col("tag"), F.col("crc").asc_nulls_first()]
    inside, own = W.partitionBy("part").orderBy(*order), W.partitionBy("part", "tag").orderBy(*order)
    placed = dealt.select("*", F.row_number().over(inside).alias("_seq"), F.sum(commit).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("_rank"))
    placed = placed.withColumn("_txn", F.coalesce(F.sum(ends).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(whole, "part").join(by_source.hint("merge"), ["part", "tag"]).select(
        "doc_id", "tag", "op", "key", "crc", (F.col("seq_from") + F.col("_seq")).alias("seq"), (F.col("txn_from") + F.col("_txn")).alias("txn"),
        F.when(F.col("op") == "commit", F.col("rank_from") + F.col("_rank")).alias("rank"),
    )


def _shards(df: DataFrame, n: int, keys: list[str], sql: str, schema: str) -> DataFrame:
    """Deal ``df`` by ``keys`` into hash shards and run ``sql`` over each as ``rows``."""
    wide = max(2 * shuffle_width(df.sparkSession), -(-n // ROWS))
    return df.repartition(wide, *keys).mapInArrow(_in_duckdb(sql), schema)


def _in_duckdb(sql: str) -> Callable:
    def run(batches):
        import duckdb

        held = [b for b in batches if b.num_rows]
        if held:
            with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "autoinstall_known_extensions": "false"}) as con:
                con.register("rows", pa.Table.from_batches(held))
                yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=10_000)

    return run


_RESOLVE = """
    WITH levelled AS (
      SELECT *, count(*) FILTER (op = 'savepoint') OVER (PARTITION BY tag, txn ORDER BY seq) AS level FROM rows),
    changes AS (SELECT * FROM levelled WHERE op = 'change'),
    undone AS (
      SELECT c.*, r.doc_id AS undoing FROM changes c
      ASOF LEFT JOIN (SELECT tag, txn, level, seq, doc_id FROM levelled WHERE op = 'rollback') r
      ON c.tag = r.tag AND c.txn = r.txn AND c.level = r.level AND c.seq <= r.seq)
    SELECT CASE WHEN u.undoing IS NOT NULL THEN 'rollback' WHEN e.op = 'commit' THEN 'kept' ELSE 'abort' END AS kind,
           u.doc_id, coalesce(u.undoing, e.doc_id) AS undoing, u.key, u.crc, e.rank, u.seq
    FROM undone u
    ASOF LEFT JOIN (SELECT tag, txn, seq, doc_id, op, rank FROM levelled WHERE op IN ('commit', 'abort')) e
    ON u.tag = e.tag AND u.txn = e.txn AND u.seq <= e.seq"""
_RESOLVED = "kind string, doc_id long, undoing long, key long, crc long, rank long, seq long"

_DELTAS = """
    SELECT v.epoch, sum((v.crc IS NOT NULL)::BIGINT - (p.crc IS NOT NULL)::BIGINT)::BIGINT AS keys,
           sum(coalesce(v.crc, 0) - coalesce(p.crc, 0))::BIGINT AS crcs
    FROM (SELECT * FROM rows WHERE NOT carried) v
    ASOF LEFT JOIN rows p ON v.key = p.key AND v.run = p.run AND v.epoch > p.epoch
    GROUP BY v.epoch"""


def resolved(log: DataFrame, n: int) -> DataFrame:
    """Every change and its fate: undone by a rollback or an abort, or kept with its
    commit's rank (``_RESOLVED``).  ``log``: as ``numbered`` gives it, of ``n`` rows."""
    return _shards(log, n, ["tag", "txn"], _RESOLVE, _RESOLVED)


def deltas(kept: DataFrame, epochs: int) -> DataFrame:
    """epoch, keys, crcs: what each epoch with changes adds to count and checksum."""
    place = F.shiftleft((F.col("rank") - 1) % EPOCH, 56) + F.col("seq")  # in log order of commits, then of changes
    last = materialize(
        kept.withColumn("epoch", F.expr(f"(rank + {EPOCH - 1}) div {EPOCH}")).groupBy("key", "epoch").agg(F.max_by("crc", place).alias("crc"))
        .withColumn("run", F.expr(f"(epoch - 1) * {RUNS} div {epochs}")), "log-versions")
    n = last.count()
    # what a run of epochs finds: the key's last version in the latest earlier run
    by_run = last.groupBy("key", "run").agg(F.max_by("crc", "epoch").alias("crc"), F.max("epoch").alias("epoch"))
    earlier = W.partitionBy("key").orderBy("run")
    carried = by_run.select("key", "run", F.lag("crc").over(earlier).alias("crc"), F.lag("epoch").over(earlier).alias("epoch")).where("epoch is not null")
    rows = last.select("key", "run", "epoch", "crc", F.lit(False).alias("carried")).unionByName(carried.withColumn("carried", F.lit(True)))
    by_shard = _shards(rows, n, ["key", "run"], _DELTAS, "epoch long, keys long, crcs long")
    return by_shard.groupBy("epoch").agg(F.sum("keys").alias("keys"), F.sum("crcs").alias("crcs"))


def states(changed: DataFrame, epochs: int) -> DataFrame:
    """epoch, keys, crcs: running sums over all ``epochs``, in stretches of epochs."""
    spark = changed.sparkSession
    width = min(epochs, STRETCHES) or 1
    every = spark.range(1, epochs + 1, numPartitions=shuffle_width(spark)).withColumnRenamed("id", "epoch")
    filled = every.join(changed.hint("merge"), "epoch", "left").select("epoch", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keys", "crcs")], F.expr(f"(epoch - 1) * {width} div {epochs or 1}").alias("part"))
    filled = materialize(filled, "log-epochs")
    sums = filled.groupBy("part").agg(F.sum("keys").alias("keys_from"), F.sum("crcs").alias("crcs_from"))
    offsets = _before(_before(sums, "keys_from"), "crcs_from")
    upto = W.partitionBy("part").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    return filled.select("part", "epoch", F.sum("keys").over(upto).alias("_k"), F.sum("crcs").over(upto).alias("_c")).join(offsets, "part").select(
        "epoch", (F.col("keys_from") + F.col("_k")).alias("keys"), (F.col("crcs_from") + F.col("_c")).alias("crcs"))


def reassemble(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """States after each epoch and all undone changes of the log: kind, id, n, value."""
    log = materialize(numbered(records(docs, labels), docs.select("doc_id").where("doc_id is not null")), "log-numbered")
    n, commits = log.agg(F.count("*"), F.count("rank")).first()  # two numbers
    fates = materialize(resolved(log, n), "log-fates")
    epochs = -(-commits // EPOCH)
    after = states(deltas(fates.where("kind = 'kept'"), epochs or 1), epochs)
    undone = fates.where("kind <> 'kept'").select("kind", F.col("doc_id").alias("id"), F.col("undoing").alias("n"), F.col("key").alias("value"))
    return after.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").alias("n"), F.col("crcs").alias("value")).unionByName(undone)
