"""Claims and sessions as streams over the given tables, against the batch queries."""

import time

import pytest
from pyspark.sql import Window as W, functions as F

from docloom.operators import chunking
from docloom.streaming import stateful

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # every partition has a store of its own to open
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files_in_order(rows, path, n):
    """``n`` files, read one after the other."""
    import os

    for i in range(n):
        rows.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if not hasattr(files_in_order, "seen") or f.name not in files_in_order.seen:
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
                files_in_order.seen = getattr(files_in_order, "seen", set()) | {f.name}


def run(stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_claims_as_a_stream_equal_the_batch(spark, tmp_path):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("notification")
    table = spark.read.parquet(f"{DATA}/events.parquet")
    # a few users, so that events of one meet within a stale claim's time
    events = table.select((F.col("user_id") % 3).cast("string").alias("pk"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    events = spark.createDataFrame(events.orderBy("ts", "seq").collect(), events.schema)
    n = events.count()
    numbered = spark.createDataFrame([(*r, i * 4 // n) for i, r in enumerate(events.orderBy("ts", "seq").collect())], "pk string, at_ms long, seq long, kind string, ts timestamp, _f int")
    files_in_order(numbered, tmp_path / "in", 4)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run(stateful.claim_stream(stream), "claims", "append", tmp_path)
    got = {tuple(r) for r in spark.table("claims").collect()}
    assert got == {tuple(r) for r in stateful.claims(events).collect()}
    assert {r[2] for r in got} == {"processing", "skipped", "completed"} and len(got) == events.where("kind = 'notification'").count()
    # what is stale is forgotten: the state has no more values than keys
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4


def test_a_claim_in_steps():
    at = lambda s: 1_000_000_000_000 + 1000 * s
    said, claim = [], None
    for s, kind in ((0, "completed"), (1, "notification"), (2, "notification"), (901, "notification"), (902, "notification"), (903, "failed"), (904, "notification"), (905, "completed"), (906, "notification"), (905 + 30 * 86400, "notification"), (906 + 30 * 86400, "notification")):
        claim, result = stateful.advance(claim, at(s), kind)
        said.append(result)
    assert said == [None, "processing", "skipped", "skipped", "processing", None, "processing", None, "completed", "completed", "processing"]


def test_sessions_as_a_stream_keep_the_last_ten(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/conversations.parquet").where("conv_id is not null and turn is not null")
    # a few sessions, so that each has more messages than it keeps
    table = table.select((F.col("conv_id") % 4).alias("conv_id"), F.row_number().over(W.orderBy("conv_id", "turn")).cast("long").alias("turn"), "role", "text")
    messages = table.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    files_in_order(messages.withColumn("_f", (F.col("turn") % 3).cast("int")), tmp_path / "in", 3)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # state that expires by the clock is looked at again and again, so the stream is stopped
    query = stateful.session_stream(stream).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 120
    while time.time() < until and query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < messages.count():
        time.sleep(1)
    query.stop()
    assert query.exception() is None
    # after several batches, the fullest and latest list of a session is what it keeps
    last = {}
    for r in spark.table("kept").collect():
        if r.session_id not in last or (len(r.turns), r.turns[-1], sum(r.turns)) >= (len(last[r.session_id]), last[r.session_id][-1], sum(last[r.session_id])):
            last[r.session_id] = r.turns
    want = chunking.last_messages(messages, "session_id", ["turn"]).groupBy("session_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    assert last == {r.session_id: r.turns for r in want.collect()}
