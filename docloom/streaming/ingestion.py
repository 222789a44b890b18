"""Streaming ingestion: notifications in, chunks of claimed documents out, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.ingest import KEEP_DAYS, claim, notifications, outcome
from docloom.storage import materialize

STATE = "pk string, sk string, status string, started_at string, updated_at string, completed_at string, indexed_doc_count long, error_message string, ttl long"


def read_state(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The last state of every document version (the log keeps all).

    Claims that ``batch`` made itself don't count: it runs again after a failure.
    """
    try:
        log = spark.read.schema(STATE + ", batch long").parquet(path)
        log.isEmpty()
    except Exception as error:  # the first batch: nothing is written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], STATE)
    if batch is not None:
        log = log.where((F.col("status") != "processing") | (F.col("batch") != batch))
    fields = [c.split()[0] for c in STATE.split(", ") if c.split()[0] not in ("pk", "sk")]
    last = log.groupBy("pk", "sk").agg(F.max_by(F.struct(*fields), F.struct("batch", F.col("status") != "processing", "updated_at")).alias("s"))
    return last.select("pk", "sk", "s.*")


def ingest_batch(bodies: DataFrame, batch: int, state_path: str, work: Callable[[DataFrame], DataFrame], now: Column | None = None) -> None:
    """One micro-batch: claim, record the claim, work, record the outcome.

    While it works, others see its versions as processing.  A batch that runs again finds
    its versions completed and does nothing, or takes up its own claims.
    """
    now = F.current_timestamp() if now is None else now
    spark = bodies.sparkSession
    fields = [c.split()[0] for c in STATE.split(", ")]
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    claimed = materialize(claim(notifications(bodies), read_state(spark, state_path, batch), now), "claimed")
    taken = claimed.where("result = 'processing'").select(
        "pk", "sk", F.lit("processing").alias("status"), stamp.alias("started_at"), stamp.alias("updated_at"), F.lit(None).cast("string").alias("completed_at"),
        F.lit(None).cast("long").alias("indexed_doc_count"), F.lit(None).cast("string").alias("error_message"), (now.cast("timestamp").cast("long") + KEEP_DAYS * 86400).alias("ttl"))
    taken.select(*fields, F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(state_path)
    done = work(claimed.where("result = 'processing'"))  # pk, sk, indexed_doc_count, error_message
    rows = outcome(claimed, done, now).withColumns({"started_at": stamp, "batch": F.lit(batch).cast("long")})
    rows.select(*fields, "batch").write.mode("append").parquet(state_path)


def ingest_stream(bodies: DataFrame, state_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """``bodies``: a stream with a ``body`` column of JSON notifications."""
    return (
        bodies.writeStream.foreachBatch(lambda rows, n: ingest_batch(rows, n, state_path, work))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
