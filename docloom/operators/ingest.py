"""Idempotent ingestion: notifications, claims, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STALE_SECONDS, KEEP_DAYS, MAX_ERROR = 900, 30, 1000
SUFFIXES = ("pdf", "md", "txt", "docx")
NOTIFICATION = "struct<Records:array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string,versionId:string,eTag:string,sequencer:string>>>>>"


def notifications(rows: DataFrame, column: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON notifications -> bucket, key, version_id, etag, pk, sk, source_uri, suffix, and
    the columns to ``keep``."""
    one = rows.select(*keep, F.explode(F.from_json(column, NOTIFICATION)["Records"]).alias("r")).select(*keep, "r.s3.bucket.name", "r.s3.object.*")
    named = one.select(*keep, F.col("name").alias("bucket"), F.try_url_decode("key").alias("key"), F.coalesce(F.nullif("versionId", F.lit("")), F.nullif("sequencer", F.lit("")), F.lit("null")).alias("version_id"), F.col("eTag").alias("etag"))
    uri = F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key")
    return named.where("bucket <> '' and key <> ''").withColumns({"pk": F.concat(F.lit("DOC#"), "bucket", F.lit("#"), "key"), "sk": F.concat(F.lit("VERSION#"), "version_id"), "source_uri": uri, "suffix": suffix(F.col("key"))})


def suffix(path: Column) -> Column:
    """The case-folded extension of a path."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(path: Column) -> Column:
    """How a document is read: filing, text, docx, or unsupported."""
    return F.when(suffix(path) == "pdf", "filing").when(suffix(path).isin("md", "txt"), "text").when(suffix(path) == "docx", "docx").otherwise("unsupported_type")


def is_stale(started_at: Column, now: Column) -> Column:
    started = F.try_to_timestamp(started_at)
    return started.isNull() | ((now.cast("timestamp").cast("long") - started.cast("long")) > STALE_SECONDS)


def claim(events: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """What becomes of each event: completed, skipped (in work), processing, unsupported_type.

    ``events``: pk, sk, key; ``state``: pk, sk, status, started_at.  Repeated events of one
    version are claimed once; failed and stale work is claimed again.
    """
    once = events.withColumn("_n", F.row_number().over(W.partitionBy("pk", "sk").orderBy("key"))).where("_n = 1").drop("_n")
    joined = once.join(state.select("pk", "sk", "status", "started_at"), ["pk", "sk"], "left")
    result = (
        F.when(route(F.col("key")) == "unsupported_type", "unsupported_type").when(F.col("status") == "completed", "completed")
        .when((F.col("status") == "processing") & ~is_stale(F.col("started_at"), now), "skipped").otherwise("processing")
    )
    return joined.withColumn("result", result)


def outcome(claimed: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """State rows after the work: ``done`` has pk, sk, indexed_doc_count, error_message.

    Claimed work of which ``done`` says nothing is lost, and failed.
    """
    rows = claimed.where("result = 'processing'").select("pk", "sk").join(done.withColumn("_done", F.lit(True)), ["pk", "sk"], "left")
    rows = rows.withColumn("error_message", F.when(F.col("_done").isNull(), F.lit("no result")).otherwise(F.col("error_message")))
    failed = F.col("error_message").isNotNull()
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "pk", "sk", F.when(failed, "failed").otherwise("completed").alias("status"), stamp.alias("updated_at"), F.when(~failed, stamp).alias("completed_at"),
        F.when(~failed, F.col("indexed_doc_count")).alias("indexed_doc_count"), F.left("error_message", F.lit(MAX_ERROR)).alias("error_message"),
        (now.cast("timestamp").cast("long") + KEEP_DAYS * 86400).alias("ttl"),
    )


def unfinished(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events whose version is not completed yet."""
    return events.join(state.where("status = 'completed'").select("pk", "sk"), ["pk", "sk"], "left_anti")
