"""Document sources and the chunk index as a sink."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions.text import collapse, content_id
from docloom.operators.chunking import MAX_PARAGRAPHS, packed
from docloom.operators.ingest import route
from docloom.storage import materialize

INDEX_VERSION = "1"
#: Hash buckets of a version's documents; a replaced document rewrites its bucket.
BUCKETS = 64
EMPTY = "chunk_id string, doc_id string, title string, section string, content string, source_path string, source_uri string, updated_at timestamp, content_type string, index_version string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """The non-blank paragraphs of a word-processor file, a line each."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def read_documents(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): path, name, text of md, txt and docx files under the paths;
    path and reason of those that are of no supported kind or can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    routed = files.withColumn("route", route(F.col("path")))

    def decode(batches):
        for batch in batches:
            texts, errors = [], []
            for kind, data in zip(batch["route"], batch["content"], strict=True):
                try:
                    texts.append(docx_text(data) if kind == "docx" else data.decode("utf-8"))
                    errors.append(None)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:200])
            yield pd.DataFrame({"path": batch["path"], "text": texts, "reason": errors})

    read = routed.where(F.col("route").isin("text", "docx")).mapInPandas(decode, "path string, text string, reason string")
    documents = read.where("reason is null").select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "text")
    unsupported = routed.where(~F.col("route").isin("text", "docx")).select("path", F.concat(F.lit("Unsupported document type: "), F.regexp_extract("path", r"(\.[^./]+)?$", 1)).alias("reason"))
    return documents, read.where("reason is not null").select("path", "reason").unionByName(unsupported)


def text_chunks(documents: DataFrame, updated_at=None) -> DataFrame:
    """Chunks of named texts: up to three blank-line paragraphs and 800 characters each."""
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n+"), collapse), lambda p: p != "")
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    rows = documents.select("path", "name", stem.alias("title"), content_id(F.col("name")).alias("doc_id"), F.posexplode(packed(paragraphs, "\n\n", many=MAX_PARAGRAPHS)).alias("ordinal", "content"))
    return rows.select(
        content_id(F.col("doc_id"), F.col("ordinal").cast("string"), F.col("content")).alias("chunk_id"), "doc_id", "title", F.col("title").alias("section"), "content",
        F.col("name").alias("source_path"), F.col("path").alias("source_uri"), (updated_at if updated_at is not None else F.current_timestamp()).alias("updated_at"), F.lit("narrative").alias("content_type"), F.lit(INDEX_VERSION).alias("index_version"),
    )


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of orders."""
    return spark.read.schema("customer_id string, full_name string, dob string, ssn_last4 string, order_id string, shipment_status string, carrier string, estimated_delivery string").json(path, multiLine=True)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def index_exists(spark: SparkSession, path: str) -> bool:
    system, at = _folder(spark, path)
    return system.exists(at)


def _in_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BUCKETS)).cast("int"))


def _rewrite(spark: SparkSession, path: str, replaced: DataFrame, fresh: DataFrame | None) -> None:
    """Overwrite the buckets of ``replaced`` (index_version, doc_id): their other documents
    stay, ``fresh`` is added.  What is written is complete before anything is overwritten."""
    replaced = materialize(_in_bucket(replaced.select("index_version", "doc_id").distinct()), "replaced")
    touched = {tuple(r) for r in replaced.select("index_version", "bucket").distinct().collect()}  # BUCKETS a version at most
    if not touched:
        return
    new = None if fresh is None else _in_bucket(fresh)
    if index_exists(spark, path):
        buckets = sorted({b for _, b in touched})
        held = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("index_version").isin(sorted({v for v, _ in touched})))
        held = held.withColumn("index_version", F.col("index_version").cast("string")).join(replaced.drop("bucket"), ["index_version", "doc_id"], "left_anti")
        new = held if new is None else held.unionByName(new)
    if new is None:
        return
    new = materialize(new, "buckets")
    left = {tuple(r) for r in new.select("index_version", "bucket").distinct().collect()}
    by = ("index_version", "bucket")
    new.repartition(min(BUCKETS, len(touched)), *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for version, bucket in touched - left:  # nothing is left in these
        system, at = _folder(spark, f"{path}/index_version={version}/bucket={bucket}")
        system.delete(at, True)


def remove_documents(spark: SparkSession, path: str, documents: DataFrame, version: str = INDEX_VERSION) -> int:
    """Delete all chunks of the documents (doc_id) that the index has; how many it had."""
    if not index_exists(spark, path):
        return 0
    held = read_index(spark, path, version).select("doc_id").distinct().join(documents.select("doc_id").distinct(), "doc_id")
    held = materialize(held.withColumn("index_version", F.lit(version)), "removed")
    _rewrite(spark, path, held, None)
    return held.count()


def write_index(chunks: DataFrame, path: str) -> None:
    """Replace the documents in ``chunks``, in the hash buckets they lie in; others stay.
    Documents that have no chunk any more go by ``remove_documents``."""
    chunks = materialize(chunks, "fresh-chunks")
    _rewrite(chunks.sparkSession, path, chunks, chunks)


def read_index(spark: SparkSession, path: str, version: str = INDEX_VERSION) -> DataFrame:
    """The chunks of one schema version (partition-pruned)."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:  # every document is gone
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], EMPTY)
    return rows.where(F.col("index_version") == version).withColumn("index_version", F.lit(version)).drop("bucket")


def count_by_document(spark: SparkSession, path: str, documents: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """doc_id, n: how many chunks the index has of each document asked for; 0 if it has
    none, or isn't there."""
    asked = documents.select("doc_id").distinct()
    if not index_exists(spark, path):
        return asked.withColumn("n", F.lit(0).cast("long"))
    found = read_index(spark, path, version).groupBy("doc_id").agg(F.count("*").alias("n"))
    return asked.join(found, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def verify_index(spark: SparkSession, path: str, present: DataFrame, gone: DataFrame | None = None, version: str = INDEX_VERSION) -> None:
    """Raise unless the index has chunks of every document of ``present`` and none of
    ``gone`` (both: doc_id); the first of those that are wrong is named."""
    wrong = count_by_document(spark, path, present, version).where("n = 0")
    if gone is not None:
        wrong = wrong.unionByName(count_by_document(spark, path, gone, version).where("n > 0"))
    if (first := wrong.first()) is not None:
        raise RuntimeError(f"document {first.doc_id} {'is not in the index' if first.n == 0 else 'is still in the index'}")


def ensure_index(spark: SparkSession, path: str, wanted: dict[str, str], version: str = INDEX_VERSION) -> None:
    """Refuse an index whose columns differ from the wanted ones; one that isn't there yet
    is made by the first write."""
    if index_exists(spark, path) and (lacks := missing_columns(read_index(spark, path, version), wanted)):
        raise ValueError(f"the index lacks columns or has them otherwise: {', '.join(lacks)}")


def index_paths(spark: SparkSession, paths: list[str], path: str, provider, dimensions: int) -> int:
    """Read, cut, embed, check, replace, verify: how many chunks the documents now have."""
    documents, _ = read_documents(spark, *paths)
    chunks = materialize(embed(text_chunks(documents), provider, dimensions), "chunks")
    ensure_index(spark, path, dict(chunks.dtypes))
    named = documents.select(content_id(F.col("name")).alias("doc_id"))
    remove_documents(spark, path, named.join(chunks.select("doc_id"), "doc_id", "left_anti"))
    write_index(chunks, path)
    verify_index(spark, path, chunks.select("doc_id"))
    return chunks.count()


def missing_columns(index: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Columns of a wanted schema (name -> type) that an index lacks or has otherwise; an
    index with any is refused, never dropped silently."""
    have = dict(index.dtypes)
    return [c for c, kind in wanted.items() if have.get(c) != kind]


def embed(chunks: DataFrame, provider, dimensions: int, column: str = "content") -> DataFrame:
    """Add ``embedding`` by a provider (list of texts -> list of vectors), 32 at a time.

    All or nothing: if the provider fails for any batch, no chunk gets a vector and all are
    found by their words alone; one that returns vectors of another size is an error.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), 32):
            part = texts.iloc[at : at + 32].tolist()
            try:
                got = provider(part)
            except OSError:
                got = [None] * len(part)
            if any(v is not None and len(v) != dimensions for v in got):
                raise ValueError("embedding of unexpected size")
            out += got
        return pd.Series(out, index=texts.index)

    made = materialize(chunks.withColumn("embedding", vectors(column)), "embedded")
    if made.where("embedding is null").isEmpty():
        return made
    return made.withColumn("embedding", F.lit(None).cast("array<float>"))
