"""Shared, executor-visible scratch tables.

Everything that has to be cut from its lineage goes through here.  The folder is the one
the session names in ``spark.checkpoint.dir``; only a session without one (tests, a
laptop) gets a folder of our own.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no checkpoint folder and runs on this machine alone.
FALLBACK_DIR = "/tmp/checkpoints"
#: Scratch tables of this run have a folder of their own.
_RUN = uuid.uuid4().hex
#: Lists that note the tables made while they are open (see ``Scratch``).
_NOTED: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        named = FALLBACK_DIR
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Notes the scratch tables made inside a ``with``; ``leave`` deletes those that a
    result does not read."""

    def __enter__(self) -> Scratch:
        self.paths: list[str] = []
        _NOTED.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _NOTED[:] = [noted for noted in _NOTED if noted is not self.paths]

    def leave(self, result: DataFrame) -> DataFrame:
        read = " ".join(result.inputFiles())
        for path in self.paths:
            if path.rsplit("/", 1)[1] not in read:
                _delete(result.sparkSession, path)
        # shuffle files go when the driver's collector finds their plans unused
        result.sparkSession.sparkContext._jvm.System.gc()
        return result


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage to recompute, so a lost executor costs a re-read, and
    several consumers share one evaluation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docloom-{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for noted in _NOTED:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle gets in this session; work is dealt in multiples of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sweep(spark: SparkSession) -> None:
    """Delete every scratch table of this run (end of a test or bench run)."""
    _delete(spark, f"{scratch_dir(spark)}/docloom-{_RUN}")
