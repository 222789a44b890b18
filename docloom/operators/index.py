"""The search index: positional postings, pruned top k, phrases by their rarest word, and
upkeep by difference.

A posting is a word of a field of a row, with all its places.  Postings are counted inside
the row, so making them moves nothing between machines.  Stored, they lie in hash buckets
of the row's key, sorted by word, so that a question's words prune what is read of a bucket
and a replaced row rewrites its bucket alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docloom.functions.text import fold, tokens
from docloom.operators.lexical import B, K1
from docloom.storage import materialize

BUCKETS = 64
#: Rows up to which a set of keys is broadcast; beyond it the same join is a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a question's first guess, by k, and rows of a block of one length class, about.
SEEDS, BLOCK_ROWS = 40, 64
#: Scores closer than this count as equal when something is left out for its score.
SLACK = 1e-5
#: Postings, or a quarter of their places, that Python holds before they leave as Arrow.
FLUSH = 32_768
_WORD = re.compile("[a-z0-9]+")


def postings(rows: DataFrame, key: str, fields: dict[str, str], only: DataFrame | None = None, places: bool = True) -> DataFrame:
    """key, field, term, tf, dl (words of the field in the row), pos (its places, or none
    if ``places`` aren't wanted).

    ``fields``: name -> column.  Null texts have no words.  ``only``: terms besides which
    nothing is wanted.  Words are counted in Python, a dictionary for each text: exploding,
    shuffling and collecting them takes longer, and so do nested functions over arrays.
    """
    kind = dict(rows.dtypes)[key]
    names, wanted = list(fields), None
    if only is not None:
        only = only.select("term").distinct()
        some = [r.term for r in only.limit(BROADCAST_ROWS // 10 + 1).collect()]
        if len(some) > BROADCAST_ROWS // 10:  # too many to send to every task
            return postings(rows, key, fields, None, places).join(only, "term", "left_semi")
        wanted = rows.sparkSession.sparkContext.broadcast(frozenset(some))

    def made(batch, keys, cells, terms, tf, dl, spots):
        ends = pa.array(np.concatenate([[0], np.cumsum(tf if places else np.zeros(len(tf)), dtype=np.int64)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(keys, pa.int32())), pa.array(cells, pa.string()), pa.array(terms, pa.string()), pa.array(tf, pa.int32()),
            pa.array(dl, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(spots, pa.int32())),
        ], [key, "field", "term", "tf", "dl", "pos"])

    def count(batches):
        kept = wanted.value if wanted else None
        for batch in batches:
            keys, cells, terms, tf, dl, spots = columns = [], [], [], [], [], []
            for i, name in enumerate(names):
                for at in range(batch.num_rows):
                    text = batch.column(i + 1)[at].as_py()
                    words = _WORD.findall(text) if text else ()
                    found: dict[str, list[int]] = {}
                    for pos, word in enumerate(words):
                        if kept is None or word in kept:
                            found.setdefault(word, []).append(pos)
                    keys += [at] * len(found)
                    cells += [name] * len(found)
                    terms += found
                    tf += map(len, found.values())
                    dl += [len(words)] * len(found)
                    for of_word in found.values() if places else ():
                        spots += of_word
                    # a batch of long texts has millions of words: they leave as they come
                    if len(terms) >= FLUSH or len(spots) >= 4 * FLUSH:
                        yield made(batch, *columns)
                        for column in columns:
                            column.clear()
            yield made(batch, *columns)

    texts = rows.select(key, *[fold(F.col(c)).alias(f"_f{i}") for i, c in enumerate(fields.values())])
    return texts.mapInArrow(count, f"`{key}` {kind}, field string, term string, tf int, dl int, pos array<int>")


def _limited(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``small``, which is broadcast if it was counted and
    found small."""
    held = small.select(*on).distinct()
    return df.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, on, "left_semi")


def mean_lengths(rows: DataFrame, fields: dict[str, str]) -> dict[str, float]:
    """field -> words of a row on average."""
    sums = rows.agg(*[F.avg(F.regexp_count(F.coalesce(fold(F.col(c)), F.lit("")), F.lit("[a-z0-9]+"))).alias(f) for f, c in fields.items()]).first()
    return {f: sums[f] or 0.0 for f in fields}


def _impact(tf: Column, dl: Column, mean: float) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), key))).where(F.col("rank") <= k)


def pruned_top(questions: DataFrame, index: DataFrame, n_rows: int, k: int, key: str = "doc_id", mean: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(top, report): the ``k`` best rows of each question by BM25 over one field's
    postings, and what was read for them.  ``questions``: query_id, text.

    The rows are those that scoring everything gives.  A question's rarest words give a
    first guess, whose k-th exact score is the bar.  Words too weak to reach the bar all
    together bring no row in by themselves, so their postings, the longest, are not met;
    rows that the other words bring in are kept only if their score, plus what the weak
    words can add at most in the row's block, reaches the bar.  Blocks are rows of like
    length; a word's bound in one is the BM25 of its largest count and the smallest length.

    report: query_id, postings (all of the question's words), read (met), rows (brought
    in), kept.
    """
    if mean is None:  # of an index of all words
        mean = (index.agg(F.sum("tf")).first()[0] or 0) / max(n_rows, 1)
    mean = max(mean, 1e-9)
    wanted = _asked(questions)
    blocks = max(1, n_rows // (8 * BLOCK_ROWS))
    block = (F.floor(F.log2(F.col("dl"))) * blocks + F.pmod(F.xxhash64(key), F.lit(blocks))).cast("int")
    mine = _limited(index.select(key, "term", "tf", "dl"), wanted, ["term"])
    mine = materialize(mine.select(key, "term", block.alias("block"), "tf", "dl", _impact(F.col("tf"), F.col("dl"), mean).alias("impact")), "asked-postings")
    bounds = materialize(mine.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl")), "bounds")
    bound = _impact(F.col("tf"), F.col("dl"), mean)
    terms = bounds.groupBy("term").agg(F.sum("df").alias("df"), F.max(bound).alias("most"))
    idf = F.log(1 + (n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mass = F.sum("df").over(W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, 0))
    weighed = wanted.join(terms, "term").select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("most")).alias("most"))
    weighed = materialize(weighed.withColumn("mass", mass), "weights")

    def summed(words: DataFrame, *more: Column) -> DataFrame:
        return words.select("query_id", "term", "idf").join(mine, "term").groupBy("query_id", key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score"), *more)

    def exactly(pairs: DataFrame, words: DataFrame) -> DataFrame:
        asked = pairs.select("query_id", key).join(words.select("query_id", "term", "idf"), "query_id")
        return asked.join(mine.select(key, "term", "impact"), [key, "term"]).groupBy("query_id", key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score"))

    def bar(guess: DataFrame) -> DataFrame:
        kth = _best(exactly(_best(guess, 2 * k, key), weighed), k, key).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar"))
        return kth.select("query_id", F.when(F.col("n") == k, F.col("bar") - SLACK).otherwise(0.0).alias("bar"))

    rare = weighed.where((F.col("mass") <= SEEDS * k) | (F.col("mass") == F.col("df")))
    first = materialize(bar(summed(rare)), "bar")
    under = F.sum("most").over(W.partitionBy("query_id").orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0))
    split = materialize(weighed.join(first, "query_id").withColumn("weak", under < F.col("bar")), "weak-words")
    strong, weak = split.where("not weak"), split.where("weak")
    met = materialize(summed(strong, F.first("block").alias("block")), "met")
    second = bar(met).withColumnRenamed("bar", "_b").join(first, "query_id").select("query_id", F.greatest("bar", "_b").alias("bar"))
    rest = weak.select("query_id", "term", "idf").join(bounds.select("term", "block", bound.alias("bound")), "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("bound")).alias("rest"))
    hopes = met.join(rest, ["query_id", "block"], "left").join(second, "query_id")
    kept = materialize(hopes.where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("bar")).select("query_id", key, "score"), "kept")
    more = exactly(kept, weak)
    whole = kept.unionByName(more).groupBy("query_id", key).agg(F.round(F.sum("score"), 6).alias("score"))
    told = split.groupBy("query_id").agg(F.sum("df").alias("postings"), F.sum(F.when(~F.col("weak") | (F.col("mass") <= SEEDS * k), F.col("df")).otherwise(0)).alias("read"))
    counted = met.groupBy("query_id").agg(F.count("*").alias("rows")).join(kept.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left")
    n_weak = weak.groupBy("query_id").agg(F.count("*").alias("n_weak"))
    report = told.join(counted, "query_id", "left").join(n_weak, "query_id", "left").select(
        "query_id", "postings", (F.col("read") + F.coalesce(F.col("kept") * F.col("n_weak"), F.lit(0))).alias("read"), "rows", "kept")
    return _best(whole, k, key).select("query_id", key, "score", "rank"), report


def phrases(questions: DataFrame, index: DataFrame, slop: int = 1, key: str = "doc_id") -> DataFrame:
    """query_id, key, field of rows that hold the question's words in order, each moved by
    at most ``slop`` places from one start.  ``index``: postings.

    A question is driven by its rarest word in the field: only rows that have it are
    candidates, and only their postings of the other words are shuffled.  Starts that a
    word allows are its places less its number in the question; a row matches if the words
    have a start in common.
    """
    words = questions.select("query_id", tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    asked = words.select("query_id", F.size("ts").alias("n"), F.posexplode("ts").alias("i", "term"))
    mine = _limited(index.select(key, "field", "term", "pos"), asked, ["term"])
    df = mine.groupBy("field", "term").agg(F.count("*").alias("df"))
    placed = asked.join(df, "term")
    rarest = placed.groupBy("query_id", "field", "n").agg(F.count("*").alias("found"), F.min(F.struct("df", "i", "term")).alias("r")).where("found = n")
    drives = materialize(rarest.select("query_id", "field", "n", "r.i", "r.term"), "rarest")
    starts = F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(p - F.col("i") - slop, p - F.col("i"))))).alias("starts")
    led = materialize(drives.join(mine, ["field", "term"]).select("query_id", "field", "n", "i", key, starts), "led")
    near = _limited(mine, led, ["field", key])
    others = led.select("query_id", "field", key, F.col("i").alias("_i")).join(asked.select("query_id", "i", "term"), "query_id").where("i <> _i")
    followed = others.join(near, ["field", key, "term"]).select("query_id", "field", key, starts)
    every = led.select("query_id", "field", key, "n", "starts").unionByName(followed.withColumn("n", F.lit(None).cast("int")))
    met = every.groupBy("query_id", "field", key).agg(F.max("n").alias("n"), F.collect_list("starts").alias("s")).where(F.size("s") == F.col("n"))
    common = F.aggregate(F.slice("s", 2, 1_000_000), F.get("s", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return met.where(F.size(common) > 0).select("query_id", key, "field")


def containing(sets: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """set_id, key of rows that hold all words of a set, in any order and field.

    ``sets``: set_id, text; ``index``: postings.  A set meets the rows of its rarest word,
    and only those rows' postings of its other words; a set without words meets nothing.
    """
    words = sets.select("set_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    mine = materialize(_limited(index.select(key, "term"), words, ["term"]).distinct(), "set-words")
    counted = words.join(mine.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    rarest = counted.groupBy("set_id").agg(F.count("*").alias("n"), F.count("df").alias("found"), F.min(F.struct("df", "term")).alias("r")).where("found = n")
    led = materialize(rarest.select("set_id", "n", F.col("r.term").alias("term")).join(mine, "term").withColumnRenamed("term", "_rare"), "set-rows")
    others = led.join(words, "set_id").where("term <> _rare").select("set_id", key, "term")
    near = _limited(mine, led, [key])
    more = others.join(near, [key, "term"]).groupBy("set_id", key).agg(F.count("*").alias("more"))
    return led.join(more, ["set_id", key], "left").where(F.coalesce("more", F.lit(0)) == F.col("n") - 1).select("set_id", key)


# --- stored ---------------------------------------------------------------------------


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _tables(rows: DataFrame, key: str, fields: dict[str, str]) -> dict[str, DataFrame]:
    """postings; lengths (key, field, dl, of empty fields too); terms (field, term, df)."""
    found = materialize(_dealt(rows, key, fields), "index-postings")
    return {"postings": found} | _counts(rows, found, key, fields)


def _dealt(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    return postings(rows, key, fields).withColumn("bucket", _bucket(key))


def _counts(rows: DataFrame, found: DataFrame, key: str, fields: dict[str, str]) -> dict[str, DataFrame]:
    every = rows.select(key).distinct().select(key, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    dl = found.groupBy(key, "field").agg(F.max("dl").alias("dl"))
    lengths = every.join(dl, [key, "field"], "left").select(key, "field", F.coalesce("dl", F.lit(0)).alias("dl"), _bucket(key).alias("bucket"))
    return {"lengths": lengths, "terms": found.groupBy("field", "term").agg(F.count("*").alias("df")).withColumn("bucket", _bucket("term"))}


def _write(table: DataFrame, path: str) -> None:
    """Write ``table`` by bucket, a file for each."""
    order = ["term"] if "term" in table.columns else []
    # each bucket is a task's; a hash of the few buckets would give some tasks several
    dealt = table.repartitionById(BUCKETS, "bucket").sortWithinPartitions("bucket", *order)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _put(spark: SparkSession, path: str, name: str) -> None:
    """Move what ``_pending`` has of a table into its place, bucket by bucket.  A bucket that
    was moved before is not there any more, so this can be done again."""
    system, pending = _at(spark, f"{path}/_pending/{name}")
    for found in system.listStatus(pending):
        bucket = found.getPath().getName()
        if bucket.startswith("bucket="):
            _, held = _at(spark, f"{path}/{name}/{bucket}")
            system.delete(held, True)
            system.mkdirs(held.getParent())
            if not system.rename(found.getPath(), held):
                raise RuntimeError(f"{found.getPath()} could not be moved to {held}")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def build(rows: DataFrame, path: str, key: str, fields: dict[str, str]) -> None:
    """Write the index of ``rows`` (one for each key).  Postings are written once, by bucket;
    the rest is counted from what was written."""
    found = _dealt(rows, key, fields)
    _write(found, f"{path}/postings")
    for name, table in _counts(rows, rows.sparkSession.read.schema(found.schema).parquet(f"{path}/postings"), key, fields).items():
        _write(table, f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's tables; words that no row has any more are not among them."""
    _finish(spark, path)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")}
    return {name: t.where(t[t.columns[0]].isNotNull()).drop("bucket") for name, t in tables.items()}


def replace(rows: DataFrame, path: str, key: str, fields: dict[str, str], gone: DataFrame | None = None) -> None:
    """Replace the rows of ``rows``' keys, and remove those of ``gone`` (key).

    Only the buckets of changed rows and of words whose counts change are written; counts
    change by the difference of old and new postings.  What is to be written is complete
    in ``_pending``, bucket by bucket, before anything is overwritten; then its buckets are
    moved, and whoever reads or changes the index next finishes what a lost driver left half
    done.
    """
    spark = rows.sparkSession
    _finish(spark, path)
    fresh = _tables(rows, key, fields)
    changed = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
    changed = materialize(changed.distinct().withColumn("bucket", _bucket(key)), "index-changed")
    touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # BUCKETS at most
    held = {name: spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(touched)) for name in ("postings", "lengths")}
    keys = changed.select(key)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    old = held["postings"].join(keys, key, "left_semi")
    by = lambda t, sign: t.groupBy("field", "term").agg((F.count("*") * sign).alias("df"))
    moved = by(old, -1).unionByName(by(fresh["postings"], 1)).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", _bucket("term"))
    moved = materialize(moved, "index-moved")
    words = [r.bucket for r in moved.select("bucket").distinct().collect()]
    terms = spark.read.parquet(f"{path}/terms").where(F.col("bucket").isin(words))
    terms = terms.unionByName(moved).groupBy("bucket", "field", "term").agg(F.sum("df").alias("df")).where("df > 0")
    new = {"terms": (terms, words)} | {name: (t.join(keys, key, "left_anti").unionByName(fresh[name], allowMissingColumns=True), touched) for name, t in held.items()}
    for name, (table, buckets) in new.items():
        # a bucket that gets empty keeps a row of nulls, so that overwriting reaches it
        blank = spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*[F.col("bucket") if c == "bucket" else F.lit(None).cast(kind).alias(c) for c, kind in table.dtypes])
        _write(table.where(table[table.columns[0]].isNotNull()).unionByName(blank), f"{path}/_pending/{name}")
    system, done = _at(spark, f"{path}/_pending/_complete")
    system.create(done, True).close()
    _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> None:
    """Apply a complete ``_pending``; drop one that isn't."""
    system, done = _at(spark, f"{path}/_pending/_complete")
    if system.exists(done):
        for name in ("postings", "lengths", "terms"):
            _put(spark, path, name)
        system.delete(done, False)
    system.delete(done.getParent(), True)
