"""Greedy packing of paragraphs or lines into chunks, chunk ids, constraints."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.functions.text import content_id

MAX_CHARS, MAX_PARAGRAPHS = 800, 3
#: Texts of a batch that are cut before the pieces become Arrow.
TEXTS = 128


def breaks(lengths: np.ndarray, joiner: int, most: int, many: int | None) -> list[int]:
    """Where chunks begin: from prefix sums each part knows where a chunk that begins with
    it ends, and the chunks are the pointers followed from the first part."""
    if not len(lengths):
        return []
    begins = np.concatenate([[0], np.cumsum(lengths + joiner)])[:-1]
    following = np.searchsorted(begins + lengths, begins + most, side="right")
    places = np.arange(len(lengths))
    following = np.maximum(following, places + 1)
    if many:
        following = np.minimum(following, places + many)
    out, at, pointers = [], 0, following.tolist()
    while at < len(pointers):
        out.append(at)
        at = pointers[at]
    return out


def packed(parts: Column, joiner: str, most: int = MAX_CHARS, many: int | None = None) -> Column:
    """Pack an array of texts greedily into chunks: a part joins the open chunk if it fits.

    A part longer than ``most`` is a chunk by itself; parts are never cut.  The time is in
    proportion to the number of parts.
    """

    @F.pandas_udf("array<string>")
    def pack(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            if row is not None:
                held = list(row)
                starts = breaks(np.fromiter(map(len, held), np.int64, len(held)), len(joiner), most, many)
                row = [joiner.join(held[a:b]) for a, b in pairwise([*starts, len(held)])]
            out.append(row)
        return pd.Series(out)

    return pack(parts)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def chunks(docs: DataFrame, parts: Column, joiner: str, many: int | None = None) -> DataFrame:
    """doc_id, ordinal, content, chunk_id of every chunk of every document."""
    cut = docs.select("doc_id", F.posexplode(packed(parts, joiner, many=many)).alias("ordinal", "content"))
    return cut.withColumn("chunk_id", content_id(F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.col("content")))


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct by key: the last row's values at the first row's position."""
    rest = [c for c in rows.columns if c not in (key, position)]
    merged = rows.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_v"), F.min(position).alias(position))
    return merged.select(key, position, *[F.col(f"_v.{c}").alias(c) for c in rest])


def replace_documents(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of documents in ``fresh`` go, then ``fresh`` is added."""
    return index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


#: Content type and section (null: any) -> columns that must be unique.
UNIQUE = (
    (None, None, ("chunk_id",)),
    ("table_block", "Item 6. Selected Consolidated Financial Data", ("section",)),
    ("table_row", "Item 6. Selected Consolidated Financial Data", ("metric", "year")),
    ("table_block", "Item 8. Financial Statements and Supplementary Data", ("subsection", "table_name")),
    ("table_row", None, ("section", "subsection", "metric", "year")),
    ("fact", None, ("section", "subsection", "subsubsection", "content")),
    ("profile_row", None, ("entity_name",)),
    ("profile_bio", None, ("entity_name",)),
)
NOISE = "Overview: index noise"


def is_index_noise(content: Column) -> Column:
    """Whether a text is a table of contents or an index."""
    up = F.upper(content)
    return F.contains(up, F.lit("TABLE OF CONTENTS")) | (F.contains(up, F.lit("INDEX")) & F.contains(up, F.lit("ITEM 1.")) & F.contains(up, F.lit("PART I")))


def violations(rows: DataFrame) -> DataFrame:
    """constraint, key, n of every broken constraint: values that must be unique, and
    overviews that are a table of contents.

    Each row says once which constraints it falls under and with what key; all are counted
    together, in one scan and one shuffle of counts.
    """
    cells = []
    for kind, section, keys in UNIQUE:
        if set(keys) <= set(rows.columns):
            under = F.lit(True) if kind is None else F.col("content_type") == kind
            under = under if section is None else under & (F.col("section") == section)
            key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
            cells.append(F.when(under, F.struct(F.lit(f"{kind or 'any'}: {', '.join(keys)}").alias("constraint"), key.alias("key"), F.lit(2).alias("least"))))
    if {"section", "content"} <= set(rows.columns):
        noise = (F.col("section") == "Overview") & is_index_noise(F.col("content"))
        cells.append(F.when(noise, F.struct(F.lit(NOISE).alias("constraint"), F.col("content").alias("key"), F.lit(1).alias("least"))))
    said = rows.select(F.inline(F.array_compact(F.array(*cells))))
    return said.groupBy("constraint", "key", "least").agg(F.count("*").alias("n")).where("n >= least").drop("least")


def last_messages(messages: DataFrame, key: str, order: list, keep: int = 10) -> DataFrame:
    """The last ``keep`` rows of each key; the rank filter is pushed below the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return messages.withColumn("from_last", rank).where(F.col("from_last") <= keep)


_TOKEN, _END = re.compile(r"\S+\s*|\s+", re.ASCII), re.compile(r"(?:[.!?;:]\s*|\n+)\Z", re.ASCII)


def cut(text: str, least: int, most: int) -> list[str]:
    """One text's deltas; only the last token and the one before it decide on an end."""
    tokens = (t[at : at + most] for t in _TOKEN.findall(text) for at in range(0, len(t), most))
    out, open_, size = [], [], 0
    for token in tokens:
        if open_ and size + len(token) > most:
            out.append("".join(open_))
            open_, size = [], 0
        open_.append(token)
        size += len(token)
        if size >= least and _END.search("".join(open_[-2:])) and len("".join(open_).strip(" ")) >= least:
            out.append("".join(open_))
            open_, size = [], 0
    return [*out, "".join(open_)] if open_ else out


def deltas(text: Column, least: int = 12, most: int = 40) -> Column:
    """Cut a text for streaming: pieces of at most ``most`` characters, ended early at
    sentence marks once they have ``least``; joined they give the text back.  The time is
    in proportion to the text."""

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        # some texts at a time are Python objects; what is cut is Arrow again
        kind = pa.list_(pa.string())
        done = [pa.array([None if t is None else cut(t, least, most) for t in texts.slice(at, TEXTS).to_pylist()], kind) for at in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return pieces(text)
