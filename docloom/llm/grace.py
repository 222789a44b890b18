"""Exact deduplication by Grace hashing.

Texts are compared after each run of separators becomes one space.  Records are
partitioned by a hash of that content, first into Spark's shuffle partitions, then, inside
a task, into spill files on the executor's own disk, again and again with further hash
bits, until a bucket fits an open-addressing table.  The table compares complete contents;
a hash only chooses slots.

Copies collapse twice: in the task that reads them (so a group of any size sends at most
one record for each input task through the shuffle) and after the shuffle.

Edge cases: null counts as empty; empty texts are equal to each other; of equal texts the
smallest doc_id stays (a null doc_id counts as larger than any); rows repeated with the
same doc_id all name that id as ``keep_id`` and one of them, with the others, is
``kept``; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.columns import SPACE, text_of
from docloom.storage import shuffle_width

#: Content bytes a table may hold, spill files a bucket is cut into, and the depth at
#: which hash bits run out (a single content that large still fits: it is stored once).
TABLE_BYTES, FANOUT_BITS, MAX_DEPTH = 48 << 20, 4, 12
#: What an entry takes besides its content: a slot, a list, its numbers, a bytes object.
ENTRY_BYTES = 250

RECORD = struct.Struct("<QqqI")  # hash, smallest id, count, length of the content
_NO_ID = (1 << 63) - 1


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, slots: int = 1024):
        self.slots: list[list | None] = [None] * slots
        self.used = self.bytes = 0

    def add(self, key: int, content: bytes, least: int, count: int) -> None:
        mask = len(self.slots) - 1
        at = (key ^ (key >> 29)) & mask
        while (entry := self.slots[at]) is not None:
            if entry[0] == key and entry[1] == content:
                entry[2] = min(entry[2], least)
                entry[3] += count
                return
            at = (at + 1) & mask
        self.slots[at] = [key, content, least, count]
        self.used += 1
        self.bytes += len(content) + ENTRY_BYTES
        if 3 * self.used > 2 * len(self.slots):
            old, self.slots = self.slots, [None] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for entry in filter(None, old):
                at = (entry[0] ^ (entry[0] >> 29)) & mask
                while self.slots[at] is not None:
                    at = (at + 1) & mask
                self.slots[at] = entry

    def entries(self) -> Iterator[list]:
        return filter(None, self.slots)


def _read(path: str) -> Iterator[tuple[int, bytes, int, int]]:
    with open(path, "rb") as f:
        while head := f.read(RECORD.size):
            key, least, count, length = RECORD.unpack(head)
            yield key, f.read(length), least, count


def grace(records: Iterator[tuple[int, bytes, int, int]], limit: int = TABLE_BYTES, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """Distinct contents of ``records`` (hash, content, smallest id, count), merged.

    A table takes records until ``limit`` bytes; then it and all that follows go to spill
    files by the next bits of the hash, and each file is handled alike.  Files are removed
    as soon as they have been read, and in any case at the end.
    """
    table = ContentTable()
    for record in records:
        key, content, least, count = record
        table.add(key, content, least, count)
        if table.bytes > limit and table.used > 1 and depth < MAX_DEPTH:
            break
    else:
        yield from table.entries()
        return
    own = tempfile.mkdtemp(prefix="grace-", dir=folder)
    try:
        names = [f"{own}/{i}" for i in range(1 << FANOUT_BITS)]
        files = [open(n, "wb") for n in names]
        shift, mask = 60 - FANOUT_BITS * depth, (1 << FANOUT_BITS) - 1

        def spill(key, content, least, count):
            f = files[(key >> shift) & mask]
            f.write(RECORD.pack(key, least, count, len(content)))
            f.write(content)

        for entry in table.entries():
            spill(*entry)
        table = None
        for record in records:
            spill(*record)
        for f in files:
            f.close()
        for name in names:
            yield from grace(_read(name), limit, depth + 1, own)
            open(name, "wb").close()
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _records(batches) -> Iterator[tuple[int, bytes, int, int]]:
    for batch in batches:
        keys, contents, least, counts = (batch.column(i) for i in range(4))
        for k, c, i, n in zip(keys.to_pylist(), contents, least.to_pylist(), counts.to_pylist(), strict=True):
            yield k & 0xFFFFFFFFFFFFFFFF, c.as_buffer().to_pybytes() if len(c.as_buffer()) else b"", _NO_ID if i is None else i, n


def _tables(batches):
    """One Grace pass over a task's batches of (hash, content, least id, count)."""
    rows, held = [], 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k - (1 << 64) if k >> 63 else k for k, *_ in rows], pa.int64()),
                pa.array([c for _, c, *_ in rows], pa.binary()),
                pa.array([None if i == _NO_ID else i for _, _, i, _ in rows], pa.int64()),
                pa.array([n for *_, n in rows], pa.int64()),
            ],
            ["hash", "content", "least_id", "copies"],
        )

    for entry in grace(_records(batches)):
        rows.append(entry)
        held += len(entry[1])
        if held > 8 << 20 or len(rows) >= 4096:
            yield flush()
            rows, held = [], 0
    if rows:
        yield flush()


def distinct_contents(docs: DataFrame, content, identity: str = "doc_id") -> DataFrame:
    """Distinct values of the binary column ``content``: hash, content, least_id, copies."""
    schema = "hash long, content binary, least_id long, copies long"
    rows = docs.select(F.xxhash64(content).alias("hash"), content.alias("content"), F.col(identity).cast("long").alias("least_id"), F.lit(1).cast("long").alias("copies"))
    local = rows.mapInArrow(_tables, schema)
    return local.repartition(shuffle_width(docs.sparkSession), "hash").mapInArrow(_tables, schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    normal = F.encode(F.regexp_replace(text_of(), SPACE, " "), "UTF-8")
    groups = distinct_contents(docs, normal).select(
        F.sha2("content", 256).alias("text_sha256"), F.col("least_id").alias("keep_id"), F.col("copies").alias("group_size")
    )
    rows = docs.select("doc_id", F.sha2(normal, 256).alias("text_sha256"))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
