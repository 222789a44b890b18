"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; pieces become sequences.  Bins
are filled one at a time: the longest piece left opens the bin, and a subset-sum dynamic
program over the lengths still available, kept as a bitset, finds the combination that
leaves the least slack; it is removed and the next bin begins.

Only lengths matter for that, and there are at most ``capacity`` of them, so the program
runs on the histogram of lengths (a bounded table, whatever the corpus) and a combination
found once is repeated while its lengths last.  The plan says, for each length, which
ranks go to which sequence and offset; pieces get their rank within their length by
bucketed running counts and look up their place.  No group of pieces meets in one task.

Edge cases: null text is empty; an empty text is the end id alone; repeated rows are
packed each for itself; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from docloom.llm.columns import running_totals, text_of
from docloom.storage import materialize

CAPACITY, END_ID = 2048, 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of runs with their ids that a worker remembers, in two generations.
_MEMO_BYTES = 96 << 20
#: Fixed value: how the tokenizer cuts words into runs.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
_LATIN = regex.compile("[ -~\u00a1-\u012f\u0132-\u024f]+").fullmatch
#: The same for printable ASCII in small letters, and what is one such run of its own.
_ASCII_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-`{-~]+").findall
_ASCII_RUN = re.compile("[a-z]+|[0-9]").fullmatch


def tokenizer(path: str):
    """The tokenizer of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of whole texts, by runs.

    The vocabulary drops white space, so no token reaches over it and a text's ids are its
    words' ids in order.  The runs of letters or signs inside words that the tokenizer
    treats apart repeat more than words do; each is encoded once.  An ASCII run is what the
    tokenizer hands to its model, so it goes there directly.  Words outside printable Latin,
    where case or composition could depend on more than the character, go to the tokenizer
    as they are.  What is known lies in two generations: when the younger is full the older
    goes, and what is met again comes back from it.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        #: Ids of runs and of whole odd words; a run's are those it has as a word.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        for space in "\n\t\r\x0b\x0c":
            if space in text:
                text = text.replace(space, " ")
        if "<|" not in text and text.isascii() and text.isprintable():
            runs = _ASCII_RUNS(text.lower())
        elif "<|" not in text and _LATIN(text):
            runs = _RUNS(text.lower())
        else:
            runs = []
            for word in text.split(" "):
                runs += _RUNS(word.lower()) if _LATIN(word) and "<|" not in word else (word,)
        if self.held > _MEMO_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        if new := set(runs).difference(self.known):
            self._learn(new)
        return b"".join(map(self.known.__getitem__, runs))

    def _learn(self, runs: set[str]) -> None:
        known, older, held = self.known, self.older, 0
        for run in runs:
            ids = older.get(run)
            if ids is None:
                whole = not _ASCII_RUN(run)
                ids = _packed(self.tokenizer.encode(run, add_special_tokens=False).ids if whole else [t.id for t in self.model.tokenize(run)])
            known[run] = ids
            # a string, its ids and their place in a table take about 200 bytes besides
            held += 200 + 2 * len(run) + len(ids)
        self.held += held


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The ids of a tokenizer file that a worker keeps for its next task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with the end id."""

    def cut(batches):
        ids = word_ids(tokenizer_path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                raw = ids(text) + END_ID.to_bytes(4, "little")
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(cut, _PIECES)


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """A combination of available lengths, largest first, with the greatest sum <= room.

    Bit s of ``reach`` says that some combination sums to s; each length is added in
    binary portions of its count.  Walking the kept states backwards finds one such sum.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, portion = min(counts[length], room // length), 1
        while left > 0:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, portion = left - take, portion * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, each, offset).

    Ranks first..end of that length go to sequences from ``first sequence`` on, ``each`` to
    a sequence, side by side from ``offset``.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    given, out, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        used = fullest(capacity - first, lengths, counts)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        bins, offset = min(counts[n] // u for n, u in used.items()), 0
        for length in sorted(used, reverse=True):
            each = used[length]
            out.append((length, given[length], given[length] + bins * each, sequence, each, offset))
            given[length] += bins * each
            offset += each * length
            counts[length] -= bins * each
            if not counts[length]:
                del counts[length]
        sequence += bins
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` (see the module)."""
    cut = materialize(pieces(docs, tokenizer_path, capacity), "packing-pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    firsts = {int(n): np.flatnonzero(rows[:, 0] == n) for n in np.unique(rows[:, 0])}

    def place(batches):
        for batch in batches:
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for length, at in batch.groupby("length").indices.items():
                mine = rows[firsts[int(length)]]
                rank = batch["before"].to_numpy()[at]
                row = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                nth = rank - row[:, 1]
                sequence[at] = row[:, 3] + nth // row[:, 4]
                offset[at] = row[:, 5] + nth % row[:, 4] * length
            yield batch.drop(columns=["before"]).assign(sequence_id=sequence, offset=offset)

    identity = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = running_totals(cut, "length", F.xxhash64(*identity), [F.col(c) for c in identity], F.lit(1)).drop("total")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "before").mapInPandas(place, _PIECES + ", sequence_id long, offset long")
