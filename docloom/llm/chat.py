"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and
only its reply is trainable.  The contexts of a conversation are prefixes of one formatted
text, so that text is kept once, a segment for each turn.  ``expand`` makes a row of each
example: its target (the reply's segment), a pointer to its context (the first
``context_end`` characters of the conversation's text), and the loss mask inside the
target.  Output stays linear in the input even for one conversation of millions of turns;
``render`` writes the examples out where a trainer wants whole strings.

The template opens a turn with ``<|im_start|>``, the role and a line feed, and closes it
with ``<|im_end|>`` and a line feed.  Inside roles and texts every backslash is doubled
and every control string of the common templates gets a backslash after its first
character (a line feed in a role one before it), so no text can open or close a turn, and
dropping each escaping backslash gives the text back.

Edge cases: null role or text is empty; turns are in order of ``turn`` (null first), ties
by role and text; repeated rows are separate turns; a null conv_id is a conversation of
its own; a conversation without assistant turns has no example; one that ends with other
turns keeps them as context of nothing; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.storage import shuffle_width

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
_SEGMENTS = "conv_id long, turn long, ord long, role string, segment string, start long, loss_start long, loss_end long"


def escape(text: Column) -> Column:
    """Reversible: no control string is left in the result."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(turns: DataFrame) -> DataFrame:
    """A row for each turn: its formatted segment, where that starts in the conversation's
    text, and for assistant turns the span of the reply (characters)."""
    head = F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", "\\\\\n")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, nth, at = object(), 0, 0
        for batch in batches:
            out = []
            for conv, turn, role, head, body in zip(*(batch[c].array for c in ("conv_id", "turn", "role", "head", "body")), strict=True):
                key = None if pd.isna(conv) else int(conv)
                if key != now:
                    now, nth, at = key, 0, 0
                segment = f"{head}{body}{CLOSE}\n"
                span = (at + len(head), at + len(head) + len(body)) if role == "assistant" else (None, None)
                out.append((key, None if pd.isna(turn) else int(turn), nth, role, segment, at, *span))
                nth, at = nth + 1, at + len(segment)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SEGMENTS.split(", ")]).astype({c: "Int64" for c in ("conv_id", "turn", "loss_start", "loss_end")})

    dealt = rows.repartition(shuffle_width(turns.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "body").mapInPandas(lay, _SEGMENTS)


def expand(laid: DataFrame) -> DataFrame:
    """A row for each assistant turn: conv_id, ord, context_end, target, loss_start, loss_end.

    The example's text is the first ``context_end`` characters of the conversation's text
    and ``target``; the loss mask counts from the beginning of ``target``.
    """
    return laid.where(F.col("loss_start").isNotNull()).select(
        "conv_id", "ord", F.col("start").alias("context_end"), F.col("segment").alias("target"),
        (F.col("loss_start") - F.col("start")).alias("loss_start"), (F.col("loss_end") - F.col("start")).alias("loss_end"),
    )


def render(laid: DataFrame) -> DataFrame:
    """Whole examples: conv_id, example, text, loss_start, loss_end.

    For conversations whose expansion a worker can hold; ``laid`` comes from ``segments``.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, nth, text = object(), 0, ""
        for batch in batches:
            out = []
            for conv, segment, start, end in zip(*(batch[c].array for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                key = None if pd.isna(conv) else int(conv)
                if key != now:
                    now, nth, text = key, 0, ""
                text += segment
                if not pd.isna(start):
                    out.append((key, nth, text, int(start), int(end)))
                    nth += 1
            yield pd.DataFrame(out, columns=["conv_id", "example", "text", "loss_start", "loss_end"]).astype({"conv_id": "Int64"})

    return laid.mapInPandas(write, "conv_id long, example long, text string, loss_start long, loss_end long")


class Reader:
    """Reads turns back from a conversation's formatted text, given in stretches."""

    def __init__(self):
        self.rest, self.at = "", 0

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        self.at += len(text)
        while (end := self.rest.find(CLOSE)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(CLOSE) + 1 :]
            head = re.match(r"(?:[^\\\n]|\\.)*", turn[len(OPEN) :], re.S)[0]
            yield unescape(head), unescape(turn[len(OPEN) + len(head) + 1 :])


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, examples long, example_chars long"


def read_back(laid: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: what the turns and the loss mask say.

    Turns are read from the contexts' text, the loss from the examples, each at the place
    where its context ends; an example without that place is an error.
    ``formatted_chars`` counts the formatted text once; ``example_chars`` is what the
    expanded examples have together.
    """
    none = F.lit(None).cast("long")
    texts = laid.select("conv_id", "ord", F.lit(0).alias("of"), F.col("segment").alias("text"), F.col("start").alias("at"), none.alias("lo"), none.alias("hi"))
    targets = examples.select("conv_id", "ord", F.lit(1).alias("of"), F.col("target").alias("text"), F.col("context_end").alias("at"), F.col("loss_start").alias("lo"), F.col("loss_end").alias("hi"))
    both = texts.unionAll(targets).repartition(shuffle_width(laid.sparkSession), "conv_id").sortWithinPartitions("conv_id", "ord", "of")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for conv, of, text, at, lo, hi in zip(*(batch[c].array for c in ("conv_id", "of", "text", "at", "lo", "hi")), strict=True):
                key = None if pd.isna(conv) else int(conv)
                if key != now:
                    if state:
                        out.append(_closed(now, state))
                    now, state = key, [Reader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if of == 0:
                    for role, said in state[0].feed(text):
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    continue
                if at + len(text) != state[0].at:
                    raise ValueError("an example's context does not end where its target begins")
                loss = unescape(text[int(lo) : int(hi)])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += 1
                state[6] += at + len(text)
            yield _frame(out)
        if state:
            yield _frame([_closed(now, state)])

    def _closed(key, state):
        reader, turns, all_, chars, loss, examples, example_chars = state
        return key, turns, all_.hexdigest(), chars, loss.hexdigest(), reader.at, examples, example_chars

    def _frame(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return both.mapInPandas(read, _DIGEST)
