"""The identity dialogue as a stream, keyed by session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docloom.operators.sessions import REPLIES, STATE, step

IDLE_MS = 7 * 86400 * 1000


def _advance(key, batches, state):
    """Messages of one session in a micro-batch, after what the session remembers."""
    names = [c.split()[0] for c in STATE.split(", ")]
    if state.hasTimedOut:
        state.remove()
        return
    now = {k: v for k, v in zip(names, state.get, strict=True) if v is not None} if state.exists else {}
    out = []
    rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
    for turn, message in zip(rows["turn"], rows["message"], strict=True):
        now, said = step(now, message)
        out.append((key[0], turn, said["intent"], now.get("workflow", "IDLE"), said["answer"], said["customer_ref"], said["missing"]))
    state.update(tuple(now.get(n) for n in names))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLIES.split(", ")])


def reply_stream(messages: DataFrame) -> DataFrame:
    """``messages`` (session_id, turn, message), streaming -> a reply for each message.

    Sessions are forgotten after seven days without a message.  Joining orders
    (``sessions.with_orders``) is a stream-static join after this.
    """
    rows = messages.select(F.col("session_id").cast("string"), F.col("turn").cast("long"), "message")
    return rows.groupBy("session_id").applyInPandasWithState(_advance, REPLIES, STATE, "append", "ProcessingTimeTimeout")
