"""Keyed state with expiry: claims of work, and the last messages of a session.

Both keep what a key needs and no more: a claim is one value, cleared by a timer once it is
stale or too old to matter, and a session is a list of its last messages that expires by
itself.  No log of states grows, and a batch reads the state of its own keys alone.  Both
need the RocksDB state store (``PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.ingest import KEEP_DAYS, STALE_SECONDS
from docloom.storage import shuffle_width

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of an event: its version's key, when, a number that orders equal times, and what it is:
#: a notification, or what came of the work (completed, failed).
EVENTS = ("pk", "at_ms", "seq", "kind")
RESULTS = "pk string, seq long, result string"
KEPT = "session_id string, turns array<long>"
LAST, DAY_MS = 10, 86_400_000


def advance(claim: tuple[str, int] | None, at_ms: int, kind: str) -> tuple[tuple[str, int] | None, str | None]:
    """One event: the claim (status, since when) after it, and the result of a notification:
    processing (it is claimed), skipped (in work) or completed."""
    if kind != "notification":
        return ((kind, at_ms) if claim and claim[0] == "processing" else claim), None
    if claim and claim[0] == "completed" and at_ms - claim[1] <= KEEP_DAYS * DAY_MS:
        return claim, "completed"
    if claim and claim[0] == "processing" and at_ms - claim[1] <= STALE_SECONDS * 1000:
        return claim, "skipped"
    return ("processing", at_ms), "processing"


class Claims(StatefulProcessor):
    """A value for each key, and a timer for when it stops to matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._claim = handle.getValueState("claim", "status string, since_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        claim = tuple(self._claim.get()) if self._claim.exists() else None
        before = claim
        for row in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            claim, result = advance(claim, row.at_ms, row.kind)
            if result:
                yield Row(pk=key[0], seq=row.seq, result=result)
        if claim and claim != before:
            self._claim.update(claim)
            self._handle.registerTimer(self._over(claim))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        claim = tuple(self._claim.get()) if self._claim.exists() else None
        if claim and self._over(claim) <= expiredTimerInfo.getExpiryTimeInMs():
            self._claim.clear()
        return iter(())

    @staticmethod
    def _over(claim: tuple[str, int]) -> int:
        """When a claim is as good as none: no event at or after it sees a difference."""
        wait = {"processing": STALE_SECONDS * 1000, "completed": KEEP_DAYS * DAY_MS}.get(claim[0], 0)
        return claim[1] + wait + 1


def claim_stream(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """``events`` (EVENTS and ``ts``, a timestamp), streaming -> a result for each
    notification (``RESULTS``).  Events may come out of order by ``delay``; within a batch
    they are taken in order."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("pk").transformWithState(Claims(), RESULTS, "Append", "EventTime")


def claims(events: DataFrame) -> DataFrame:
    """The same over a table of events, folded in order as a stream of each key's rows."""

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, claim = None, None
        for batch in batches:
            out = []
            for pk, at_ms, seq, kind in batch[list(EVENTS)].itertuples(index=False):
                if pk != now:
                    now, claim = pk, None
                claim, result = advance(claim, at_ms, kind)
                if result:
                    out.append((pk, seq, result))
            yield pd.DataFrame(out, columns=["pk", "seq", "result"])

    rows = events.select(*EVENTS).where("pk is not null").repartition(shuffle_width(events.sparkSession), "pk").sortWithinPartitions("pk", "at_ms", "seq")
    return rows.mapInPandas(fold, RESULTS)


class LastMessages(StatefulProcessor):
    """A session's last messages: appended, trimmed, forgotten ``ttl_ms`` after the last."""

    def __init__(self, keep: int, ttl_ms: int):
        self._keep, self._ttl = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("messages", "turn long, role string, content string", self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in self._held.get()] + [(r.turn, r.role, r.content) for r in rows]
        held = sorted(held, key=lambda m: m[0])[-self._keep :]
        self._held.put(held)
        yield Row(session_id=key[0], turns=[m[0] for m in held])


def session_stream(messages: DataFrame, keep: int = LAST, ttl_ms: int = 7 * DAY_MS) -> DataFrame:
    """``messages`` (session_id, turn, role, content), streaming -> after each batch the
    turns that each of its sessions keeps, the last ``keep`` (``KEPT``)."""
    rows = messages.select(F.col("session_id").cast("string"), F.col("turn").cast("long"), "role", "content")
    return rows.groupBy("session_id").transformWithState(LastMessages(keep, ttl_ms), KEPT, "Update", "ProcessingTime")
