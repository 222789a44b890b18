"""Identity dialogue and order lookup.

The dialogue is a fold over a session's messages; ``step`` is one message of it, shared by
the batch plan here and the streaming processor.  Lookups are joins: the fold emits the
customer reference and the order table is joined after it.
"""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docloom.functions import validate
from docloom.functions.rules import ORDER_KEYWORDS
from docloom.functions.text import has_personal_data
from docloom.functions.validate import FIELDS, PROMPTS
from docloom.storage import shuffle_width

INTRO = "I can help check your order status, but I need to verify your identity first."
NOT_FOUND = "I could not find a matching order with the verified details provided. Please confirm your full name, date of birth, and last 4 digits of your SSN."
LOOKUP_FAILED = "I verified your details, but I could not complete the order lookup right now. Please try again shortly."
COLLECTING, ORDER_TOOL, KEEP_DAYS = "COLLECTING_ORDER_VERIFICATION", "order_status_tool", 7
STATE = "full_name string, date_of_birth string, ssn_last4 string, workflow string"
REPLIES = "session_id string, turn long, intent string, workflow string, answer string, customer_ref string, missing array<string>"


def step(state: dict, message: str) -> tuple[dict, dict]:
    """One message: the next state, and what is answered (None where another operator does).

    A session that is collecting stays in the order flow; otherwise keywords route it.
    A new order question clears what was collected; fields are filled once; the first
    validation error is told with the next question.
    """
    message = message or ""
    if state.get("workflow") != "COLLECTING_ORDER_VERIFICATION" and not any(k in message.lower() for k in ORDER_KEYWORDS):
        return state, {"intent": "KNOWLEDGE_QA", "answer": None, "customer_ref": None, "missing": None}
    plain = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", message.casefold())).strip()
    if any(state.get(f) for f in FIELDS) and any(re.search(p, plain) for p in validate.RESTARTS):
        state = {}
    state, errors = dict(state), []
    told = re.search(validate.NAME_TOLD, message) or re.search(validate.NAME_BARE, message)
    if told and not state.get("full_name"):
        state["full_name"] = " ".join(told[1].split())
    if not state.get("date_of_birth"):
        if day := re.search(validate.BIRTH_TOLD, message):
            try:
                state["date_of_birth"] = datetime.strptime(day[1], "%d-%m-%Y").strftime("%Y-%m-%d")
            except ValueError:
                errors.append(validate.DOB_WRONG)
        elif re.search(validate.ISO_TOLD, message):
            errors.append(validate.DOB_WRONG)
    last4 = re.search(validate.SSN_BARE, message) or re.search(validate.SSN_TOLD, message)
    if last4 and not state.get("ssn_last4"):
        state["ssn_last4"] = last4[1]
    missing = [f for f in FIELDS if not state.get(f)]
    state["workflow"] = "COLLECTING_ORDER_VERIFICATION" if missing else "ORDER_COMPLETED"
    answer = f"{errors[0]} {PROMPTS[missing[0]]}" if errors else f"{INTRO} {PROMPTS[missing[0]]}" if missing else None
    ref = None if missing else f"CUSTOMER#{' '.join(state['full_name'].casefold().split())}#{state['date_of_birth']}#{state['ssn_last4']}"
    return state, {"intent": "ORDER_STATUS", "answer": answer, "customer_ref": ref, "missing": missing}


def dialogue(messages: DataFrame) -> DataFrame:
    """``messages`` (session_id, turn, message) -> a reply for each message.

    Sessions are sorted within partitions and folded as a stream, so a long one is never
    held in memory.
    """

    def fold(batches):
        now, state = object(), {}
        for batch in batches:
            out = []
            for session, turn, message in zip(batch["session_id"], batch["turn"], batch["message"], strict=True):
                if session != now:
                    now, state = session, {}
                state, said = step(state, message)
                out.append((session, turn, said["intent"], state.get("workflow", "IDLE"), said["answer"], said["customer_ref"], said["missing"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLIES.split(", ")])

    rows = messages.select(F.col("session_id").cast("string"), F.col("turn").cast("long"), "message")
    return rows.repartition(shuffle_width(messages.sparkSession), "session_id").sortWithinPartitions("session_id", "turn").mapInPandas(fold, REPLIES)


def keyed_orders(orders: DataFrame) -> DataFrame:
    """Orders with their customer reference; of equal references the last order id wins."""
    keyed = orders.withColumn("customer_ref", validate.customer_ref(F.col("full_name"), F.col("dob"), F.col("ssn_last4")))
    rest = [c for c in orders.columns]
    return keyed.groupBy("customer_ref").agg(F.max_by(F.struct(*rest), "order_id").alias("o")).select("customer_ref", "o.*")


def order_text() -> Column:
    found = F.concat(F.lit("Your order "), "order_id", F.lit(" is currently "), "shipment_status", F.lit(" via "), "carrier", F.lit(". Estimated delivery is "), "estimated_delivery", F.lit("."))
    return F.when(F.col("order_id").isNotNull(), found).otherwise(NOT_FOUND)


def with_orders(replies: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Join verified replies to their order; ``tool_result`` says what came of it.

    ``orders`` is None where the order table can't be read: verified customers are told so.
    """
    if orders is None:
        asked = F.col("customer_ref").isNotNull()
        none = {c: F.lit(None).cast("string") for c in ("order_id", "shipment_status", "carrier", "estimated_delivery")}
        return replies.withColumns(none | {"answer": F.when(asked, LOOKUP_FAILED).otherwise(F.col("answer")), "tool_result": F.when(asked, "lookup_failed")})
    joined = replies.join(orders.select("customer_ref", "order_id", "shipment_status", "carrier", "estimated_delivery"), "customer_ref", "left")
    asked = F.col("customer_ref").isNotNull()
    return joined.withColumns({
        "answer": F.when(asked, order_text()).otherwise(F.col("answer")),
        "tool_result": F.when(asked, F.when(F.col("order_id").isNotNull(), "order_found").otherwise("order_not_found")),
    })


def _collected_before() -> Column:
    """Whether a message met a session that was collecting."""
    before = F.lag("workflow").over(W.partitionBy("session_id").orderBy("turn"))
    return F.coalesce(before == COLLECTING, F.lit(False))


def message_log(messages: DataFrame, replies: DataFrame, now: Column, refs: DataFrame | None = None) -> DataFrame:
    """The message store: a user row and an assistant row for each turn.

    ``messages``: session_id, turn, message; ``replies``: ``with_orders``, with answers
    filled in; ``refs``: session_id, turn, retrieval_refs of answers from documents.  A user's
    row is marked as personal while the session collects, or if the text looks so; turns
    without an answer have a user row alone.  ``part`` orders the rows of a turn.
    """
    said = replies.withColumn("_before", _collected_before()).select("session_id", "turn", "_before", "answer", "tool_result", "customer_ref")
    asked = messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "message")
    rows = asked.join(said, ["session_id", "turn"])
    none = F.array().cast("array<string>")
    rows = rows.withColumn("retrieval_refs", none) if refs is None else rows.join(refs.select("session_id", "turn", "retrieval_refs"), ["session_id", "turn"], "left")
    text = lambda c: c.cast("string")
    user = F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("message").alias("content"), (F.col("_before") | F.coalesce(has_personal_data(F.col("message")), F.lit(False))).alias("contains_pii"),
                    text(F.lit(None)).alias("tool_name"), text(F.lit(None)).alias("tool_result_summary"), none.alias("retrieval_refs"))
    reply = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(False).alias("contains_pii"),
                     F.when(F.col("customer_ref").isNotNull(), ORDER_TOOL).alias("tool_name"), F.col("tool_result").alias("tool_result_summary"), F.coalesce("retrieval_refs", none).alias("retrieval_refs"))
    both = rows.select("session_id", "turn", F.inline(F.array(user, reply))).where("part = 0 or content is not null")
    ttl = now.cast("timestamp").cast("long") + KEEP_DAYS * 86400
    return both.withColumns({"message_ts": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "ttl": ttl})


def turn_events(replies: DataFrame) -> DataFrame:
    """session_id, turn, seq, log_event: the structured log of each turn, as JSON.

    ``replies``: ``with_orders``; an optional ``n_sources`` counts an answer's sources.
    """
    order, asks = F.col("intent") == "ORDER_STATUS", F.size("missing") > 0
    status = F.when(asks, "collecting").otherwise("verified")
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    session = F.col("session_id").alias("session_id")
    event = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("event_type"), session, *fields))
    lookup = {"order_not_found": "order_workflow_not_found", "lookup_failed": "order_workflow_lookup_failed", "order_found": "order_workflow_succeeded"}
    tool = [F.when(F.col("tool_result") == result, event(name, F.lit(ORDER_TOOL).alias("tool_name"), F.col("tool_result").alias("tool_result_summary"))) for result, name in lookup.items()]
    n = F.coalesce("n_sources", F.lit(0)) if "n_sources" in replies.columns else F.lit(0)
    events = F.array(
        F.when(~F.col("_before"), event("intent_classified", F.col("intent").alias("intent"))),
        F.when(order, event("order_workflow_collecting", F.lower("workflow").alias("workflow_state"), status.alias("verification_status"), missing.alias("missing_fields"))),
        *tool,
        F.when(order & asks, event("verification_failed", missing.alias("missing_fields"), status.alias("verification_status"))),
        F.when(~order, event("knowledge_query_completed", (n > 0).alias("success"), (n == 0).alias("fallback_used"), n.alias("retrieval_ref_count"))),
        event("chat_orchestration_completed", F.col("intent").alias("intent"), F.when(order & asks, "ask_user").otherwise("respond").alias("next_action")),
    )
    rows = replies.withColumn("_before", _collected_before())
    return rows.select("session_id", "turn", F.posexplode(F.array_compact(events)).alias("seq", "log_event"))
