"""Session trees, conversation context, titles, overlays and orphan recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import floor_zero
from .tree import fold_ancestors

ORPHAN = ["queued", "running", "streaming"]
LIVE_GENERATION = ["queued", "connecting", "streaming"]
RETRYABLE = ["failed", "interrupted", "cancelled"]
REPLAYABLE = ["completed", "cancelled", "interrupted"]
SPACE = r"[\s ﻿\p{Z}]"
# Fixed value: header names that may carry a provider's request id, in order of preference.
REQUEST_ID_HEADERS = ["x-request-id", "request-id", "openai-request-id", "x-amzn-requestid", "cf-ray"]


def _or(upper: Column, lower: Column) -> Column:
    return upper | lower


def archive(sessions: DataFrame, roots: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(sessions, rejects): archive the listed sessions and everything below them.

    Rows already archived keep their times. An unknown root is rejected.
    """
    listed = roots.select(F.col("id").alias("root_id")).distinct()
    marked = sessions.join(listed, F.col("id") == F.col("root_id"), "left").withColumn("_hit", F.col("root_id").isNotNull())
    below = fold_ancestors(marked, "id", "parent_session_id", {"hit": F.col("_hit")}, {"hit": _or}).select(F.col("id").alias("b_id"), "hit")
    out = sessions.join(below, F.col("id") == F.col("b_id"))
    closing = F.col("hit") & (F.col("state") == "active")
    out = out.withColumns(
        {
            "archived_at": F.when(closing, F.lit(at)).otherwise(F.col("archived_at")),
            "updated_at": F.when(closing, F.lit(at)).otherwise(F.col("updated_at")),
            "state": F.when(closing, "archived").otherwise(F.col("state")),
        }
    ).select(*sessions.columns)
    unknown = listed.join(sessions.select("id"), F.col("root_id") == F.col("id"), "left_anti")
    return out, unknown.select(F.col("root_id").alias("id"), F.lit("not_found").alias("reject_code"))


def active_sessions(sessions: DataFrame) -> DataFrame:
    """(id, ancestry): ok, archived, cycle or missing. The first obstacle on the way up decides,
    and an archived session on the path is met before its end."""
    state = {"closed": F.coalesce(F.col("state") != "active", F.lit(True))}
    up = fold_ancestors(sessions, "id", "parent_session_id", state, {"closed": _or})
    ancestry = F.when(F.col("closed"), "archived").when(F.col("cyclic"), "cycle").when(F.col("missing"), "missing").otherwise("ok")
    return up.select("id", ancestry.alias("ancestry"))


def restore(sessions: DataFrame, ids: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(sessions, rejects): reactivate single sessions whose parent chain is active. Children stay as they are."""
    wanted = ids.select(F.col("id").alias("w_id")).distinct()
    chain = active_sessions(sessions).select(F.col("id").alias("p_id"), F.col("ancestry").alias("above"))
    rows = sessions.join(wanted, F.col("id") == F.col("w_id"), "left").join(chain, F.col("parent_session_id") == F.col("p_id"), "left")
    above = F.when(F.col("parent_session_id").isNull(), "ok").otherwise(F.coalesce("above", F.lit("missing")))
    rows = rows.withColumns({"_asked": F.col("w_id").isNotNull(), "_above": above})
    opening = F.col("_asked") & (F.col("_above") == "ok") & (F.col("state") == "archived")
    out = rows.withColumns(
        {
            "archived_at": F.when(~opening, F.col("archived_at")),
            "updated_at": F.when(opening, F.lit(at)).otherwise(F.col("updated_at")),
            "state": F.when(opening, "active").otherwise(F.col("state")),
        }
    ).select(*sessions.columns)
    blocked = rows.filter(F.col("_asked") & (F.col("_above") != "ok")).select("id", F.concat(F.lit("parent_"), "_above").alias("reject_code"))
    unknown = wanted.join(sessions.select("id"), F.col("w_id") == F.col("id"), "left_anti").select(F.col("w_id").alias("id"), F.lit("not_found").alias("reject_code"))
    return out, blocked.unionByName(unknown)


def build_context(messages: DataFrame) -> DataFrame:
    """Turns to replay, one row each; order them by (conversation_id, created_at, id).

    User turns stay. An assistant turn is replayed as stored when its payload is a
    usable assistant message, as plain text when it has any, and is dropped
    otherwise, as is an empty turn that did not complete.
    """
    doc = F.try_parse_json("payload_json")
    part = lambda p: F.try_variant_get(doc, p, "string")
    usable = F.coalesce((part("$.role") == "assistant") & ~F.coalesce(part("$.stopReason").isin("error", "aborted"), F.lit(False)), F.lit(False))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    user = F.col("role") == "user"
    kind = (
        F.when(user, "user")
        .when(empty & (F.col("status") != "completed"), None)
        .when(usable, "payload")
        .when(~empty, "text")
    )
    stop = F.when(kind == "text", F.when(F.col("status").isin(REPLAYABLE), "stop").otherwise("error"))
    out = messages.withColumns({"turn_kind": kind, "stop_reason": stop}).filter(F.col("turn_kind").isNotNull())
    body = F.when(F.col("turn_kind") == "payload", F.col("payload_json")).otherwise(F.col("content"))
    return out.select("conversation_id", "created_at", "id", "role", "turn_kind", body.alias("body"), "stop_reason")


def retryable(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("role") == "assistant") & F.col("status").isin(RETRYABLE))


def retry_context(messages: DataFrame, failed: DataFrame) -> DataFrame:
    """Context for retrying the listed messages: everything up to the failed message, without it."""
    target = retryable(messages).join(failed.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("retry_of"), F.col("conversation_id").alias("t_conv"), F.col("created_at").alias("t_at")
    )
    before = messages.join(
        target, (F.col("conversation_id") == F.col("t_conv")) & (F.col("created_at") <= F.col("t_at")) & (F.col("id") != F.col("retry_of"))
    )
    kept = build_context(before.withColumn("conversation_id", F.concat_ws("\0", "retry_of", "conversation_id")))
    split = F.split("conversation_id", "\0")
    return kept.withColumns({"retry_of": split[0], "conversation_id": split[1]})


def titles(messages: DataFrame) -> DataFrame:
    """Title of each conversation from its first user message: one line, at most 40 characters."""
    first = messages.filter(F.col("role") == "user").groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("text"))
    flat = F.regexp_replace(F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", ""), r"\s+", " ")
    cut = F.regexp_replace(F.substring(flat, 1, 37), f"{SPACE}+$", "")
    return first.select("conversation_id", F.when(F.length(flat) <= 40, flat).otherwise(F.concat(cut, F.lit("..."))).alias("title"))


def recover_generations(generations: DataFrame, live: DataFrame, at: int, note: str = "Generation was interrupted.") -> DataFrame:
    """Interrupt every open generation that is not live."""
    running = live.select(F.col("id").alias("live_id")).distinct()
    out = generations.join(running, F.col("id") == F.col("live_id"), "left")
    orphan = F.col("status").isin(LIVE_GENERATION) & F.col("live_id").isNull()
    out = out.withColumn("interrupted", orphan)
    hit = F.col("interrupted")
    return out.withColumns(
        {
            "status": F.when(hit, "interrupted").otherwise(F.col("status")),
            "completed_at": F.when(hit, F.lit(at)).otherwise(F.col("completed_at")),
            "error": F.when(hit, F.coalesce("error", F.lit(note))).otherwise(F.col("error")),
        }
    ).select(*generations.columns, "interrupted")


def interrupt_messages(messages: DataFrame, generations: DataFrame, at: int, note: str = "Generation was interrupted.") -> DataFrame:
    """Mark the messages of freshly interrupted generations (``recover_generations`` output): status, error if none, updated_at."""
    hit = generations.filter("interrupted").select(F.col("message_id").alias("m_id")).distinct()
    out = messages.join(hit, F.col("id") == F.col("m_id"), "left")
    touched = F.col("m_id").isNotNull()
    old = lambda c, t: F.col(c) if c in messages.columns else F.lit(None).cast(t)
    return out.withColumns(
        {
            "status": F.when(touched, "interrupted").otherwise(F.col("status")),
            "error": F.when(touched, F.coalesce(old("error", "string"), F.lit(note))).otherwise(old("error", "string")),
            "updated_at": F.when(touched, F.lit(at)).otherwise(old("updated_at", "bigint")),
            "interrupted": touched,
        }
    ).drop("m_id")


def touched_conversations(messages: DataFrame, at: int) -> DataFrame:
    """(conversation_id, updated_at) of the conversations in which ``interrupt_messages`` changed a message."""
    return messages.filter("interrupted").select("conversation_id", F.lit(at).cast("long").alias("updated_at")).distinct()


def overlay(messages: DataFrame, live: DataFrame) -> DataFrame:
    """Stored messages with in-flight text, status and error laid over them (live: message_id, text, status, error)."""
    now = live.select(F.col("message_id").alias("l_id"), F.col("text").alias("l_text"), F.col("status").alias("l_status"), F.col("error").alias("l_error"))
    out = messages.join(now, F.col("id") == F.col("l_id"), "left")
    status = F.when(F.col("l_status").isin("queued", "connecting"), "streaming").otherwise(F.col("l_status"))
    return out.select(
        "id",
        "conversation_id",
        F.coalesce(F.when(F.col("l_text") != "", F.col("l_text")), F.col("content")).alias("text"),
        F.coalesce(status, F.col("status")).alias("status"),
        F.coalesce("l_error", "error").alias("error"),
    )


def running_counts(events: DataFrame) -> DataFrame:
    """Unfinished work per session, plus a total row with a NULL session."""
    change = F.when(F.col("type") == "work_started", 1).when(F.col("type") == "work_finished", -1).otherwise(0)
    return events.rollup("session_id").agg(F.sum(change).alias("running"))


# ---- orphaned telemetry --------------------------------------------------

STOP = {"error_type": "ProcessInterrupted", "failure_stage": "process_restart"}


def _stop(df: DataFrame, hit: Column, at: int, failure: bool) -> DataFrame:
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    h = F.col("_hit")
    new = {"status": F.when(h, "interrupted").otherwise(F.col("status")), "completed_at": F.when(h, F.lit(at)).otherwise(F.col("completed_at"))}
    if failure:
        for c, v in STOP.items():
            old = F.col(c) if c in df.columns else F.lit(None).cast("string")
            new[c] = F.when(h, v).otherwise(old)
        if "started_at" in df.columns:
            old = F.col("latency_ms") if "latency_ms" in df.columns else floor_zero(F.col("completed_at") - F.col("started_at"))
            new["latency_ms"] = F.when(h, floor_zero(F.lit(at) - F.col("started_at"))).otherwise(old)
    return df.withColumns(new).drop("_hit")


def _open(df: DataFrame) -> Column:
    return F.col("completed_at").isNull()


def recover_orphans(calls: DataFrame, attempts: DataFrame, runs: DataFrame, turns: DataFrame | None, at: int) -> dict[str, DataFrame]:
    """Interrupt everything left open: calls, their unfinished attempts, runs and turns.

    The calls then go through ``cost.finalize_calls`` with the returned attempts.
    """
    orphan = F.col("status").isin(ORPHAN)
    open_calls = calls.filter(orphan).select(F.col("call_id").alias("o_call")).distinct()
    tied = attempts.join(open_calls, F.col("call_id") == F.col("o_call"), "left")
    out = {
        "calls": _stop(calls, orphan & _open(calls), at, True),
        "attempts": _stop(tied, F.col("o_call").isNotNull() & _open(attempts), at, True).drop("o_call"),
        "runs": _stop(runs, orphan & _open(runs), at, False),
    }
    if turns is not None:
        out["turns"] = _stop(turns, orphan & _open(turns), at, False)
    return out


def interrupt(calls: DataFrame, attempts: DataFrame, runs: DataFrame, turns: DataFrame | None, generations: DataFrame, at: int) -> dict[str, DataFrame]:
    """Interrupt the open call of each listed generation; its run and turn only where the call owns them."""
    listed = calls.join(generations.select(F.col("id").alias("generation_id")).distinct(), "generation_id", "left_semi")
    last = listed.groupBy("generation_id").agg(
        F.max_by(F.struct("call_id", "completed_at", "owns_agent_run", "agent_run_id", "owns_turn", "turn_id"), F.struct("requested_at", "call_id")).alias("c")
    ).select("c.*").filter(F.col("completed_at").isNull())
    hit_calls = last.select(F.col("call_id").alias("h_id"))
    hit_runs = last.filter("owns_agent_run").select(F.col("agent_run_id").alias("h_id")).distinct()
    hit_turns = last.filter("owns_turn AND turn_id IS NOT NULL").select(F.col("turn_id").alias("h_id")).distinct()

    def stop(df, key, hits, failure):
        joined = df.join(hits, F.col(key) == F.col("h_id"), "left")
        return _stop(joined, F.col("h_id").isNotNull() & _open(df), at, failure).drop("h_id")

    out = {
        "calls": stop(calls, "call_id", hit_calls, True),
        "attempts": stop(attempts, "call_id", hit_calls, True),
        "runs": stop(runs, "agent_run_id", hit_runs, False),
    }
    if turns is not None:
        out["turns"] = stop(turns, "turn_id", hit_turns, False)
    return out


def retry_lineage(asked: DataFrame, calls: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, turns) of newly asked messages: message_id, retry_of_message_id, session_id, asked_at.

    A retry is tied to the latest call of the message it repeats: it runs in that call's turn, which is
    opened again, and names the call as its fallback origin. Without such a call, or where that call has
    no turn, a turn of its own starts at ``asked_at``. Turns that do not exist are not opened.
    """
    latest = calls.filter("message_id IS NOT NULL").groupBy(F.col("message_id").alias("of_message")).agg(
        F.max_by(F.struct("call_id", "turn_id"), F.struct("requested_at", "call_id")).alias("previous")
    )
    links = asked.join(latest, F.col("retry_of_message_id") == F.col("of_message"), "left").select(
        "message_id",
        "session_id",
        "asked_at",
        F.coalesce("previous.turn_id", F.concat(F.lit("turn-"), "message_id")).alias("turn_id"),
        F.col("previous.call_id").alias("fallback_from_call_id"),
        F.when(F.col("retry_of_message_id").isNull(), "user_turn").otherwise("user_retry").alias("spawn_reason"),
        F.col("previous.turn_id").isNotNull().alias("reopened"),
    )
    again = links.filter("reopened").select(F.col("turn_id").alias("again_id")).distinct()
    hit = F.col("again_id").isNotNull()
    kept = turns.join(again, F.col("turn_id") == F.col("again_id"), "left").withColumns(
        {"status": F.when(hit, "running").otherwise(F.col("status")), "completed_at": F.when(~hit, F.col("completed_at"))}
    ).select(*turns.columns)
    started = links.filter("NOT reopened").select("turn_id", "session_id", F.col("asked_at").alias("started_at"), F.lit("running").alias("status"))
    return links, kept.unionByName(started, allowMissingColumns=True)


def request_ids(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Provider request id from a header map, names compared without case."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))

    def value(name: str) -> Column:
        hits = F.filter(pairs, lambda e: (e["k"] == name) & (e["v"] != ""))
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])

    return df.withColumn("request_id", F.coalesce(*[value(n) for n in REQUEST_ID_HEADERS]))


def error_details(df: DataFrame) -> DataFrame:
    """Error type and code of a failed call from (error_name, code, status, is_error)."""
    known = F.coalesce(F.col("is_error"), F.lit(False))
    return df.withColumns(
        {
            "error_type": F.when(known, F.coalesce(F.nullif("error_name", F.lit("")), F.lit("Error"))).otherwise("UnknownError"),
            "error_code": F.when(known, F.coalesce(F.col("code").cast("string"), F.col("status").cast("string"))),
        }
    )
