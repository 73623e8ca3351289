"""Streaming queries, run to the end of the available data, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as X
from ..streaming import streams as S
from .derived import DEFS, _ms, _refs, table, with_ctes
from .retrieval import FP

DEFS.update(
    {
        "tool_events": """
SELECT 'inv'||CAST(floor(event_id / 4) AS BIGINT) AS invocation_id, CASE event_id % 4 WHEN 0 THEN 'invocation_started' WHEN 1 THEN 'authorization_decided' WHEN 2 THEN 'execution_started' ELSE 'invocation_finished' END AS type, @MS(ts) AS at_ms, 'tool'||CAST(floor(event_id / 4) % 7 AS BIGINT) AS tool_name,
  CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_type = 'error' THEN 'deny' WHEN event_type = 'view' THEN 'require_confirmation' ELSE 'allow' END END AS decision, CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END END AS status,
  CASE WHEN event_id % 4 = 3 AND event_type = 'error' THEN 'execution' END AS failure_stage, 's'||CAST(floor(event_id / 4) % 9 AS BIGINT) AS session_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE 't'||(user_id % 2) END AS turn_id FROM events""",
        "diagnostic_events": """
SELECT ts, CASE event_type WHEN 'error' THEN 'index_failed' WHEN 'view' THEN 'lexical_ready' WHEN 'click' THEN 'embedding_complete' ELSE 'index_staged' END AS event, CASE WHEN event_type = 'error' THEN 'code'||(user_id % 3) ELSE '' END AS code, CAST(floor(value) AS BIGINT) AS duration_ms FROM events""",
        "new_items": """
SELECT 'd'||doc_id AS id, 'docs.'||lang AS namespace, 'document' AS type, source AS source_system, 'record' AS source_type, CAST(doc_id AS VARCHAR(20)) AS source_id, text AS content, CAST(doc_id * 10 AS BIGINT) AS created_at, CAST(doc_id * 10 + 1 AS BIGINT) AS updated_at,
  CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE 'team' END AS scope_kind, 't'||(doc_id % 5) AS scope_key, CAST(NULL AS VARCHAR(20)) AS metadata_json, CAST(1 AS BIGINT) AS projection_version, doc_id AS seq FROM documents""",
    }
)


FILES = 4


def stream_of(s, d, name):
    """A derived table over streamed input (definitions without windows only): several files, one per micro-batch, in no order of time."""
    source = _refs(name)[0]
    folder = S.work_folder(s)
    given = s.read.parquet(f"{d}/{source}.parquet")
    given.repartition(FILES, F.xxhash64(given.columns[0])).write.parquet(folder)
    live = s.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sql = _ms(DEFS[name], duck=False).replace("{", "{{").replace("}", "}}").replace("VARCHAR(20)", "STRING")
    df = s.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: live})
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def _attempts(s, d):
    return S.attempt_fold(stream_of(s, d, "token_events"))


TIMING = ["attempt_id", "started_at", "response_received_at", "http_status", "first_token_at", "last_token_at", "completed_at"]
LIFE = ["attempt_id", "status", "failure_stage"]


def attempt_timing_stream(s, d):
    return _attempts(s, d).select(*TIMING)


def generation_lifecycle(s, d):
    return _attempts(s, d).select(*LIFE)


def attempt_timing(s, d):
    return S.attempt_fold_batch(table(s, d, "token_events")).select(*TIMING, *LIFE[1:])


def assembled_text(s, d):
    deltas = table(s, d, "token_events").filter("event = 'token'").withColumnRenamed("attempt_id", "generation_id")
    return S.assembled_text(deltas).select("generation_id", "deltas", F.md5("text").alias("text_md5"))


def terminal_stream(s, d):
    return S.settle(S.terminal_once(stream_of(s, d, "token_events")).select("attempt_id"), None, "append")


def tool_fold(s, d):
    return S.tool_fold(table(s, d, "tool_events"))


def tool_fold_stream(s, d):
    return S.settle(S.tool_fold(stream_of(s, d, "tool_events")), ["invocation_id"])


def diagnostics_stream(s, d):
    return S.add_up(stream_of(s, d, "diagnostic_events"), S.diagnostics_windows, ["minute_ms", "event", "code"])


def recent_diagnostics(s, d):
    """The last 200 diagnostics of the stream: what its log holds, newest first."""
    stream = stream_of(s, d, "diagnostic_events")
    return S.recent(S.settle(stream, None, "append"), ["ts", "event", "code", "duration_ms"]).select(F.unix_micros("ts").alias("at_us"), "event", "code", "duration_ms")


def running_gauge_stream(s, d):
    return S.settle(S.running_gauge(stream_of(s, d, "work_events")), ["session_id"])


def incremental_index_stream(s, d):
    folder = S.work_folder(s)
    empty = table(s, d, "retrieval_items").withColumn("content_hash", X.content_hash(F.col("content"))).filter(F.lit(False))
    S.incremental_index(stream_of(s, d, "new_items"), folder, FP, lambda b: 1000 + b, empty)
    none = lambda c: F.lit(None).cast("string").alias(c)
    items = S.latest(s, folder, "items").select("id", "lexical_state", "vector_state", none("reject_code"))
    refused = S.refused(s, folder).select("id", none("lexical_state"), none("vector_state"), "reject_code")
    return items.unionByName(refused)


QUERIES = {
    f.__name__: f
    for f in [
        attempt_timing, attempt_timing_stream, generation_lifecycle, assembled_text, terminal_stream, tool_fold, tool_fold_stream,
        diagnostics_stream, recent_diagnostics, running_gauge_stream, incremental_index_stream,
    ]
}

FOLDED = """ends AS (SELECT attempt_id, min((at_ms, seq)) AS fin FROM token_events WHERE event IN ('completed', 'failed') GROUP BY 1),
live AS (SELECT t.* FROM token_events t LEFT JOIN ends e USING (attempt_id) WHERE fin IS NULL OR (at_ms, seq) <= fin),
att AS (SELECT attempt_id, coalesce(arg_max(CASE event WHEN 'token' THEN 'streaming' ELSE event END, (at_ms, seq)) FILTER (WHERE event IN ('token', 'completed', 'failed')), 'connecting') AS status, min(at_ms) FILTER (WHERE event = 'started') AS started_at,
  max(at_ms) FILTER (WHERE event = 'response') AS response_received_at, arg_max(http_status, (at_ms, seq)) FILTER (WHERE event = 'response') AS http_status, min(at_ms) FILTER (WHERE event = 'token') AS first_token_at, max(at_ms) FILTER (WHERE event = 'token') AS last_token_at,
  max(at_ms) FILTER (WHERE event IN ('completed', 'failed')) AS completed_at FROM live GROUP BY attempt_id)"""
STAGE = "CASE WHEN status = 'failed' THEN CASE WHEN first_token_at IS NOT NULL THEN 'stream' ELSE 'request' END END AS failure_stage"
TOOL = """SELECT invocation_id, max(tool_name) AS tool_name, min(session_id) AS session_id, min(turn_id) AS turn_id, coalesce(min(session_id) <> max(session_id), false) OR coalesce(min(turn_id) <> max(turn_id), false) AS conflicting_correlation,
  max(at_ms) FILTER (WHERE type = 'invocation_started') AS started_at, max(decision) AS decision, max(at_ms) FILTER (WHERE type = 'execution_started') AS execution_started_at, max(at_ms) FILTER (WHERE type = 'invocation_finished') AS finished_at,
  max(status) AS status, max(failure_stage) AS failure_stage, max(at_ms) FILTER (WHERE type = 'invocation_finished') - max(at_ms) FILTER (WHERE type = 'invocation_started') AS duration_ms FROM tool_events GROUP BY invocation_id"""

ORACLES = {
    "attempt_timing": with_ctes(["token_events"], f"SELECT {', '.join(TIMING)}, status, {STAGE} FROM att", extra=FOLDED),
    "attempt_timing_stream": with_ctes(["token_events"], f"SELECT {', '.join(TIMING)} FROM att", extra=FOLDED),
    "generation_lifecycle": with_ctes(["token_events"], f"SELECT attempt_id, status, {STAGE} FROM att", extra=FOLDED),
    "assembled_text": with_ctes(
        ["token_events"],
        "SELECT attempt_id AS generation_id, count(*) AS deltas, md5(string_agg(delta, '' ORDER BY at_ms, seq)) AS text_md5 FROM token_events WHERE event = 'token' GROUP BY 1",
    ),
    "terminal_stream": with_ctes(["token_events"], "SELECT DISTINCT attempt_id FROM token_events WHERE event IN ('completed', 'failed')"),
    "tool_fold": with_ctes(["tool_events"], TOOL),
    "tool_fold_stream": with_ctes(["tool_events"], TOOL),
    "diagnostics_stream": with_ctes(
        ["diagnostic_events"],
        "SELECT epoch_us(date_trunc('minute', ts)) // 1000 AS minute_ms, event, code, count(*) AS events, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM diagnostic_events GROUP BY 1, 2, 3",
    ),
    "recent_diagnostics": with_ctes(
        ["diagnostic_events"],
        "SELECT epoch_us(ts) AS at_us, event, code, duration_ms FROM diagnostic_events ORDER BY ts DESC, event DESC, code DESC, duration_ms DESC LIMIT 200",
    ),
    "running_gauge_stream": with_ctes(
        ["work_events"], "SELECT session_id, CAST(sum(CASE type WHEN 'work_started' THEN 1 WHEN 'work_finished' THEN -1 ELSE 0 END) AS BIGINT) AS running FROM work_events GROUP BY 1"
    ),
    "incremental_index_stream": with_ctes(
        ["new_items"],
        """SELECT id, CASE WHEN scope_kind = 'team' THEN 'ready' END AS lexical_state, CASE WHEN scope_kind = 'team' THEN 'pending' END AS vector_state, CASE WHEN scope_kind = 'global' THEN 'invalid_item' END AS reject_code FROM new_items""",
    ),
}
