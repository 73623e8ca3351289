"""Queries over sessions, conversations, recovery and display text, with their reference SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import cost as C
from ..operators import report_text as D
from ..operators import sessions as N
from .cost import CALLS, NEED
from .cost import ORACLES as COST_SQL
from .cost import price_list, session_summary, turn_detail
from .derived import DEFS, table, with_ctes
from .trees import money_sql

AT = 1_000_000_000_000
DEFS.update(
    {
        "archive_roots": """
SELECT DISTINCT CASE WHEN n_nationkey = 24 THEN 'nowhere' ELSE 's'||(n_nationkey * 7) END AS id FROM nation""",
        "odd_sessions": """
SELECT 's'||c_custkey AS id, CASE WHEN c_custkey % 100 = 7 THEN 's'||(c_custkey + 1) WHEN c_custkey % 100 = 8 THEN 's'||(c_custkey - 1) WHEN c_custkey % 50 = 49 THEN 'lost' WHEN c_custkey % 5 = 0 THEN NULL
  ELSE 's'||CAST(floor(c_custkey / 3) AS BIGINT) END AS parent_session_id, CASE WHEN c_acctbal < -500 THEN 'archived' ELSE 'active' END AS state, CAST(c_custkey AS BIGINT) AS updated_at,
  CASE WHEN c_acctbal < -500 THEN CAST(c_custkey AS BIGINT) END AS archived_at FROM customer""",
        "message_calls": """
SELECT 'c'||o_orderkey AS call_id, 'm'||o_custkey||'-'||(o_orderkey % 3) AS message_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 's'||o_custkey||'-t'||(o_orderkey % 4) END AS turn_id, @MS(o_orderdate) + o_orderkey % 86400000 AS requested_at FROM orders""",
        "asked_again": """
SELECT 'n'||c_custkey AS message_id, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE 'm'||c_custkey||'-'||(c_custkey % 4) END AS retry_of_message_id, 's'||c_custkey AS session_id,
  CAST(2000000000000 + c_custkey AS BIGINT) AS asked_at FROM customer""",
        "live_states": """
SELECT 'm'||conv_id||'-'||turn AS message_id, CASE WHEN turn % 3 = 1 THEN '' ELSE 'partial text '||conv_id END AS text, CASE turn % 4 WHEN 1 THEN 'queued' WHEN 3 THEN 'connecting' ELSE 'failed' END AS status,
  CASE WHEN conv_id % 2 = 0 THEN 'timeout' END AS error FROM conversations WHERE role = 'assistant'""",
        "work_events": """
SELECT 's'||user_id AS session_id, CASE WHEN event_type IN ('signup', 'view') THEN 'work_started' WHEN event_type = 'click' THEN 'work_finished' ELSE 'updated' END AS type FROM events""",
        "reported_errors": """
SELECT event_id, event_type <> 'view' AS is_error, CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'error' THEN 'TypeError' ELSE 'HttpError' END AS error_name,
  CASE WHEN event_type = 'purchase' THEN 'ECONNRESET' END AS code, CASE WHEN value > 30 THEN CAST(500 AS BIGINT) END AS status FROM events""",
    }
)


def archive_subtree(s, d):
    return N.archive(table(s, d, "sessions"), table(s, d, "archive_roots"), AT)[0].select("id", "state", "updated_at", "archived_at")


def archive_rejects(s, d):
    return N.archive(table(s, d, "sessions"), table(s, d, "archive_roots"), AT)[1]


def active_ancestry(s, d):
    return N.active_sessions(table(s, d, "odd_sessions"))


def _restored(s, d):
    asked = table(s, d, "odd_sessions").filter("state = 'archived'").select("id").unionByName(table(s, d, "archive_roots"))
    return N.restore(table(s, d, "odd_sessions"), asked, AT)


def restore_sessions(s, d):
    return _restored(s, d)[0].select("id", "state", "updated_at", "archived_at")


def restore_rejects(s, d):
    return _restored(s, d)[1]


def build_context(s, d):
    return N.build_context(table(s, d, "messages")).select("conversation_id", "created_at", "id", "role", "turn_kind", F.md5("body").alias("body_md5"), "stop_reason")


def retry_context(s, d):
    m = table(s, d, "messages")
    last = N.retryable(m).groupBy("conversation_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return N.retry_context(m, last).select("retry_of", "conversation_id", "created_at", "id", "turn_kind", "stop_reason")


def titles(s, d):
    return N.titles(table(s, d, "messages"))


def _recovered(s, d):
    g = table(s, d, "generations")
    return N.recover_generations(g, g.filter(F.col("error").isNotNull()).select("id"), AT)


def recover_generations(s, d):
    return _recovered(s, d).select("id", "status", "completed_at", "error", "interrupted")


def _interrupted(s, d):
    stored = table(s, d, "messages").withColumn("error", F.when(F.col("status") == "failed", "stored"))
    return N.interrupt_messages(stored, _recovered(s, d), AT)


def interrupted_messages(s, d):
    return _interrupted(s, d).select("id", "status", "error", "updated_at")


def touched_conversations(s, d):
    return N.touched_conversations(_interrupted(s, d), AT)


def live_overlay(s, d):
    m = table(s, d, "messages").withColumn("error", F.when(F.col("status") == "failed", "stored"))
    return N.overlay(m, table(s, d, "live_states")).select("id", "conversation_id", F.md5("text").alias("text_md5"), "status", "error")


def running_counts(s, d):
    return N.running_counts(table(s, d, "work_events"))


def recovered_calls(s, d):
    """Usage, cost and timing of every call after a restart: stopped calls are finalised with their stopped attempts."""
    out = N.recover_orphans(table(s, d, "model_calls"), table(s, d, "attempts"), table(s, d, "agent_runs"), None, AT)
    calls = C.finalize_calls(out["calls"], C.attempt_cost(out["attempts"], table(s, d, "model_pricing")))
    return calls.select(
        "call_id", "status", "completed_at", F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "usage_source", "api_equivalent_cost_micros", "metered_cost_micros", "ttft_ms",
        "generation_duration_ms", "total_latency_ms",
    )


def recover_orphans(s, d):
    out = N.recover_orphans(table(s, d, "model_calls"), table(s, d, "attempts"), table(s, d, "agent_runs"), table(s, d, "turns"), AT)
    parts = [
        out["calls"].select(F.lit("call").alias("kind"), F.col("call_id").alias("id"), "status", "completed_at", "failure_stage"),
        out["attempts"].select(F.lit("attempt").alias("kind"), F.col("attempt_id").alias("id"), "status", "completed_at", "failure_stage"),
        out["runs"].select(F.lit("run").alias("kind"), F.col("agent_run_id").alias("id"), "status", "completed_at", F.lit(None).cast("string").alias("failure_stage")),
    ]
    turns = out["turns"].select(F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), "status", "completed_at", F.lit(None).cast("string").alias("failure_stage"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(turns)


def interrupt_generations(s, d):
    calls = table(s, d, "model_calls")
    cheap = table(s, d, "orders").filter("o_totalprice < 250000").select(F.concat(F.lit("g"), "o_orderkey").alias("id"))
    out = N.interrupt(calls, table(s, d, "attempts"), table(s, d, "agent_runs"), table(s, d, "turns"), cheap, AT)
    a = out["attempts"].select(F.lit("attempt").alias("kind"), F.col("attempt_id").alias("id"), "status", "completed_at", "latency_ms")
    c = out["calls"].select(F.lit("call").alias("kind"), F.col("call_id").alias("id"), "status", "completed_at", F.lit(None).cast("bigint").alias("latency_ms"))
    r = out["runs"].select(F.lit("run").alias("kind"), F.col("agent_run_id").alias("id"), "status", "completed_at", F.lit(None).cast("bigint").alias("latency_ms"))
    t = out["turns"].select(F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), "status", "completed_at", F.lit(None).cast("bigint").alias("latency_ms"))
    return a.unionByName(c).unionByName(r).unionByName(t)


def _lineage(s, d):
    return N.retry_lineage(table(s, d, "asked_again"), table(s, d, "message_calls"), table(s, d, "turns"))


def retry_links(s, d):
    return _lineage(s, d)[0]


def reopened_turns(s, d):
    return _lineage(s, d)[1].select("turn_id", "session_id", "started_at", "status", "completed_at")


def request_ids(s, d):
    k = F.col("event_id")
    rows = table(s, d, "events").select(
        "event_id",
        F.map_from_arrays(
            F.when(k % 4 == 2, F.array(F.lit("content-type"), F.lit("CF-Ray"))).otherwise(
                F.array(F.lit("CF-RAY"), F.element_at(F.array(*[F.lit(n) for n in ("X-Request-Id", "Request-ID", "", "x-other")]), (k % 4 + 1).cast("int")))
            ),
            F.array(F.concat(F.lit("ray"), k.cast("string")), F.when(k % 5 == 0, "").otherwise(k.cast("string"))),
        ).alias("headers"),
    )
    return N.request_ids(rows).select("event_id", "request_id")


def error_details(s, d):
    return N.error_details(table(s, d, "reported_errors")).select("event_id", "error_type", "error_code")


def usage_report(s, d):
    return D.usage_line(session_summary(s, d))


def turn_report(s, d):
    return D.turn_view(turn_detail(s, d))


def price_report(s, d):
    return D.price_labels(price_list(s, d))


QUERIES = {
    f.__name__: f
    for f in [
        archive_subtree, archive_rejects, active_ancestry, restore_sessions, restore_rejects, build_context, retry_context, titles, recover_generations,
        interrupted_messages, touched_conversations, live_overlay, running_counts, recover_orphans, recovered_calls, interrupt_generations, request_ids, error_details, usage_report, turn_report,
        price_report, retry_links, reopened_turns,
    ]
}

CLO = """clo AS (SELECT id, id AS anc, parent_session_id AS nxt, 0 AS n FROM {t} UNION ALL SELECT c.id, p.id, p.parent_session_id, c.n + 1 FROM clo c JOIN {t} p ON p.id = c.nxt WHERE c.n < 60)"""
ANC = (
    CLO.format(t="odd_sessions")
    + """,
anc AS (SELECT c.id, CASE WHEN bool_or(p.state <> 'active') THEN 'archived' WHEN max(n) >= 60 THEN 'cycle' WHEN bool_or(c.nxt IS NOT NULL AND c.nxt NOT IN (SELECT id FROM odd_sessions)) THEN 'missing' ELSE 'ok' END AS ancestry
  FROM clo c JOIN odd_sessions p ON p.id = c.anc GROUP BY c.id),
ask AS (SELECT id FROM odd_sessions WHERE state = 'archived' UNION SELECT id FROM archive_roots),
judge AS (SELECT s.*, s.id IN (SELECT id FROM ask) AS asked, CASE WHEN parent_session_id IS NULL THEN 'ok' ELSE coalesce(a.ancestry, 'missing') END AS above FROM odd_sessions s LEFT JOIN anc a ON a.id = s.parent_session_id)"""
)
CONTEXT = """ctx AS (SELECT *, CASE WHEN role = 'user' THEN 'user' WHEN content = '' AND status <> 'completed' THEN NULL WHEN payload_json = '{"role":"assistant","stopReason":"stop"}' THEN 'payload' WHEN content <> '' THEN 'text' END AS turn_kind FROM messages)"""
REASON = "CASE WHEN turn_kind = 'text' THEN CASE WHEN status IN ('completed', 'cancelled', 'interrupted') THEN 'stop' ELSE 'error' END END AS stop_reason"
RECOVERED = f"""rec AS (SELECT *, status IN ('queued', 'connecting', 'streaming') AND error IS NULL AS interrupted FROM generations)"""


def tokens_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} >= 1000000 THEN printf('%.1f', {c} / 1000000.0)||'M' WHEN {c} >= 1000 THEN printf('%.1f', (CASE WHEN {c} % 500 = 250 THEN {c} + 50 ELSE {c} END) / 1000.0)||'k' ELSE {c}::VARCHAR END"


def count_sql(c: str) -> str:
    return f"coalesce({c}::VARCHAR, '—') AS {c}"


def ms_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} >= 1000 THEN printf('%.1f', (CASE WHEN {c} % 500 = 250 THEN {c} + 50 ELSE {c} END) / 1000.0)||' s' ELSE {c}||' ms' END"


BILL = "CASE billing_mode WHEN 'subscription' THEN 'subscription' WHEN 'api' THEN 'API' WHEN 'free' THEN 'free' END"


def usd_sql(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN '$0' WHEN {c} >= 0.01 THEN '$'||printf('%.2f', {c}) WHEN {c} >= 0.0001 THEN '$'||printf('%.4f', {c}) ELSE '$'||printf('%.6f', {c}) END"


LINEAGE = """latest AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY requested_at DESC, call_id DESC) AS nth FROM message_calls),
links AS (SELECT a.message_id, a.session_id, a.asked_at, coalesce(p.turn_id, 'turn-'||a.message_id) AS turn_id, p.call_id AS fallback_from_call_id,
  CASE WHEN a.retry_of_message_id IS NULL THEN 'user_turn' ELSE 'user_retry' END AS spawn_reason, p.turn_id IS NOT NULL AS reopened
  FROM asked_again a LEFT JOIN latest p ON p.message_id = a.retry_of_message_id AND p.nth = 1)"""

ORACLES = {
    "retry_links": with_ctes(["asked_again", "message_calls"], "SELECT * FROM links", extra=LINEAGE),
    "reopened_turns": with_ctes(
        ["asked_again", "message_calls", "turns"],
        """SELECT t.turn_id, t.session_id, t.started_at, CASE WHEN r.turn_id IS NULL THEN t.status ELSE 'running' END AS status, CASE WHEN r.turn_id IS NULL THEN t.completed_at END AS completed_at
          FROM turns t LEFT JOIN (SELECT DISTINCT turn_id FROM links WHERE reopened) r ON r.turn_id = t.turn_id
        UNION ALL SELECT turn_id, session_id, asked_at, 'running', NULL FROM links WHERE NOT reopened""",
        extra=LINEAGE,
    ),
    "archive_subtree": with_ctes(
        ["sessions", "archive_roots"],
        f"""SELECT id, CASE WHEN hit AND state = 'active' THEN 'archived' ELSE state END AS state, CASE WHEN hit AND state = 'active' THEN {AT} ELSE updated_at END AS updated_at,
        CASE WHEN hit AND state = 'active' THEN {AT} ELSE archived_at END AS archived_at FROM (SELECT *, id IN (SELECT id FROM clo WHERE anc IN (SELECT id FROM archive_roots)) AS hit FROM sessions)""",
        recursive=True,
        extra=CLO.format(t="sessions"),
    ),
    "archive_rejects": with_ctes(["sessions", "archive_roots"], "SELECT id, 'not_found' AS reject_code FROM archive_roots WHERE id NOT IN (SELECT id FROM sessions)"),
    "active_ancestry": with_ctes(["odd_sessions", "archive_roots"], "SELECT id, ancestry FROM anc", recursive=True, extra=ANC),
    "restore_sessions": with_ctes(
        ["odd_sessions", "archive_roots"],
        f"""SELECT id, CASE WHEN go THEN 'active' ELSE state END AS state, CASE WHEN go THEN {AT} ELSE updated_at END AS updated_at, CASE WHEN NOT go THEN archived_at END AS archived_at
        FROM (SELECT *, asked AND above = 'ok' AND state = 'archived' AS go FROM judge)""",
        recursive=True,
        extra=ANC,
    ),
    "restore_rejects": with_ctes(
        ["odd_sessions", "archive_roots"],
        "SELECT id, 'parent_'||above AS reject_code FROM judge WHERE asked AND above <> 'ok' UNION ALL SELECT id, 'not_found' FROM ask WHERE id NOT IN (SELECT id FROM odd_sessions)",
        recursive=True,
        extra=ANC,
    ),
    "build_context": with_ctes(
        ["messages"],
        f"SELECT conversation_id, created_at, id, role, turn_kind, md5(CASE WHEN turn_kind = 'payload' THEN payload_json ELSE content END) AS body_md5, {REASON} FROM ctx WHERE turn_kind IS NOT NULL",
        extra=CONTEXT,
    ),
    "retry_context": with_ctes(
        ["messages"],
        f"""SELECT f.id AS retry_of, c.conversation_id, c.created_at, c.id, turn_kind, {REASON.replace('status', 'c.status')} FROM ctx c JOIN (SELECT conversation_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS at_ms FROM messages
        WHERE role = 'assistant' AND status IN ('failed', 'interrupted', 'cancelled') GROUP BY 1) f ON f.conversation_id = c.conversation_id AND c.created_at <= f.at_ms AND c.id <> f.id WHERE turn_kind IS NOT NULL""",
        extra=CONTEXT,
    ),
    "titles": with_ctes(
        ["messages"],
        r"""SELECT conversation_id, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(substr(t, 1, 37))||'...' END AS title FROM (SELECT conversation_id, regexp_replace(regexp_replace(arg_min(content, (created_at, id)), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t
        FROM messages WHERE role = 'user' GROUP BY 1)""",
    ),
    "recover_generations": with_ctes(
        ["generations"],
        f"""SELECT id, CASE WHEN interrupted THEN 'interrupted' ELSE status END AS status, CASE WHEN interrupted THEN {AT} ELSE completed_at END AS completed_at,
        CASE WHEN interrupted THEN coalesce(error, 'Generation was interrupted.') ELSE error END AS error, interrupted FROM rec""",
        extra=RECOVERED,
    ),
    "interrupted_messages": with_ctes(
        ["messages", "generations"],
        f"""SELECT id, CASE WHEN hit THEN 'interrupted' ELSE status END AS status, coalesce(CASE WHEN status = 'failed' THEN 'stored' END, CASE WHEN hit THEN 'Generation was interrupted.' END) AS error,
        CASE WHEN hit THEN CAST({AT} AS BIGINT) END AS updated_at FROM (SELECT *, id IN (SELECT message_id FROM rec WHERE interrupted) AS hit FROM messages)""",
        extra=RECOVERED,
    ),
    "touched_conversations": with_ctes(
        ["messages", "generations"],
        f"SELECT DISTINCT conversation_id, CAST({AT} AS BIGINT) AS updated_at FROM messages WHERE id IN (SELECT message_id FROM rec WHERE interrupted)", extra=RECOVERED,
    ),
    "live_overlay": with_ctes(
        ["messages", "live_states"],
        """SELECT m.id, conversation_id, md5(coalesce(nullif(l.text, ''), content)) AS text_md5, coalesce(CASE WHEN l.status IN ('queued', 'connecting') THEN 'streaming' ELSE l.status END, m.status) AS status,
        coalesce(l.error, CASE WHEN m.status = 'failed' THEN 'stored' END) AS error FROM messages m LEFT JOIN live_states l ON l.message_id = m.id""",
    ),
    "running_counts": with_ctes(
        ["work_events"],
        "SELECT session_id, CAST(sum(CASE type WHEN 'work_started' THEN 1 WHEN 'work_finished' THEN -1 ELSE 0 END) AS BIGINT) AS running FROM work_events GROUP BY ROLLUP (session_id)",
    ),
    "recovered_calls": with_ctes(
        NEED,
        """SELECT call_id, status, completed_at, coalesce(attempt_count, 0) AS attempt_count, usage_source, api AS api_equivalent_cost_micros, met AS metered_cost_micros, ttft AS ttft_ms, gen_ms AS generation_duration_ms,
        CASE WHEN completed_at - requested_at < 0 THEN 0 ELSE completed_at - requested_at END AS total_latency_ms FROM fin""",
        extra=f"""stopped_calls AS (SELECT * REPLACE (CASE WHEN status = 'streaming' AND completed_at IS NULL THEN 'interrupted' ELSE status END AS status,
          coalesce(completed_at, CASE WHEN status = 'streaming' THEN {AT} END) AS completed_at) FROM model_calls),
        stopped_attempts AS (SELECT * REPLACE (CASE WHEN h THEN 'interrupted' ELSE status END AS status, CASE WHEN h THEN {AT} ELSE completed_at END AS completed_at)
          FROM (SELECT *, completed_at IS NULL AND call_id IN (SELECT call_id FROM model_calls WHERE status = 'streaming') AS h FROM attempts)),
        """
        + re.sub(r"\bmodel_calls\b", "stopped_calls", re.sub(r"\battempts\b", "stopped_attempts", CALLS)),
    ),
    "recover_orphans": with_ctes(
        ["model_calls", "attempts", "agent_runs", "turns"],
        f"""SELECT 'call' AS kind, call_id AS id, CASE WHEN status = 'streaming' AND completed_at IS NULL THEN 'interrupted' ELSE status END AS status, coalesce(completed_at, CASE WHEN status = 'streaming' THEN {AT} END) AS completed_at,
          CASE WHEN status = 'streaming' AND completed_at IS NULL THEN 'process_restart' END AS failure_stage FROM model_calls
        UNION ALL SELECT 'attempt', attempt_id, CASE WHEN h THEN 'interrupted' ELSE status END, CASE WHEN h THEN {AT} ELSE completed_at END, CASE WHEN h THEN 'process_restart' END
          FROM (SELECT *, completed_at IS NULL AND call_id IN (SELECT call_id FROM model_calls WHERE status = 'streaming') AS h FROM attempts)
        UNION ALL SELECT 'run', agent_run_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END, CASE WHEN status = 'running' THEN {AT} ELSE completed_at END, NULL FROM agent_runs
        UNION ALL SELECT 'turn', turn_id, CASE WHEN status = 'streaming' THEN 'interrupted' ELSE status END, CASE WHEN status = 'streaming' THEN {AT} ELSE completed_at END, NULL FROM turns""",
    ),
    "interrupt_generations": with_ctes(
        ["model_calls", "attempts", "agent_runs", "turns"],
        f"""SELECT 'attempt' AS kind, attempt_id AS id, CASE WHEN h THEN 'interrupted' ELSE status END AS status, CASE WHEN h THEN {AT} ELSE completed_at END AS completed_at,
          CASE WHEN h THEN greatest({AT} - started_at, 0) ELSE completed_at - started_at END AS latency_ms FROM (SELECT *, completed_at IS NULL AND call_id IN (SELECT call_id FROM hit) AS h FROM attempts)
        UNION ALL SELECT 'call', call_id, CASE WHEN h THEN 'interrupted' ELSE status END, CASE WHEN h THEN {AT} ELSE completed_at END, NULL FROM (SELECT *, call_id IN (SELECT call_id FROM hit) AS h FROM model_calls)
        UNION ALL SELECT 'run', agent_run_id, CASE WHEN h THEN 'interrupted' ELSE status END, CASE WHEN h THEN {AT} ELSE completed_at END, NULL
          FROM (SELECT *, completed_at IS NULL AND agent_run_id IN (SELECT agent_run_id FROM hit WHERE owns_agent_run) AS h FROM agent_runs)
        UNION ALL SELECT 'turn', turn_id, CASE WHEN h THEN 'interrupted' ELSE status END, CASE WHEN h THEN {AT} ELSE completed_at END, NULL
          FROM (SELECT *, completed_at IS NULL AND turn_id IN (SELECT turn_id FROM hit WHERE owns_turn AND turn_id IS NOT NULL) AS h FROM turns)""",
        extra="hit AS (SELECT * FROM model_calls WHERE completed_at IS NULL AND generation_id IN (SELECT 'g'||o_orderkey FROM orders WHERE o_totalprice < 250000))",
    ),
    "request_ids": """SELECT event_id, CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id::VARCHAR END WHEN event_id % 4 < 2 AND event_id % 5 <> 0 THEN event_id::VARCHAR ELSE 'ray'||event_id END AS request_id FROM events""",
    "error_details": with_ctes(
        ["reported_errors"],
        "SELECT event_id, CASE WHEN is_error THEN coalesce(nullif(error_name, ''), 'Error') ELSE 'UnknownError' END AS error_type, CASE WHEN is_error THEN coalesce(code, status::VARCHAR) END AS error_code FROM reported_errors",
    ),
    "usage_report": f"""SELECT session_id, {tokens_sql('input_tokens')}||' in · '||{tokens_sql('cache_read_tokens')}||' cache · '||{tokens_sql('output_tokens')}||' out' AS tokens,
        CASE WHEN cost_micros IS NOT NULL THEN '$'||(CASE WHEN cost_micros >= 10000 THEN printf('%.2f', cost_micros / 1000000.0) WHEN cost_micros >= 100 THEN printf('%.4f', cost_micros / 1000000.0) ELSE printf('%.6f', cost_micros / 1000000.0) END)
          ||CASE WHEN has_unknown_cost THEN '+' ELSE '' END END AS cost, (CASE WHEN context_percent = floor(context_percent) THEN context_percent::BIGINT::VARCHAR ELSE printf('%.1f', context_percent) END)||'%' AS context
        FROM ({COST_SQL['session_summary']})""",
    "turn_report": f"""SELECT session_id, agent_name||' turn' AS title, {money_sql('api_equivalent_micros', 'api_equivalent_currency')} AS api_equivalent,
        {money_sql('metered_micros', 'metered_currency')}||CASE WHEN billing_mode IN ('subscription', 'token_plan', 'free') THEN ' / '||{BILL} ELSE '' END AS metered,
        {', '.join(count_sql(c + '_tokens') for c in ('uncached_input', 'cache_read', 'cache_write', 'output', 'reasoning'))}, {ms_sql('ttft_ms')} AS ttft, {ms_sql('latency_ms')} AS latency,
        CASE WHEN output_tokens_per_second_milli IS NULL THEN '—' WHEN output_tokens_per_second_milli >= 10000 THEN CAST(floor(output_tokens_per_second_milli / 1000.0 + 0.5) AS BIGINT)||' tok/s'
          ELSE printf('%.1f', output_tokens_per_second_milli / 1000.0)||' tok/s' END AS speed, account_label||coalesce(' '||{BILL}, '') AS account FROM ({COST_SQL['turn_detail']})""",
    "price_report": f"""SELECT provider, model, CASE WHEN input_usd IS NULL AND output_usd IS NULL THEN 'No price yet' ELSE coalesce({usd_sql('input_usd')}, '—')||' in · '||coalesce({usd_sql('output_usd')}, '—')||' out' END AS price_label,
        nullif(concat_ws(' · ', CASE WHEN cache_read_usd > 0 THEN {usd_sql('cache_read_usd')}||' cache read' END, CASE WHEN cache_write_usd > 0 THEN {usd_sql('cache_write_usd')}||' cache write' END), '') AS cache_label,
        CASE source WHEN 'user' THEN 'Your price' WHEN 'catalog' THEN 'Catalog' END AS source_label, CASE WHEN source = 'none' THEN 'Add price' ELSE 'Edit price' END AS action_label,
        coalesce(regexp_replace(regexp_replace(printf('%.6f', input_usd), '0+$', ''), '\\.$', ''), '') AS draft_input, coalesce(regexp_replace(regexp_replace(printf('%.6f', cache_read_usd), '0+$', ''), '\\.$', ''), '') AS draft_cache_read
        FROM ({COST_SQL['price_list']})""",
}
