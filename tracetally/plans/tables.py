"""Queries over table maintenance, imports and lookups, with their reference SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import shared_folder
from ..operators import lookups as L
from ..operators.pricing import RATES
from ..sources import imports as I
from ..sources import tables as T
from ..sources.schemas import SCHEMAS
from .derived import DEFS, table, with_ctes

# inputs only these queries need
DEFS.update(
    {
        "session_changes": """
SELECT 's'||o_custkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS title, 'chat' AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'archived' WHEN o_orderstatus = 'O' THEN 'active' END AS state, @MS(o_orderdate) AS updated_at, o_orderkey AS seq FROM orders""",
        "account_rows": """
SELECT 'a'||(s_suppkey * 2) AS id, s_name AS name, s_suppkey AS created_at FROM supplier""",
        "account_inserts": """
SELECT 'a'||(c_custkey % 1500) AS id, c_name AS name, c_custkey AS created_at FROM customer""",
        "price_inserts": """
SELECT 'price'||(p_partkey % 900) AS pricing_snapshot_id, 'p1' AS provider, 'm1' AS model, CAST(floor((p_retailprice - 950) * 1000) AS BIGINT) AS input_per_million_micros,
  p_partkey AS seq FROM part""",
        "plan_inserts": """
SELECT 'plan'||p_partkey AS subscription_plan_id, CAST(floor((p_retailprice - 930) * 1000) AS BIGINT) AS price_micros, CAST(p_size AS BIGINT) AS period_start,
  CAST(p_size + p_partkey % 4 - 1 AS BIGINT) AS period_end, p_partkey AS seq FROM part""",
        "usage_json": """
SELECT 'c'||l_orderkey AS call_id, l_linenumber AS line, CASE WHEN l_tax >= 0.08 THEN 'not json' WHEN l_tax >= 0.07 THEN '{"input":0,"cacheRead":0,"output":0,"totalTokens":0}'
    WHEN l_tax >= 0.06 THEN '{"input":'||CAST(l_quantity AS BIGINT)||'.5,"output":"12","cacheRead":-3}'
    WHEN l_tax >= 0.05 THEN '{"output":"12","reasoning":null}'
    ELSE '{"input":'||CAST(l_quantity AS BIGINT)||',"cacheRead":'||l_suppkey||',"cacheWrite":0,"output":'||l_partkey||CASE WHEN l_discount > 0.05 THEN ',"reasoning":'||l_linenumber ELSE '' END
      ||',"totalTokens":'||(l_suppkey + l_partkey)||',"cost":{"input":0.25,"total":1.5}}' END AS usage_json,
  CASE WHEN l_linestatus = 'F' THEN 'resp'||l_partkey END AS response_id, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN 'pending' ELSE 'stop' END AS stop_reason,
  CASE WHEN l_linenumber = 2 THEN 'end_turn' END AS raw_stop_reason FROM lineitem""",
        "price_sheet": """
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN '$1,'||(100 + p_size)||'.5' WHEN p_size % 6 = 1 THEN p_size||'c' WHEN p_size % 6 = 2 THEN ' .5 USD ' WHEN p_size % 6 = 3 THEN '$ '||p_size||' cents' WHEN p_size % 6 = 4 THEN p_size||' ¢' ELSE '' END AS input_text,
  CASE WHEN p_partkey % 11 = 0 THEN '-3' WHEN p_partkey % 13 = 0 THEN 'free' ELSE '$'||p_retailprice END AS output_text, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE '0.'||p_size END AS cache_read_text,
  CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 3 = 0 THEN NULL ELSE '1.25 usd' END AS cache_write_text FROM part""",
        "doomed_agents": """
SELECT DISTINCT 'agent'||s_nationkey AS agent_id FROM supplier WHERE s_acctbal < 0""",
    }
)


def typed_scan(s, d):
    raw = table(s, d, "model_calls").withColumn("owns_turn", F.col("owns_turn").cast("int"))
    return T.conform(raw, SCHEMAS["model_calls"]).select(
        "call_id", "owns_turn", "message_id", "requested_at", "provider_account_id", "metered_cost_micros"
    )


def stored_scan(s, d):
    """A table written as a snapshot and read back with its fixed schema, as Parquet and as JSON."""
    folder = f"{shared_folder(s)}/scan-{uuid.uuid4().hex}"
    calls = table(s, d, "model_calls")
    T.write_snapshot(calls, folder, "model_calls", "1")
    flags = [c for c, t in calls.dtypes if t == "boolean"]
    calls.withColumns({c: F.col(c).cast("int") for c in flags}).write.json(f"{folder}/json/model_calls")
    cols = ["call_id", "owns_turn", "message_id", "requested_at", "metered_cost_micros"]
    back = T.read_table(s, folder, "model_calls").select(F.lit("parquet").alias("format"), *cols)
    return back.unionByName(T.read_table(s, f"{folder}/json", "model_calls", "json").select(F.lit("json").alias("format"), *cols))


COLS = ["id", "title", "kind", "state", "updated_at"]


def upsert(s, d):
    return T.upsert(table(s, d, "sessions").select(*COLS), table(s, d, "session_changes"), "id", ["updated_at", "seq"])


def patch_update(s, d):
    return T.upsert(table(s, d, "sessions").select(*COLS), table(s, d, "session_changes"), "id", ["updated_at", "seq"], patch=True)


def insert_missing(s, d):
    return T.insert_missing(table(s, d, "account_rows"), table(s, d, "account_inserts"), "id", ["created_at"])


def _priced(s, d):
    cur = table(s, d, "model_pricing").select("pricing_snapshot_id", "provider", "model", "input_per_million_micros")
    rules = {"invalid_rate": T.unsafe("input_per_million_micros")}
    return T.append_immutable(cur, table(s, d, "price_inserts"), "pricing_snapshot_id", rules, ["seq"])


def append_immutable(s, d):
    return _priced(s, d)[0]


def append_rejects(s, d):
    return _priced(s, d)[1].select("pricing_snapshot_id", "seq", "reject_code")


def plan_rejects(s, d):
    new = table(s, d, "plan_inserts")
    rules = {"invalid_price": T.unsafe("price_micros"), "invalid_period": F.col("period_end") <= F.col("period_start")}
    return T.append_immutable(new.drop("seq").filter(F.lit(False)), new, "subscription_plan_id", rules, ["seq"])[1].select(
        "subscription_plan_id", "reject_code"
    )


def first_terminal(s, d):
    return T.first_terminal(table(s, d, "token_events"), "attempt_id", "at_ms", "seq", "event").select("attempt_id", "at_ms", "seq", "event")


def soft_delete(s, d):
    return T.soft_delete(table(s, d, "agents"), table(s, d, "doomed_agents"), 77_000)


def integrity_report(s, d):
    return T.integrity_report(table(s, d, "model_calls"), table(s, d, "attempts"), table(s, d, "agent_runs"), table(s, d, "agents"))


def upgrade(s, d):
    old = table(s, d, "sessions").select("id", "title", "created_at", "updated_at")
    return T.upgrade(old, "sessions", 5)


USAGE_OUT = [c for c, _ in I.USAGE_FIELDS.values()]


def normalize_usage(s, d):
    return I.normalize_usage(table(s, d, "usage_json"), "usage_json").select(
        "call_id", "line", "has_usage", "usage_source", "provenance_json", *USAGE_OUT
    )


def generation_usage(s, d):
    return I.generation_usage(table(s, d, "usage_json"), "usage_json").select(
        "call_id", "line", "input_tokens", "output_tokens", "cached_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens",
        "cost_input", "cost_total", "request_id", "finish_reason", "has_generation_usage",
    )


PRICE_COLS = [f"{c}_per_million_micros" for c in ("input", "output", "cache_read", "cache_write")]


def import_price_sheet(s, d):
    ok, bad = I.import_price_sheet(table(s, d, "price_sheet"))
    cols = ["p_partkey", "reject_code", *PRICE_COLS]
    return ok.select(*cols).unionByName(bad.select("p_partkey", "reject_code"), allowMissingColumns=True)


def vector_codec(s, d):
    rows = table(s, d, "embeddings").withColumn("dimensions", F.size("embedding"))
    ok, _ = I.decode_vectors(I.encode_vectors(rows, "embedding"))
    back = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda x, y: x + y)
    return ok.select("vec_id", F.octet_length("data").cast("long").alias("n_bytes"), back.alias("loss"))


def get_by_id(s, d):
    wanted = table(s, d, "cost_allocations").select("call_id")
    return L.by_keys(table(s, d, "model_calls"), wanted, "call_id").select("call_id", "session_id", "status", "requested_at")


def runs_by_turn(s, d):
    turns = table(s, d, "model_calls").select("turn_id").filter(F.col("turn_id").isNotNull())
    return L.by_keys(table(s, d, "agent_runs"), turns, "turn_id").select("turn_id", "agent_run_id", "started_at")


def calls_by_status(s, d):
    return L.by_status(table(s, d, "model_calls"), ["queued", "running", "streaming"]).select("call_id", "status", "requested_at")


def calls_by_session(s, d):
    w = table(s, d, "model_calls").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.min("requested_at").alias("first_at"), F.max("requested_at").alias("last_at"),
        F.min_by("call_id", F.struct("requested_at", "call_id")).alias("first_call"),
    )
    return w


def calls_of_agent(s, d):
    return L.by_value(table(s, d, "model_calls"), ["requested_at", "call_id"], agent_id="agent3").select("call_id", "requested_at")


def latest_call_per_turn(s, d):
    return L.latest_by(table(s, d, "model_calls"), "turn_id", "requested_at", "call_id").select("turn_id", "call_id", "requested_at")


def attempts_by_call(s, d):
    failed = L.by_status(table(s, d, "model_calls"), ["failed"])
    return L.by_keys(table(s, d, "attempts"), failed, "call_id").select("call_id", "attempt_number", "attempt_id", "status")


def allocations_by_call(s, d):
    done = L.by_status(table(s, d, "model_calls"), ["completed"])
    return L.by_keys(table(s, d, "cost_allocations"), done, "call_id").select("call_id", "created_at", "allocation_id", "amount_micros")


def prices_valid_at(s, d):
    return L.prices_valid_at(table(s, d, "model_pricing"), 930_000_000_000).select("pricing_snapshot_id", *RATES[:1])


def sessions_by_state(s, d):
    return L.sessions_by_state(table(s, d, "sessions"), "archived").select("id", "updated_at", "archived_at")


def session_children(s, d):
    archived = table(s, d, "sessions").filter(F.col("state") == "archived")
    return L.children_of(table(s, d, "sessions"), archived).select("parent_session_id", "id")


OPEN = {"turns": ("turn_id", ["streaming"]), "agent_runs": ("agent_run_id", ["queued", "running"]), "generations": ("id", ["queued", "connecting", "streaming"])}


def open_records(s, d):
    """Turns, runs and generations that are still open; no status asked of the calls, so none of them."""
    kinds = [(k, key, statuses) for k, (key, statuses) in OPEN.items()] + [("model_calls", "call_id", [])]
    parts = [L.by_status(table(s, d, k), statuses).select(F.lit(k).alias("kind"), F.col(key).alias("id"), "status") for k, key, statuses in kinds]
    return reduce(DataFrame.unionByName, parts)


def calls_by_origin(s, d):
    """Calls of open turns, of open runs, and those that replace a failed call."""
    calls = table(s, d, "model_calls")
    keys = {
        "turn_id": L.by_status(table(s, d, "turns"), ["streaming"]).select("turn_id"),
        "agent_run_id": L.by_status(table(s, d, "agent_runs"), ["running"]).select("agent_run_id"),
        "fallback_from_call_id": L.by_status(calls, ["failed"]).select(F.col("call_id").alias("fallback_from_call_id")),
    }
    parts = [L.by_keys(calls, wanted, k).select(F.lit(k).alias("origin"), F.col(k).alias("key"), "call_id", "requested_at") for k, wanted in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def latest_call_per_message(s, d):
    """The newest call of every message and of every generation; a message is retried by later calls."""
    no = F.substring("call_id", 2, 20).cast("long")
    message = F.when(no % 11 > 0, F.concat("session_id", F.lit("-m"), (no % 3).cast("string")))
    calls = table(s, d, "model_calls").withColumns({"message_id": message, "generation_id": F.concat(message, F.lit("-g"), (no % 2).cast("string"))})
    parts = [
        L.latest_by(calls.select(k, "call_id", "requested_at"), k, "requested_at", "call_id").select(F.lit(k).alias("origin"), F.col(k).alias("key"), "call_id", "requested_at")
        for k in ("message_id", "generation_id")
    ]
    return reduce(DataFrame.unionByName, parts)


def messages_of_conversation(s, d):
    closed = table(s, d, "generations").filter(F.col("status") == "completed").select("conversation_id")
    return L.by_keys(table(s, d, "messages"), closed, "conversation_id").select("conversation_id", "created_at", "id", "role")


QUERIES = {
    f.__name__: f
    for f in [
        typed_scan, stored_scan, upsert, patch_update, insert_missing, append_immutable, append_rejects, plan_rejects, first_terminal, soft_delete,
        integrity_report, upgrade, normalize_usage, generation_usage, import_price_sheet, vector_codec, get_by_id, runs_by_turn,
        calls_by_status, calls_by_session, calls_of_agent, latest_call_per_turn, attempts_by_call, allocations_by_call, prices_valid_at,
        sessions_by_state, session_children, messages_of_conversation, open_records, calls_by_origin, latest_call_per_message,
    ]
}


def _num(field: str, out: str = "j") -> str:
    return f"CASE WHEN json_type({out}, '$.{field}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract_string({out}, '$.{field}') AS DOUBLE) END"


_F = list(I.USAGE_FIELDS)
JSONED = (
    "doc AS (SELECT *, CASE WHEN json_valid(usage_json) THEN CAST(usage_json AS JSON) END AS j FROM usage_json),\n"
    + "num AS (SELECT *, "
    + ", ".join(f"{_num(f)} AS n_{f}" for f in _F)
    + " FROM doc),\nlng AS (SELECT *, coalesce("
    + ", ".join(f"nullif(n_{f}, 0)" for f in _F)
    + ") IS NOT NULL AS nonzero, "
    + ", ".join(f"CASE WHEN n_{f} >= 0 AND n_{f} = floor(n_{f}) THEN CAST(n_{f} AS BIGINT) END AS t_{f}" for f in _F)
    + " FROM num),\nuse AS (SELECT *, coalesce(nonzero AND coalesce("
    + ", ".join(f"t_{f}" for f in _F)
    + ") IS NOT NULL, false) AS has_usage FROM lng)"
)
REPLACED = """news AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) AS n FROM session_changes)"""

ORACLES = {
    "typed_scan": with_ctes(
        ["model_calls"],
        "SELECT call_id, owns_turn, NULL::VARCHAR AS message_id, requested_at, provider_account_id, NULL::BIGINT AS metered_cost_micros FROM model_calls",
    ),
    "stored_scan": with_ctes(
        ["model_calls"],
        "SELECT format, call_id, owns_turn, NULL::VARCHAR AS message_id, requested_at, NULL::BIGINT AS metered_cost_micros FROM model_calls, (VALUES ('parquet'), ('json')) AS f(format)",
    ),
    "upsert": with_ctes(
        ["sessions", "session_changes"],
        """SELECT coalesce(c.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE c.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.kind ELSE c.kind END AS kind,
        CASE WHEN n.id IS NOT NULL THEN n.state ELSE c.state END AS state, CASE WHEN n.id IS NOT NULL THEN n.updated_at ELSE c.updated_at END AS updated_at
        FROM sessions c FULL JOIN (SELECT * FROM news WHERE n = 1) n ON n.id = c.id""",
        extra=REPLACED,
    ),
    "patch_update": with_ctes(
        ["sessions", "session_changes"],
        """SELECT coalesce(c.id, n.id) AS id, coalesce(n.title, c.title) AS title, coalesce(n.kind, c.kind) AS kind, coalesce(n.state, c.state) AS state, coalesce(n.updated_at, c.updated_at) AS updated_at
        FROM sessions c FULL JOIN (SELECT id, arg_max(title, (updated_at, seq)) FILTER (WHERE title IS NOT NULL) AS title, arg_max(kind, (updated_at, seq)) AS kind,
          arg_max(state, (updated_at, seq)) FILTER (WHERE state IS NOT NULL) AS state, max(updated_at) AS updated_at FROM session_changes GROUP BY id) n ON n.id = c.id""",
    ),
    "insert_missing": with_ctes(
        ["account_rows", "account_inserts"],
        """SELECT * FROM account_rows UNION ALL SELECT id, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS n FROM account_inserts)
        WHERE n = 1 AND id NOT IN (SELECT id FROM account_rows)""",
    ),
    "append_immutable": with_ctes(
        ["model_pricing", "price_inserts"],
        """SELECT pricing_snapshot_id, provider, model, input_per_million_micros FROM model_pricing UNION ALL SELECT pricing_snapshot_id, provider, model, input_per_million_micros
        FROM (SELECT *, row_number() OVER (PARTITION BY pricing_snapshot_id ORDER BY seq) AS n FROM price_inserts WHERE input_per_million_micros >= 0) WHERE n = 1
        AND pricing_snapshot_id NOT IN (SELECT pricing_snapshot_id FROM model_pricing)""",
    ),
    "append_rejects": with_ctes(
        ["model_pricing", "price_inserts"],
        """SELECT pricing_snapshot_id, seq, CASE WHEN stored OR seq > first_ok THEN 'already_exists' ELSE 'invalid_rate' END AS reject_code FROM (SELECT *,
        min(CASE WHEN input_per_million_micros >= 0 THEN seq END) OVER (PARTITION BY pricing_snapshot_id) AS first_ok, pricing_snapshot_id IN (SELECT pricing_snapshot_id FROM model_pricing) AS stored
        FROM price_inserts) WHERE stored OR first_ok IS NULL OR seq <> first_ok""",
    ),
    "plan_rejects": with_ctes(
        ["plan_inserts"],
        """SELECT subscription_plan_id, CASE WHEN price_micros < 0 THEN 'invalid_price' ELSE 'invalid_period' END AS reject_code FROM plan_inserts WHERE price_micros < 0 OR period_end <= period_start""",
    ),
    "first_terminal": with_ctes(
        ["token_events"],
        """SELECT attempt_id, at_ms, seq, event FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY at_ms, seq) AS n FROM token_events WHERE event IN ('completed', 'failed')) WHERE n = 1""",
    ),
    "soft_delete": with_ctes(
        ["agents", "doomed_agents"],
        "SELECT agent_id, name, kind, CASE WHEN agent_id IN (SELECT agent_id FROM doomed_agents) THEN coalesce(deleted_at, 77000) ELSE deleted_at END AS deleted_at FROM agents",
    ),
    "integrity_report": with_ctes(
        ["model_calls", "attempts", "agent_runs", "agents"],
        """SELECT 'attempt_call_missing' AS rule, attempt_id AS id FROM attempts WHERE call_id NOT IN (SELECT call_id FROM model_calls)
        UNION ALL SELECT 'call_run_missing', call_id FROM model_calls WHERE agent_run_id NOT IN (SELECT agent_run_id FROM agent_runs)
        UNION ALL SELECT 'fallback_call_missing', call_id FROM model_calls WHERE fallback_from_call_id IS NOT NULL AND fallback_from_call_id NOT IN (SELECT call_id FROM model_calls)
        UNION ALL SELECT 'parent_run_missing', agent_run_id FROM agent_runs WHERE parent_agent_run_id IS NOT NULL AND parent_agent_run_id NOT IN (SELECT agent_run_id FROM agent_runs)
        UNION ALL SELECT 'run_agent_missing_or_deleted', agent_run_id FROM agent_runs WHERE agent_id NOT IN (SELECT agent_id FROM agents WHERE deleted_at IS NULL)
        UNION ALL SELECT 'call_context_mismatch', c.call_id FROM model_calls c JOIN agent_runs r USING (agent_run_id) WHERE c.session_id <> r.session_id OR c.turn_id IS DISTINCT FROM r.turn_id OR c.agent_id <> r.agent_id
        UNION ALL SELECT 'parent_run_context_mismatch', r.agent_run_id FROM agent_runs r JOIN agent_runs p ON p.agent_run_id = r.parent_agent_run_id WHERE p.session_id <> r.session_id OR p.turn_id IS DISTINCT FROM r.turn_id
        UNION ALL SELECT 'attempt_after_call_finalized', a.attempt_id FROM attempts a JOIN model_calls c USING (call_id) WHERE a.started_at > c.completed_at""",
    ),
    "upgrade": with_ctes(
        ["sessions"],
        """SELECT id, title, 'chat' AS kind, 'active' AS state, NULL::VARCHAR AS owner_agent_id, NULL::VARCHAR AS parent_session_id, created_at, updated_at, NULL::BIGINT AS archived_at FROM sessions""",
    ),
    "normalize_usage": with_ctes(
        ["usage_json"],
        "SELECT call_id, line, has_usage, CASE WHEN has_usage THEN 'provider_reported' END AS usage_source, CASE WHEN has_usage THEN '{' || concat_ws(',', "
        + ", ".join(f"CASE WHEN t_{f} IS NOT NULL THEN '\"{k}\":\"provider_reported\"' END" for f, (_, k) in I.USAGE_FIELDS.items())
        + ") || '}' END AS provenance_json, "
        + ", ".join(f"CASE WHEN has_usage THEN t_{f} END AS {c}" for f, (c, _) in I.USAGE_FIELDS.items())
        + " FROM use",
        extra=JSONED,
    ),
    "generation_usage": with_ctes(
        ["usage_json"],
        """SELECT *, coalesce(input_tokens, output_tokens, cached_tokens, cache_write_tokens, reasoning_tokens, total_tokens, cost_input, cost_total) IS NOT NULL OR request_id IS NOT NULL OR finish_reason IS NOT NULL AS has_generation_usage
        FROM (SELECT call_id, line, CASE WHEN has_usage THEN n_input END AS input_tokens, CASE WHEN has_usage THEN n_output END AS output_tokens, CASE WHEN has_usage THEN n_cacheRead END AS cached_tokens,
        CASE WHEN has_usage THEN n_cacheWrite END AS cache_write_tokens, CASE WHEN has_usage THEN n_reasoning END AS reasoning_tokens, CASE WHEN has_usage THEN n_totalTokens END AS total_tokens,
        CASE WHEN has_usage THEN CAST(json_extract_string(j, '$.cost.input') AS DOUBLE) END AS cost_input, CASE WHEN has_usage THEN CAST(json_extract_string(j, '$.cost.total') AS DOUBLE) END AS cost_total,
        response_id AS request_id, CASE WHEN has_usage AND stop_reason = 'pending' THEN NULL WHEN stop_reason IS NOT NULL THEN coalesce(raw_stop_reason, stop_reason) END AS finish_reason FROM use)""",
        extra=JSONED,
    ),
    "import_price_sheet": with_ctes(
        ["price_sheet"],
        "SELECT p_partkey, reject_code, "
        + ", ".join(f"CASE WHEN reject_code IS NULL THEN CAST(floor({c}_usd * 1e6 + 0.5) AS BIGINT) END AS {c}_per_million_micros" for c in ("input", "output", "cache_read", "cache_write"))
        + """ FROM (SELECT *, CASE WHEN input_usd IS NULL OR output_usd IS NULL OR (trim(coalesce(cache_read_text, '')) <> '' AND cache_read_usd IS NULL)
          OR (trim(coalesce(cache_write_text, '')) <> '' AND cache_write_usd IS NULL) THEN 'invalid_price' END AS reject_code FROM (SELECT *, """
        + ", ".join(
            f"coalesce(TRY_CAST(nullif(regexp_extract(replace(lower(trim({c}_text)), ',', ''), '^\\$?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:c|¢|cents?)$', 1), '') AS DOUBLE) / 100, "
            f"TRY_CAST(nullif(regexp_extract(replace(lower(trim({c}_text)), ',', ''), '^\\$?\\s*(\\d+(?:\\.\\d+)?|\\.\\d+)\\s*(?:usd)?$', 1), '') AS DOUBLE)) AS {c}_usd"
            for c in ("input", "output", "cache_read", "cache_write")
        )
        + " FROM price_sheet))",
    ),
    "vector_codec": "SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes, 0.0::DOUBLE AS loss FROM embeddings",
    "open_records": with_ctes(
        [*OPEN],
        " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS id, status FROM {k} WHERE status IN ({str(statuses)[1:-1]})" for k, (key, statuses) in OPEN.items()),
    ),
    "calls_by_origin": with_ctes(
        ["model_calls", "turns", "agent_runs"],
        """SELECT 'turn_id' AS origin, turn_id AS key, call_id, requested_at FROM model_calls WHERE turn_id IN (SELECT turn_id FROM turns WHERE status = 'streaming')
        UNION ALL SELECT 'agent_run_id', agent_run_id, call_id, requested_at FROM model_calls WHERE agent_run_id IN (SELECT agent_run_id FROM agent_runs WHERE status = 'running')
        UNION ALL SELECT 'fallback_from_call_id', fallback_from_call_id, call_id, requested_at FROM model_calls WHERE fallback_from_call_id IN (SELECT call_id FROM model_calls WHERE status = 'failed')""",
    ),
    "latest_call_per_message": with_ctes(
        ["model_calls"],
        """SELECT origin, key, call_id, requested_at FROM (SELECT *, row_number() OVER (PARTITION BY origin, key ORDER BY requested_at DESC, call_id DESC) AS nth FROM
        (SELECT 'message_id' AS origin, message AS key, call_id, requested_at FROM keyed UNION ALL SELECT 'generation_id', message||'-g'||(no % 2), call_id, requested_at FROM keyed) WHERE key IS NOT NULL) WHERE nth = 1""",
        extra="""keyed AS (SELECT *, CASE WHEN no % 11 > 0 THEN session_id||'-m'||(no % 3) END AS message FROM (SELECT *, CAST(substr(call_id, 2) AS BIGINT) AS no FROM model_calls))""",
    ),
    "get_by_id": with_ctes(
        ["model_calls", "cost_allocations"],
        "SELECT call_id, session_id, status, requested_at FROM model_calls WHERE call_id IN (SELECT call_id FROM cost_allocations)",
    ),
    "runs_by_turn": with_ctes(
        ["model_calls", "agent_runs"],
        "SELECT turn_id, agent_run_id, started_at FROM agent_runs WHERE turn_id IN (SELECT turn_id FROM model_calls WHERE turn_id IS NOT NULL)",
    ),
    "calls_by_status": with_ctes(
        ["model_calls"], "SELECT call_id, status, requested_at FROM model_calls WHERE status IN ('queued', 'running', 'streaming')"
    ),
    "calls_by_session": with_ctes(
        ["model_calls"],
        "SELECT session_id, count(*) AS calls, min(requested_at) AS first_at, max(requested_at) AS last_at, arg_min(call_id, (requested_at, call_id)) AS first_call FROM model_calls GROUP BY session_id",
    ),
    "calls_of_agent": with_ctes(["model_calls"], "SELECT call_id, requested_at FROM model_calls WHERE agent_id = 'agent3'"),
    "latest_call_per_turn": with_ctes(
        ["model_calls"],
        """SELECT turn_id, call_id, requested_at FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY requested_at DESC, call_id DESC) AS n FROM model_calls WHERE turn_id IS NOT NULL) WHERE n = 1""",
    ),
    "attempts_by_call": with_ctes(
        ["model_calls", "attempts"],
        "SELECT call_id, attempt_number, attempt_id, status FROM attempts WHERE call_id IN (SELECT call_id FROM model_calls WHERE status = 'failed')",
    ),
    "allocations_by_call": with_ctes(
        ["model_calls", "cost_allocations"],
        "SELECT call_id, created_at, allocation_id, amount_micros FROM cost_allocations WHERE call_id IN (SELECT call_id FROM model_calls WHERE status = 'completed')",
    ),
    "prices_valid_at": with_ctes(
        ["model_pricing"],
        "SELECT pricing_snapshot_id, input_per_million_micros FROM model_pricing WHERE effective_from <= 930000000000 AND (effective_to IS NULL OR effective_to > 930000000000)",
    ),
    "sessions_by_state": with_ctes(["sessions"], "SELECT id, updated_at, archived_at FROM sessions WHERE state = 'archived'"),
    "session_children": with_ctes(
        ["sessions"], "SELECT parent_session_id, id FROM sessions WHERE parent_session_id IN (SELECT id FROM sessions WHERE state = 'archived')"
    ),
    "messages_of_conversation": with_ctes(
        ["messages", "generations"],
        "SELECT conversation_id, created_at, id, role FROM messages WHERE conversation_id IN (SELECT conversation_id FROM generations WHERE status = 'completed')",
    ),
}
