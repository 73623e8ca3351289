"""Telemetry, retrieval, session and device tables derived from the given star-schema tables.

Each definition is one portable SELECT. Spark runs it over the parquet files;
the reference SQL of a query puts the same text into a WITH clause. ``@MS(x)``
is epoch milliseconds (truncated) and ``@RANGE(n)`` emits 0..n-1 per row; nothing
else differs between the dialects.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DEFS: dict[str, str] = {
    "sessions": """
SELECT 's'||c_custkey AS id, c_name AS title,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'tool' ELSE 'chat' END AS kind,
  CASE WHEN c_custkey = 0 OR c_custkey % 5 = 0 THEN NULL ELSE 's'||CAST(floor(c_custkey / 3) AS BIGINT) END AS parent_session_id,
  CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS state,
  CAST(c_custkey * 1000 AS BIGINT) AS created_at, CAST(c_custkey * 1000 + c_custkey % 97 AS BIGINT) AS updated_at,
  CASE WHEN c_acctbal < 0 THEN CAST(c_custkey * 1000 + 5 AS BIGINT) END AS archived_at FROM customer""",
    "model_calls": """
SELECT 'c'||o_orderkey AS call_id, 's'||o_custkey AS session_id, 'g'||o_orderkey AS generation_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 's'||o_custkey||'-t'||(o_orderkey % 4) END AS turn_id,
  's'||o_custkey||'-r'||(o_orderkey % 8) AS agent_run_id, 'agent'||(o_orderkey % 8) AS agent_id, o_orderkey % 2 = 0 AS owns_turn, o_orderkey % 3 = 0 AS owns_agent_run,
  'p'||(o_orderkey % 4) AS provider, 'm'||(o_orderkey % 3) AS model,
  'p'||(o_orderkey % 4)||'-a'||(o_custkey % 2) AS provider_account_id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'c'||(o_orderkey - 1) WHEN o_orderkey % 17 = 1 AND o_orderkey > 1 THEN 'c'||(o_orderkey - 1) END AS fallback_from_call_id,
  @MS(o_orderdate) + o_orderkey % 86400000 AS requested_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'streaming' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE @MS(o_orderdate) + o_orderkey % 86400000 + 4000 + CAST(floor(o_totalprice / 100) AS BIGINT) END AS completed_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(4000 + (o_orderkey % 7) * 1000 AS BIGINT) END AS model_context_limit,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 50) AS BIGINT) END AS context_tokens FROM orders""",
    "attempts": """
SELECT call_id||'-'||attempt_number AS attempt_id, x.* FROM (
  SELECT 'c'||l_orderkey AS call_id,
   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS attempt_number,
   'p'||(l_orderkey % 4) AS provider, 'm'||(l_orderkey % 3) AS model, 'p'||(l_orderkey % 4)||'-a'||(l_suppkey % 2) AS provider_account_id,
   @MS(l_shipdate) AS started_at,
   CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE @MS(l_shipdate) + 100 + l_partkey % 400 END AS first_token_at,
   CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE @MS(l_shipdate) + 600 + l_partkey % 4000 END AS last_token_at,
   CASE WHEN l_linestatus = 'O' AND l_partkey % 10 = 0 THEN NULL ELSE @MS(l_shipdate) + 5000 END AS completed_at,
   CASE WHEN l_linestatus = 'O' AND l_partkey % 10 = 0 THEN 'streaming' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status,
   CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'req'||l_partkey END AS provider_request_id,
   l_returnflag <> 'R' OR l_tax < 0.03 AS has_usage,
   CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 10 END AS reported_uncached_input_tokens,
   CASE WHEN l_partkey % 19 = 0 THEN CAST(l_quantity AS BIGINT) * 11 END AS estimated_uncached_input_tokens,
   CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_suppkey END AS reported_cache_read_tokens,
   CAST(0 AS BIGINT) AS reported_cache_write_tokens,
   CAST(floor(l_extendedprice / 100) AS BIGINT) AS reported_output_tokens,
   CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 500) AS BIGINT) END AS reported_reasoning_tokens,
   CASE WHEN l_partkey % 19 = 0 THEN 'mixed' ELSE 'provider_reported' END AS usage_source,
   CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) END AS metered_cost_micros,
   CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_suppkey % 10 = 0 THEN 'EUR' ELSE 'USD' END END AS metered_currency,
   CASE WHEN l_discount > 0.06 THEN l_extendedprice / 1000000 END AS registry_cost_usd
  FROM lineitem) x""",
    "model_pricing": """
SELECT 'price'||n_nationkey AS pricing_snapshot_id, 'p'||(n_nationkey % 4) AS provider, 'm'||(n_nationkey % 3) AS model,
  CASE WHEN n_nationkey % 5 = 0 THEN 'p'||(n_nationkey % 4)||'-a0' END AS provider_account_id,
  CAST(1000000 + n_nationkey * 10007 AS BIGINT) AS input_per_million_micros,
  CASE WHEN n_nationkey % 8 = 0 THEN NULL ELSE CAST(500000 + n_nationkey AS BIGINT) END AS cache_read_per_million_micros,
  CAST(2000000 AS BIGINT) AS cache_write_per_million_micros, CAST(4000000 + n_nationkey * 31 AS BIGINT) AS output_per_million_micros,
  CASE WHEN n_nationkey % 6 = 0 THEN CAST(10000000 AS BIGINT) END AS reasoning_per_million_micros, 'USD' AS currency,
  CASE WHEN n_nationkey < 12 THEN CAST(0 AS BIGINT) ELSE CAST(883612800000 AS BIGINT) END AS effective_from,
  CASE WHEN n_nationkey < 4 THEN CAST(915148800000 AS BIGINT) WHEN n_nationkey % 7 = 6 THEN CAST(952000000000 AS BIGINT) END AS effective_to,
  CASE WHEN n_nationkey % 2 = 0 THEN 'user_override' ELSE 'catalog' END AS source, CAST(n_nationkey AS BIGINT) AS created_at FROM nation""",
    "agent_runs": """
SELECT r.session_id||'-r'||k AS agent_run_id, r.session_id, r.session_id||'-t'||(k % 4) AS turn_id, 'agent'||k AS agent_id,
  CASE WHEN k < 4 THEN NULL ELSE r.session_id||'-r'||(k - 4) END AS parent_agent_run_id, 'agent'||k AS agent_name_snapshot, CAST(k AS BIGINT) AS started_at,
  CASE WHEN k % 5 = 4 THEN 'running' ELSE 'completed' END AS status, CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(k + 100 AS BIGINT) END AS completed_at
  FROM (SELECT 's'||c_custkey AS session_id, @RANGE(12) AS k FROM customer) r""",
    "turns": """
SELECT t.session_id||'-t'||k AS turn_id, t.session_id, CAST(k AS BIGINT) AS started_at, CASE WHEN k % 3 = 1 THEN 'streaming' ELSE 'completed' END AS status,
  CASE WHEN k % 3 = 1 THEN NULL ELSE CAST(k + 50 AS BIGINT) END AS completed_at FROM (SELECT 's'||c_custkey AS session_id, @RANGE(4) AS k FROM customer) t""",
    "cost_allocations": """
SELECT 'a'||o_orderkey AS allocation_id, CASE o_orderkey % 3 WHEN 0 THEN 'c'||o_orderkey WHEN 1 THEN 'c'||(o_orderkey - 1) ELSE 'gone'||o_orderkey END AS call_id, CAST(floor(o_totalprice) AS BIGINT) AS amount_micros,
  CASE WHEN o_orderkey % 21 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(o_orderkey AS BIGINT) AS created_at FROM orders""",
    "agents": """
SELECT 'agent'||n_nationkey AS agent_id, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'primary' ELSE 'worker' END AS kind,
  CASE WHEN n_nationkey % 6 = 5 THEN CAST(n_nationkey * 1000 AS BIGINT) END AS deleted_at FROM nation""",
    "accounts": """
SELECT 'p'||(n_nationkey % 4)||'-a'||(n_nationkey % 2) AS provider_account_id, min(n_name) AS display_label,
  CASE WHEN min(n_nationkey) % 3 = 0 THEN 'subscription' WHEN min(n_nationkey) % 3 = 1 THEN 'api' ELSE 'free' END AS billing_mode
  FROM nation WHERE n_nationkey % 4 < 3 GROUP BY 1""",
    "retrieval_items": """
SELECT 'd'||doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'docs.'||lang||'.archive' ELSE 'docs.'||lang END AS namespace,
  CASE WHEN doc_id % 4 = 0 THEN 'note' ELSE 'document' END AS type, source AS source_system, 'record' AS source_type, CAST(doc_id AS VARCHAR(20)) AS source_id,
  text AS content, CAST(doc_id * 1000 AS BIGINT) AS created_at, CAST(doc_id * 1000 + doc_id % 50 AS BIGINT) AS updated_at,
  CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE 'team' END AS scope_kind, CASE WHEN doc_id % 10 = 0 THEN '*' ELSE 't'||(doc_id % 5) END AS scope_key,
  CASE WHEN doc_id % 23 = 0 THEN 'pending' WHEN doc_id % 61 = 1 THEN 'failed' ELSE 'ready' END AS lexical_state,
  CASE WHEN doc_id % 29 = 0 THEN 'stale' WHEN doc_id % 31 = 0 THEN 'failed' ELSE 'ready' END AS vector_state, 'r1' AS revision,
  CAST(doc_id * 1000 + 7 AS BIGINT) AS indexed_at, CASE WHEN doc_id % 13 = 0 THEN 'fp-old' ELSE 'fp-new' END AS fingerprint,
  CASE WHEN doc_id % 31 = 0 THEN 'vector' WHEN doc_id % 61 = 1 THEN 'lexical' END AS failure_stage,
  CASE WHEN doc_id % 31 = 0 THEN 'vector_failed' WHEN doc_id % 61 = 1 THEN 'lexical_failed' END AS failure_code, CAST(1 AS BIGINT) AS projection_version FROM documents""",
    "retrieval_vectors": """
SELECT 'd'||vec_id AS id, CASE WHEN vec_id % 37 = 0 THEN 'r0' ELSE 'r1' END AS revision, CASE WHEN vec_id % 13 = 0 THEN 'fp-old' ELSE 'fp-new' END AS fingerprint,
  embedding AS vector, CAST(label AS BIGINT) AS label FROM embeddings""",
    "messages": """
SELECT 'm'||conv_id||'-'||turn AS id, 'k'||conv_id AS conversation_id, role, CASE WHEN (conv_id + turn) % 15 = 0 THEN '' ELSE text END AS content,
  CASE WHEN role <> 'assistant' THEN 'completed' WHEN (conv_id + turn) % 6 = 0 THEN 'failed' WHEN (conv_id + turn) % 7 = 0 THEN 'interrupted' ELSE 'completed' END AS status,
  CAST(conv_id * 100000 + turn AS BIGINT) AS created_at,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 4 = 0 THEN '{"role":"assistant","stopReason":"stop"}'
       WHEN role = 'assistant' AND (conv_id + turn) % 4 = 1 THEN '{"role":"assistant","stopReason":"error"}'
       WHEN role = 'assistant' AND (conv_id + turn) % 4 = 2 THEN '{"role":' END AS payload_json
  FROM conversations WHERE role <> 'system'""",
    "generations": """
SELECT 'g'||conv_id||'-'||turn AS id, 'k'||conv_id AS conversation_id, 'm'||conv_id||'-'||turn AS message_id,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'streaming' WHEN 2 THEN 'connecting' WHEN 3 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN (conv_id + turn) % 10 = 1 THEN 'socket closed' END AS error, CASE WHEN (conv_id + turn) % 5 >= 3 THEN CAST(conv_id AS BIGINT) END AS completed_at
  FROM conversations WHERE role = 'assistant'""",
    "token_events": """
SELECT 'e'||user_id AS attempt_id, 'e'||user_id AS session_id, @MS(ts) AS at_ms, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'response' WHEN 'click' THEN 'token' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event,
  CASE WHEN event_type = 'view' THEN CAST(200 + user_id % 5 AS BIGINT) END AS http_status,
  CASE WHEN event_type = 'click' THEN props END AS delta, ts FROM events""",
    "device_samples": """
SELECT 'run'||user_id AS run_id, @MS(ts) AS elapsed_realtime_ms, event_id AS seq,
  CAST(4000000 - 1000 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN user_id % 17 = 3 AND event_id % 40 = 1 THEN 2500 ELSE 0 END AS BIGINT) AS charge_counter_uah,
  CAST(16000000000 - 4000000 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - CASE WHEN user_id % 19 = 4 AND event_id % 50 = 3 THEN 99000000 ELSE 0 END AS BIGINT) AS energy_counter_nwh,
  CASE WHEN user_id % 21 = 5 AND event_type = 'error' THEN CAST(1500 AS BIGINT) WHEN user_id % 4 = 1 THEN NULL ELSE CAST(-350000 AS BIGINT) END AS current_now_ua,
  user_id % 9 = 0 AS plugged, CASE WHEN user_id % 9 = 0 THEN 2 ELSE 3 END AS status, value AS battery_temperature_c,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value * 1048576) AS BIGINT) * 16 END AS available_ram_bytes,
  CAST(268435456 AS BIGINT) AS threshold_bytes, value < 1.0 AS low_memory,
  CASE WHEN event_type = 'purchase' AND value > 30 THEN CAST(3 AS BIGINT) WHEN event_type = 'view' AND user_id % 8 = 1 THEN NULL ELSE CAST(1 AS BIGINT) END AS thermal_status,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(20000000 + (event_id * 7919) % 1000003 AS BIGINT) END AS java_heap_bytes, CAST(30000000 + (event_id * 104729) % 1000003 AS BIGINT) AS native_heap_bytes,
  CAST(100000000 + event_id * 1000 AS BIGINT) AS app_pss_bytes FROM events""",
    "benchmark_runs": """
SELECT 'run'||user_id AS run_id, CAST(count(*) AS BIGINT) AS requested, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
  CAST(sum(CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END) AS BIGINT) AS unreported,
  CAST(sum(CASE WHEN event_type <> 'error' THEN 10 + event_id % 50 ELSE 0 END) AS BIGINT) AS total_tokens,
  max(@MS(ts)) - min(@MS(ts)) AS elapsed_ms,
  CASE WHEN user_id % 5 = 0 THEN 'CANCELLED' WHEN user_id % 5 = 1 THEN 'LOW_MEMORY' WHEN user_id % 5 = 2 THEN 'NETWORK_IO' WHEN user_id % 5 = 3 THEN 'private path leaked' END AS error_code
  FROM events GROUP BY user_id""",
    "chunks": """
SELECT 'run'||user_id AS run_id, event_id AS chunk_no, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + event_id % 9 END AS BIGINT) AS completed,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE (1 + event_id % 9) * 24 END AS BIGINT) AS total_tokens, @MS(ts) AS start_ms, @MS(ts) + CAST(floor(value * 10) AS BIGINT) AS end_ms FROM events""",
    "decodes": """
SELECT 'b'||l_orderkey AS batch_id, 'run'||(l_orderkey % 100) AS run_id, l_linenumber AS decode_no, CAST(1 + l_quantity % 8 AS BIGINT) AS sequences,
  CAST((1 + l_quantity % 8) * 16 AS BIGINT) AS tokens, CAST(floor(l_extendedprice) AS DOUBLE) / 64 AS native_decode_ms FROM lineitem""",
    "batch_results": """
SELECT batch_id, min(run_id) AS run_id, CAST(sum(sequences) + CASE WHEN max(tokens) = 128 AND count(*) = 3 THEN 1 ELSE 0 END AS BIGINT) AS item_count, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  CAST(count(*) AS BIGINT) AS native_decode_count, CAST(max(sequences) AS BIGINT) AS effective_batch_size,
  sum(native_decode_ms) + CASE WHEN count(*) = 5 THEN 1.0 ELSE 0.0 END AS native_decode_ms, CAST(5.0 AS DOUBLE) AS preparation_ms,
  sum(native_decode_ms) + CASE WHEN count(*) = 2 THEN 1.0 ELSE 10.0 END AS total_elapsed_ms, CAST(8 AS BIGINT) AS max_sequences, CAST(128 AS BIGINT) AS max_tokens, CAST(100 AS BIGINT) AS n_ctx_seq
  FROM decodes GROUP BY batch_id""",
    "lexical_queries": """
SELECT 'q'||item_id AS query_id, text, 't'||(item_id % 5) AS team, 'hybrid' AS mode FROM benchmark""",
    "chat_queries": """
SELECT 'q'||conv_id||'-'||turn AS query_id, text, 't'||(conv_id % 5) AS team FROM conversations WHERE role = 'user'""",
}

# definitions that read other definitions
NEEDS = {"batch_results": ["decodes"]}


def closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for need in [*NEEDS.get(n, []), n]:
            if need not in out:
                out.append(need)
    return out


def _ms(sql: str, duck: bool) -> str:
    if duck:
        sql = re.sub(r"@RANGE\((\d+)\)", r"unnest(range(\1))", sql)
        return re.sub(r"@MS\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)
    sql = re.sub(r"@RANGE\((\d+)\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", sql)
    return re.sub(r"@MS\((\w+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", sql)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def _refs(name: str) -> tuple[str, ...]:
    words = set(re.findall(r"\b[a-z_]+\b", DEFS[name]))
    return tuple(n for n in [*BASE, *DEFS] if n in words and n != name and re.search(rf"(FROM|JOIN)\s+{n}\b", DEFS[name]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in BASE:
        return base(spark, sf_dir, name)
    refs = _refs(name)
    sql = _ms(DEFS[name], duck=False).replace("{", "{{").replace("}", "}}")
    for r in refs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{r}\b", rf"\1 {{{r}}}", sql)
    sql = sql.replace("VARCHAR(20)", "STRING")
    return spark.sql(sql, **{r: table(spark, sf_dir, r) for r in refs})


def with_ctes(names: list[str], body: str, recursive: bool = False, extra: str = "") -> str:
    """Reference SQL: the derived tables as CTEs in front of ``body``."""
    parts = [f"{n} AS ({_ms(DEFS[n], duck=True)})" for n in closure(names)]
    if extra:
        parts.append(_ms(extra, duck=True))
    if not parts:
        return _ms(body, duck=True)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + _ms(body, duck=True)
