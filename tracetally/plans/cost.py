"""Queries over usage, prices, costs and call timing, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost as C
from ..operators import pricing as P
from ..operators import usage as U
from .derived import table, with_ctes

PRICE_AT = 930_000_000_000


def attempts(s, d):
    return table(s, d, "attempts")


def costed(s: SparkSession, d: str) -> DataFrame:
    return C.attempt_cost(attempts(s, d), table(s, d, "model_pricing"))


def finalized(s: SparkSession, d: str) -> DataFrame:
    return C.finalize_calls(table(s, d, "model_calls"), costed(s, d))


def select_usage(s, d):
    out = U.select_usage(attempts(s, d))
    return out.select("attempt_id", *[f"sel_{x}" for x in U.PRICED], "cost_provenance")


def priced_attempts(s, d):
    out = P.resolve_price(attempts(s, d), table(s, d, "model_pricing"))
    return out.select("attempt_id", "started_at", F.col("price.pricing_snapshot_id").alias("pricing_snapshot_id"))


def attempt_cost(s, d):
    return costed(s, d).select(
        "attempt_id", "pricing_snapshot_id", "api_equivalent_cost_micros", "api_equivalent_currency",
        "api_equivalent_cost_source", "cost_reject", "latency_ms",
    )


def call_usage(s, d):
    return U.call_usage(attempts(s, d)).select(
        "call_id", "attempt_count", "usage_source", "reported_uncached_input_tokens", "estimated_uncached_input_tokens",
        "reported_cache_read_tokens", "reported_cache_write_tokens", "reported_output_tokens", "reported_reasoning_tokens",
    )


def call_cost(s, d):
    return finalized(s, d).select(
        "call_id", "api_equivalent_cost_micros", "api_equivalent_currency", "api_equivalent_cost_source",
        "metered_cost_micros", "metered_currency", "metered_cost_source", "pricing_snapshot_id",
    )


def call_timing(s, d):
    return finalized(s, d).select(
        "call_id", "provider_request_id", "first_token_at", "last_token_at", "ttft_ms", "generation_duration_ms",
        "total_latency_ms", "output_tokens_per_second_milli", "context_utilization_bps", "cancelled_at",
    )


def session_summary(s, d):
    return C.session_summary(finalized(s, d))


def turn_detail(s, d):
    return C.turn_detail(finalized(s, d), table(s, d, "agent_runs"), table(s, d, "accounts"))


def allocated_cost(s, d):
    return C.allocated(table(s, d, "model_calls"), table(s, d, "cost_allocations"))


def price_list(s, d):
    models = table(s, d, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("top"), F.min("p_size").alias("size"))
    models = models.select(
        F.concat(F.lit("p"), (F.length("p_type") % 4).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("size") % 3).cast("string")).alias("model"),
        F.when(F.col("p_type") != "PROMO", F.col("top") / 1000).alias("input_usd"),
        F.when(F.col("p_type") != "PROMO", F.lit(2.5)).alias("output_usd"),
        F.when(F.col("p_type") != "PROMO", F.lit(0.0)).alias("cache_read_usd"),
        F.lit(None).cast("double").alias("cache_write_usd"),
        F.col("p_type").alias("name"),
    )
    out = P.price_list(models, table(s, d, "model_pricing"), PRICE_AT)
    return out


QUERIES = {
    "select_usage": select_usage,
    "priced_attempts": priced_attempts,
    "attempt_cost": attempt_cost,
    "call_usage": call_usage,
    "call_cost": call_cost,
    "call_timing": call_timing,
    "session_summary": session_summary,
    "turn_detail": turn_detail,
    "allocated_cost": allocated_cost,
    "price_list": price_list,
}

# ---- reference SQL -------------------------------------------------------

SELECTED = """sel AS (SELECT *, coalesce(reported_uncached_input_tokens, estimated_uncached_input_tokens) AS sel_input,
  reported_cache_read_tokens AS sel_cache_read, reported_cache_write_tokens AS sel_cache_write, reported_output_tokens AS sel_output,
  reported_reasoning_tokens AS sel_reasoning,
  CASE WHEN reported_uncached_input_tokens IS NULL AND estimated_uncached_input_tokens IS NOT NULL THEN 'mixed'
       WHEN usage_source IN ('provider_reported', 'unknown') THEN 'provider_reported' ELSE 'mixed' END AS cost_provenance FROM attempts)"""

PRICED = """priced AS (SELECT * FROM (SELECT a.attempt_id, p.* EXCLUDE (provider, model, provider_account_id),
   row_number() OVER (PARTITION BY a.attempt_id ORDER BY p.provider_account_id IS NULL, p.effective_from DESC, p.created_at DESC, p.pricing_snapshot_id DESC) AS rn
  FROM attempts a JOIN model_pricing p ON a.provider = p.provider AND a.model = p.model AND (p.provider_account_id IS NULL OR p.provider_account_id = a.provider_account_id)
   AND p.effective_from <= a.started_at AND (p.effective_to IS NULL OR p.effective_to > a.started_at)) WHERE rn = 1)"""

COSTED = (
    SELECTED
    + ",\n"
    + PRICED
    + """,
dims AS (SELECT s.*, p.pricing_snapshot_id AS pid, p.currency AS pcur, p.input_per_million_micros AS r1, p.cache_read_per_million_micros AS r2, p.cache_write_per_million_micros AS r3,
   p.output_per_million_micros AS r4, p.reasoning_per_million_micros AS r5,
   CASE WHEN p.reasoning_per_million_micros IS NULL THEN sel_output ELSE greatest(0, sel_output - sel_reasoning) END AS t4,
   CASE WHEN p.reasoning_per_million_micros IS NOT NULL THEN sel_reasoning END AS t5
  FROM sel s LEFT JOIN priced p USING (attempt_id)),
conf AS (SELECT *, CASE WHEN has_usage AND pid IS NOT NULL AND (r5 IS NULL OR (sel_output IS NOT NULL AND sel_reasoning IS NOT NULL))
   AND (CASE WHEN sel_input IS NULL THEN r1 IS NULL ELSE sel_input = 0 OR r1 IS NOT NULL END)
   AND (CASE WHEN sel_cache_read IS NULL THEN r2 IS NULL ELSE sel_cache_read = 0 OR r2 IS NOT NULL END)
   AND (CASE WHEN sel_cache_write IS NULL THEN r3 IS NULL ELSE sel_cache_write = 0 OR r3 IS NOT NULL END)
   AND (CASE WHEN t4 IS NULL THEN r4 IS NULL ELSE t4 = 0 OR r4 IS NOT NULL END)
   AND (CASE WHEN t5 IS NULL THEN r5 IS NULL ELSE t5 = 0 OR r5 IS NOT NULL END)
  THEN CAST((coalesce(CAST(sel_input AS HUGEINT) * r1, 0) + coalesce(CAST(sel_cache_read AS HUGEINT) * r2, 0) + coalesce(CAST(sel_cache_write AS HUGEINT) * r3, 0)
   + coalesce(CAST(t4 AS HUGEINT) * r4, 0) + coalesce(CAST(t5 AS HUGEINT) * r5, 0) + 500000) // 1000000 AS BIGINT) END AS configured FROM dims),
costed AS (SELECT *, coalesce(configured, CASE WHEN has_usage THEN CAST(floor(registry_cost_usd * 1000000 + 0.5) AS BIGINT) END) AS api_micros,
   CASE WHEN configured IS NOT NULL THEN pcur WHEN has_usage AND registry_cost_usd IS NOT NULL THEN 'USD' END AS api_cur,
   CASE WHEN configured IS NOT NULL THEN 'configured_pricing:' || cost_provenance WHEN has_usage AND registry_cost_usd IS NOT NULL THEN 'external_fallback' END AS api_src,
   CASE WHEN configured IS NOT NULL THEN pid END AS snap FROM conf)"""
)


def _poison(c: str) -> str:
    return f"CASE WHEN count(CASE WHEN has_usage THEN {c} END) = count(*) THEN CAST(sum({c}) AS BIGINT) END AS {c}"


TOKENS = [
    "reported_uncached_input_tokens", "estimated_uncached_input_tokens", "reported_cache_read_tokens",
    "reported_cache_write_tokens", "reported_output_tokens", "reported_reasoning_tokens",
]

CALLS = (
    COSTED
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY (status = 'completed') DESC, attempt_number DESC) AS pick,
   row_number() OVER (PARTITION BY call_id ORDER BY attempt_number DESC) AS lastpick FROM costed),
agg AS (SELECT call_id, bool_or(has_usage) AS any_usage, """
    + ", ".join(_poison(c) for c in TOKENS)
    + """,
   CASE WHEN bool_and(has_usage) AND count(DISTINCT usage_source) = 1 THEN min(usage_source) ELSE 'mixed' END AS usage_source, count(*) AS attempt_count,
   CASE WHEN count(api_micros) = count(*) AND count(api_cur) = count(*) AND count(DISTINCT api_cur) = 1 THEN CAST(sum(api_micros) AS BIGINT) END AS api,
   CASE WHEN count(metered_cost_micros) = count(*) AND count(metered_currency) = count(*) AND count(DISTINCT metered_currency) = 1 THEN CAST(sum(metered_cost_micros) AS BIGINT) END AS met,
   min(api_cur) AS api_any, min(metered_currency) AS met_any, CASE WHEN count(DISTINCT snap) = 1 THEN min(snap) END AS pricing_snapshot_id,
   max(CASE WHEN pick = 1 THEN first_token_at END) AS first_token_at, max(CASE WHEN pick = 1 THEN last_token_at END) AS last_token_at,
   max(CASE WHEN pick = 1 THEN completed_at END) AS att_completed, max(CASE WHEN pick = 1 AND has_usage THEN reported_output_tokens END) AS timed_output,
   coalesce(max(CASE WHEN pick = 1 AND status = 'completed' THEN provider_request_id END), max(CASE WHEN lastpick = 1 THEN provider_request_id END)) AS provider_request_id
  FROM ranked GROUP BY call_id),
fin AS (SELECT c.*, coalesce(g.any_usage, false) AS any_usage, g.* EXCLUDE (call_id, any_usage), CASE WHEN api IS NOT NULL THEN api_any END AS api_currency, CASE WHEN met IS NOT NULL THEN met_any END AS met_currency,
   CASE WHEN first_token_at - requested_at < 0 THEN 0 ELSE first_token_at - requested_at END AS ttft,
   CASE WHEN first_token_at IS NOT NULL AND coalesce(last_token_at, att_completed, c.completed_at) IS NOT NULL THEN greatest(0, coalesce(last_token_at, att_completed, c.completed_at) - first_token_at) END AS gen_ms
  FROM model_calls c LEFT JOIN agg g USING (call_id))"""
)
NEED = ["model_calls", "attempts", "model_pricing"]
IN_T = "CASE WHEN any_usage THEN coalesce(reported_uncached_input_tokens, estimated_uncached_input_tokens) END"
CR_T = "CASE WHEN any_usage THEN reported_cache_read_tokens END"
OUT_T = "CASE WHEN any_usage THEN reported_output_tokens END"
SPEED = "CASE WHEN gen_ms > 0 THEN CAST(floor(timed_output * 1e6 / gen_ms + 0.5) AS BIGINT) END"

ORACLES = {
    "select_usage": with_ctes(
        ["attempts"],
        "SELECT attempt_id, sel_input, sel_cache_read, sel_cache_write, sel_output, sel_reasoning, cost_provenance FROM sel",
        extra=SELECTED,
    ),
    "priced_attempts": with_ctes(
        ["attempts", "model_pricing"],
        "SELECT a.attempt_id, a.started_at, p.pricing_snapshot_id FROM attempts a LEFT JOIN priced p USING (attempt_id)",
        extra=PRICED,
    ),
    "attempt_cost": with_ctes(
        ["attempts", "model_pricing"],
        """SELECT attempt_id, snap AS pricing_snapshot_id, api_micros AS api_equivalent_cost_micros, api_cur AS api_equivalent_currency,
        api_src AS api_equivalent_cost_source, CAST(NULL AS VARCHAR) AS cost_reject, completed_at - started_at AS latency_ms FROM costed""",
        extra=COSTED,
    ),
    "call_usage": with_ctes(
        NEED, f"SELECT call_id, attempt_count, usage_source, {', '.join(TOKENS)} FROM agg WHERE any_usage", extra=CALLS
    ),
    "call_cost": with_ctes(
        NEED,
        """SELECT call_id, api AS api_equivalent_cost_micros, api_currency AS api_equivalent_currency, CASE WHEN api IS NOT NULL THEN 'attempt_aggregate' END AS api_equivalent_cost_source,
        met AS metered_cost_micros, met_currency AS metered_currency, CASE WHEN met IS NOT NULL THEN 'attempt_aggregate' END AS metered_cost_source, pricing_snapshot_id FROM fin""",
        extra=CALLS,
    ),
    "call_timing": with_ctes(
        NEED,
        f"""SELECT call_id, provider_request_id, first_token_at, last_token_at, ttft AS ttft_ms, gen_ms AS generation_duration_ms,
        CASE WHEN completed_at - requested_at < 0 THEN 0 ELSE completed_at - requested_at END AS total_latency_ms, {SPEED} AS output_tokens_per_second_milli,
        CASE WHEN model_context_limit <> 0 THEN CAST(floor(context_tokens * 10000.0 / model_context_limit + 0.5) AS BIGINT) END AS context_utilization_bps,
        CASE WHEN status = 'cancelled' THEN completed_at END AS cancelled_at FROM fin""",
        extra=CALLS,
    ),
    "session_summary": with_ctes(
        NEED,
        f"""SELECT * FROM (SELECT session_id, CAST(sum({IN_T}) AS BIGINT) AS input_tokens, CAST(sum({CR_T}) AS BIGINT) AS cache_read_tokens, CAST(sum({OUT_T}) AS BIGINT) AS output_tokens,
        CASE WHEN count(DISTINCT api_currency) = 1 THEN CAST(sum(api) AS BIGINT) END AS cost_micros, CASE WHEN count(DISTINCT api_currency) = 1 THEN min(api_currency) END AS currency,
        count(DISTINCT api_currency) > 1 OR count(api) < count(*) AS has_unknown_cost,
        arg_max(least(999.0, floor((coalesce({IN_T}, 0) + coalesce({CR_T}, 0) + coalesce({OUT_T}, 0)) * 1000.0 / model_context_limit + 0.5) / 10), (requested_at, call_id))
          FILTER (WHERE any_usage AND model_context_limit > 0) AS context_percent
        FROM fin GROUP BY session_id) WHERE input_tokens IS NOT NULL OR cache_read_tokens IS NOT NULL OR output_tokens IS NOT NULL OR currency IS NOT NULL""",
        extra=CALLS,
    ),
    "turn_detail": with_ctes(
        [*NEED, "agent_runs", "accounts"],
        f"""SELECT l.session_id, l.turn_id, f.call_id, coalesce(r.agent_name_snapshot, 'agent') AS agent_name, f.provider, f.model, coalesce(x.display_label, f.provider) AS account_label,
        coalesce(x.billing_mode, 'unknown') AS billing_mode, f.api AS api_equivalent_micros, f.api_currency AS api_equivalent_currency, f.met AS metered_micros, f.met_currency AS metered_currency,
        {IN_T} AS uncached_input_tokens, {CR_T} AS cache_read_tokens, CASE WHEN any_usage THEN reported_cache_write_tokens END AS cache_write_tokens, {OUT_T} AS output_tokens,
        CASE WHEN any_usage THEN reported_reasoning_tokens END AS reasoning_tokens, f.ttft AS ttft_ms, CASE WHEN f.completed_at - f.requested_at < 0 THEN 0 ELSE f.completed_at - f.requested_at END AS latency_ms, {SPEED} AS output_tokens_per_second_milli
        FROM (SELECT session_id, turn_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY requested_at DESC, call_id DESC) AS n FROM fin) WHERE n = 1) l
        LEFT JOIN (SELECT turn_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY requested_at DESC, call_id DESC) AS n FROM fin WHERE owns_turn AND turn_id IS NOT NULL) WHERE n = 1) o
          ON o.turn_id = l.turn_id
        JOIN fin f ON f.call_id = coalesce(o.call_id, l.call_id)
        LEFT JOIN agent_runs r ON r.agent_run_id = f.agent_run_id LEFT JOIN accounts x ON x.provider_account_id = f.provider_account_id""",
        extra=CALLS,
    ),
    "allocated_cost": with_ctes(
        ["model_calls", "cost_allocations"],
        """SELECT c.call_id, CASE WHEN count(DISTINCT currency) = 1 THEN CAST(sum(amount_micros) AS BIGINT) END AS allocated_micros,
        CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS allocated_currency, count(DISTINCT currency) > 1 AS has_unknown
        FROM model_calls c LEFT JOIN cost_allocations a ON a.call_id = c.call_id GROUP BY c.call_id""",
    ),
    "price_list": with_ctes(
        ["model_pricing"],
        f"""SELECT m.provider, m.model, CASE WHEN p.source = 'user_override' THEN p.input_per_million_micros / 1000000.0 WHEN priced THEN input_usd END AS input_usd,
        CASE WHEN p.source = 'user_override' THEN p.output_per_million_micros / 1000000.0 WHEN priced THEN output_usd END AS output_usd,
        CASE WHEN p.source = 'user_override' THEN nullif(p.cache_read_per_million_micros, 0) / 1000000.0 END AS cache_read_usd,
        CASE WHEN p.source = 'user_override' THEN nullif(p.cache_write_per_million_micros, 0) / 1000000.0 END AS cache_write_usd,
        CASE WHEN p.source = 'user_override' THEN 'user' WHEN priced THEN 'catalog' ELSE 'none' END AS source
        FROM (SELECT 'p' || (length(p_type) % 4) AS provider, 'm' || (min(p_size) % 3) AS model, CASE WHEN p_type <> 'PROMO' THEN max(p_retailprice) / 1000 END AS input_usd,
          CASE WHEN p_type <> 'PROMO' THEN 2.5::DOUBLE END AS output_usd, p_type <> 'PROMO' AS priced FROM part GROUP BY p_type) m
        LEFT JOIN LATERAL (SELECT * FROM model_pricing p WHERE p.provider = m.provider AND p.model = m.model AND p.provider_account_id IS NULL AND p.effective_from <= {PRICE_AT}
          AND (p.effective_to IS NULL OR p.effective_to > {PRICE_AT}) ORDER BY p.effective_from DESC, p.created_at DESC, p.pricing_snapshot_id DESC LIMIT 1) p ON true""",
    ),
}
