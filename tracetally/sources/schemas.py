"""Fixed schemas of the stored tables. Names are the column names of the records."""

from __future__ import annotations

from pyspark.sql import types as T

from ..operators.usage import TOKEN_COLUMNS

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _schema(strings: str, longs: str = "", booleans: str = "") -> T.StructType:
    fields = [(n, _S) for n in strings.split()] + [(n, _L) for n in longs.split()] + [(n, _B) for n in booleans.split()]
    return T.StructType([T.StructField(n, t) for n, t in fields])


_USAGE = "source provenance_json provider_usage_json context_components_json modality_usage_json"
_COSTS = "metered_currency metered_cost_source api_equivalent_currency api_equivalent_cost_source pricing_snapshot_id"
_COST_AMOUNTS = "metered_cost_micros api_equivalent_cost_micros"

SCHEMAS: dict[str, T.StructType] = {
    "sessions": _schema("id title kind state owner_agent_id parent_session_id", "created_at updated_at archived_at"),
    "messages": _schema(
        "id conversation_id role content status provider model error payload_json", "created_at updated_at"
    ),
    "generations": _schema("id conversation_id message_id status error usage_json", "created_at completed_at"),
    "agents": _schema(
        "agent_id name kind owner_agent_id default_model_policy_id metadata_json", "created_at deleted_at", "persistent"
    ),
    "turns": _schema("turn_id session_id status metadata_json", "started_at completed_at"),
    "agent_runs": _schema(
        "agent_run_id agent_id parent_agent_run_id spawned_by_agent_id spawned_by_run_id session_id turn_id purpose "
        "spawn_reason status agent_name_snapshot agent_kind_snapshot metadata_json",
        "started_at completed_at",
    ),
    "provider_accounts": _schema(
        "provider_account_id provider display_label billing_mode metadata_json", "created_at", "active"
    ),
    "subscription_plans": _schema(
        "subscription_plan_id provider_account_id name currency", "price_micros period_start period_end created_at"
    ),
    "model_pricing": _schema(
        "pricing_snapshot_id provider provider_account_id model currency source",
        "input_per_million_micros cache_read_per_million_micros cache_write_per_million_micros "
        "output_per_million_micros reasoning_per_million_micros effective_from effective_to created_at",
    ),
    "model_calls": _schema(
        "call_id session_id turn_id message_id generation_id agent_id agent_run_id parent_call_id provider_account_id "
        "provider model provider_request_id route_reason route_policy_id fallback_from_call_id status finish_reason "
        f"error_type error_code failure_stage {_COSTS} raw_metadata_json",
        "requested_at first_token_at last_token_at completed_at ttft_ms generation_duration_ms total_latency_ms "
        "output_tokens_per_second_milli cancelled_at model_context_limit context_tokens context_utilization_bps "
        f"requested_max_output_tokens {_COST_AMOUNTS}",
        "owns_turn owns_agent_run",
    ),
    "model_call_attempts": _schema(
        "attempt_id call_id provider_account_id provider model provider_request_id status error_type error_code "
        f"failure_stage {_COSTS} raw_metadata_json",
        "attempt_number started_at response_received_at first_token_at last_token_at completed_at latency_ms "
        f"http_status {_COST_AMOUNTS}",
    ),
    "model_call_usage": _schema(f"call_id {_USAGE}", " ".join(TOKEN_COLUMNS)),
    "model_call_attempt_usage": _schema(f"attempt_id {_USAGE}", " ".join(TOKEN_COLUMNS)),
    "cost_allocations": _schema(
        "allocation_id call_id subscription_plan_id currency method", "amount_micros period_start period_end created_at"
    ),
    "retrieval_items": _schema(
        "id namespace type source_system source_type source_id content content_hash revision scope_kind scope_key "
        "metadata_json lexical_state vector_state fingerprint failure_stage failure_code",
        "created_at updated_at indexed_at projection_version schema_version failure_at",
        "failure_retryable",
    ),
    "retrieval_vectors": _schema("id revision fingerprint", "dimensions").add("vector", T.ArrayType(T.FloatType())),
    "retrieval_lexical": _schema("id", "n_tokens").add("tokens", T.ArrayType(T.StringType())),
}
