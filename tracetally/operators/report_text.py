"""Display rows: session usage lines, turn usage views, price labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as T

# Words shown for a billing mode.
BILLING = {"subscription": "subscription", "api": "API", "token_plan": "token plan", "free": "free", "local": "local"}


def usage_line(summary: DataFrame) -> DataFrame:
    """Token line, cost with '+' when partly unknown, and context percentage per session."""
    tokens = F.concat(
        T.format_tokens(F.col("input_tokens")), F.lit(" in · "), T.format_tokens(F.col("cache_read_tokens")), F.lit(" cache · "),
        T.format_tokens(F.col("output_tokens")), F.lit(" out"),
    )
    amount = F.col("cost_micros") / F.lit(1_000_000)
    text = F.when(amount >= 0.01, T.fixed(amount, 2)).when(amount >= 0.0001, T.fixed(amount, 4)).otherwise(T.fixed(amount, 6))
    text = F.concat(text, F.when(F.col("has_unknown_cost"), "+").otherwise(""))
    dollars = F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("USD")) == "USD"
    cost = F.when(dollars, F.concat(F.lit("$"), text)).otherwise(F.concat_ws(" ", text, F.col("currency")))
    pct = F.col("context_percent")
    shown = F.when(pct == F.floor(pct), F.floor(pct).cast("string")).otherwise(T.fixed(pct, 1))
    return summary.select(
        "session_id", tokens.alias("tokens"), F.when(F.col("cost_micros").isNotNull(), cost).alias("cost"), F.concat(shown, F.lit("%")).alias("context")
    )


def billing_label(mode: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in BILLING.items():
        out = F.when(mode == k, v).otherwise(out)
    return out


def turn_view(detail: DataFrame) -> DataFrame:
    """All text fields of a turn's usage card."""
    label = billing_label(F.col("billing_mode"))
    metered = T.format_money(F.col("metered_micros"), F.col("metered_currency"))
    with_mode = F.col("billing_mode").isin("subscription", "token_plan", "free")
    count = lambda c: T.format_count(F.col(c)).alias(c)
    return detail.select(
        "session_id",
        F.concat("agent_name", F.lit(" turn")).alias("title"),
        T.format_money(F.col("api_equivalent_micros"), F.col("api_equivalent_currency")).alias("api_equivalent"),
        F.when(with_mode, F.concat_ws(" / ", metered, label)).otherwise(metered).alias("metered"),
        count("uncached_input_tokens"), count("cache_read_tokens"), count("cache_write_tokens"), count("output_tokens"), count("reasoning_tokens"),
        T.format_duration(F.col("ttft_ms")).alias("ttft"),
        T.format_duration(F.col("latency_ms")).alias("latency"),
        T.format_speed(F.col("output_tokens_per_second_milli")).alias("speed"),
        F.concat_ws(" ", "account_label", label).alias("account"),
    )


def price_labels(prices: DataFrame) -> DataFrame:
    """Labels and editable texts of a price list."""
    c = F.col
    source = F.when(c("source") == "user", "Your price").when(c("source") == "catalog", "Catalog")
    return prices.select(
        "provider", "model",
        T.format_model_price(c("input_usd"), c("output_usd")).alias("price_label"),
        T.format_cache_price(c("cache_read_usd"), c("cache_write_usd")).alias("cache_label"),
        source.alias("source_label"),
        F.when(c("source") == "none", "Add price").otherwise("Edit price").alias("action_label"),
        T.format_draft(c("input_usd")).alias("draft_input"),
        T.format_draft(c("cache_read_usd")).alias("draft_cache_read"),
    )
