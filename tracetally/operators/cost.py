"""Cost of attempts and calls, call timing, session and turn summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SAFE_MAX, floor_zero, js_round, known_money, skip_sum, strict_money
from ..functions.sizing import shuffled
from . import usage as U
from .pricing import RATES, resolve_price

MILLION = 1_000_000


def api_cost(df: DataFrame) -> DataFrame:
    """API-equivalent cost of each row from its usage and its ``price`` struct.

    With a reasoning rate, output and reasoning must both be known and reasoning
    is priced apart. An unknown count with a rate, or a positive count without
    one, leaves the whole cost unknown. Amounts are exact integers, rounded
    half-up; negative or unsafe counts, and costs beyond the safe range, are
    reported in ``cost_reject`` instead of a wrong number.
    """
    df = U.select_usage(df)
    split = F.col(f"price.{RATES[4]}").isNotNull()
    sel = {d: F.col(f"sel_{d}") for d in U.PRICED}
    regular = F.when(split, F.greatest(F.lit(0), sel["output"] - sel["reasoning"])).otherwise(sel["output"])
    counts = [sel["input"], sel["cache_read"], sel["cache_write"], regular, F.when(split, sel["reasoning"])]
    df = df.select("*", *[t.alias(f"t{i}") for i, t in enumerate(counts)], *[F.col(f"price.{r}").alias(f"r{i}") for i, r in enumerate(RATES)])
    t, r = [F.col(f"t{i}") for i in range(5)], [F.col(f"r{i}") for i in range(5)]
    usable = F.col("price").isNotNull() & ~U._all([c.isNull() for c in sel.values()])
    usable = usable & (~split | (sel["output"].isNotNull() & sel["reasoning"].isNotNull()))
    for ti, ri in zip(t, r):
        usable = usable & (ti.eqNullSafe(F.lit(0)) | (ti.isNull() == ri.isNull()))
    # counts and rates that enter the sum; everything else is 0
    df = df.select(
        "*",
        usable.alias("usable"),
        *[F.coalesce(ti, F.lit(0)).cast("long").alias(f"n{i}") for i, ti in enumerate(t)],
        *[F.coalesce(F.when(ti != 0, ri), F.lit(0)).cast("long").alias(f"m{i}") for i, (ti, ri) in enumerate(zip(t, r))],
    )
    n, m = [F.col(f"n{i}") for i in range(5)], [F.col(f"m{i}") for i in range(5)]
    quick = F.lit(MILLION // 2).cast("long")  # NULL when a long overflows
    for ni, mi in zip(n, m):
        quick = F.try_add(quick, F.try_multiply(ni, mi))
    bits = reduce(Column.bitwiseOR, [*n, *m])  # one of them is negative or above SAFE_MAX when a bit from SAFE_MAX + 1 on is set
    unsafe = F.shiftright(bits, SAFE_MAX.bit_length()) != 0
    df = df.select("*", F.when(F.col("usable"), unsafe).alias("unsafe"), quick.alias("quick"))
    safe = F.col("usable") & ~F.col("unsafe")
    # a few rows need it; a fold over an array keeps its code apart from the joins', whose method the JVM would else not compile
    wide = lambda c: c.cast("decimal(16,0)")
    terms = F.array(*[F.struct(ni.alias("n"), mi.alias("m")) for ni, mi in zip(n, m)])
    half = F.lit(MILLION // 2).cast("decimal(38,0)")
    exact = F.aggregate(terms, half, lambda total, x: (total + wide(x["n"]) * wide(x["m"])).cast("decimal(38,0)"))
    df = df.withColumn("exact", F.when(safe & F.col("quick").isNull(), exact))
    amount = F.when(safe & F.col("quick").isNotNull(), F.expr(f"quick div {MILLION}")).when(
        safe & (F.col("exact") < F.lit(SAFE_MAX).cast("decimal(16,0)") * MILLION), F.expr(f"exact div {MILLION}")
    )
    df = df.withColumn("configured_micros", amount)
    priced = F.col("configured_micros").isNotNull()
    reject = F.when(F.col("unsafe"), "unsafe_integer").when(safe & ~priced, "cost_overflow")
    return df.select(
        "*",
        F.when(priced, F.col("price.currency")).alias("configured_currency"),
        F.when(priced, F.col("price.pricing_snapshot_id")).alias("configured_price_id"),
        reject.alias("cost_reject"),
    ).drop("usable", "unsafe", "quick", "exact", *[f"{x}{i}" for x in "trnm" for i in range(5)])


def with_fallback(df: DataFrame, registry_usd: str = "registry_cost_usd") -> DataFrame:
    """Use the supplied registry cost (USD) where no configured cost exists."""
    usd = F.col(registry_usd)
    given = F.when(F.col("has_usage") & ~F.isnan(usd) & (usd >= 0), js_round(usd * MILLION))
    configured = F.col("configured_micros").isNotNull()
    return df.select(
        "*",
        F.coalesce("configured_micros", given).alias("api_equivalent_cost_micros"),
        F.when(configured, F.col("configured_currency")).when(given.isNotNull(), "USD").alias("api_equivalent_currency"),
        F.when(configured, F.concat(F.lit("configured_pricing:"), F.col("cost_provenance")))
        .when(given.isNotNull(), "external_fallback")
        .alias("api_equivalent_cost_source"),
        F.when(configured, F.col("configured_price_id")).alias("pricing_snapshot_id"),
    )


def attempt_cost(attempts: DataFrame, pricing: DataFrame) -> DataFrame:
    """Price, cost and latency of each attempt; an attempt without usage has no configured cost."""
    tokens = [c for c in U.TOKEN_COLUMNS if c in attempts.columns]
    masked = attempts.withColumns({c: F.when(F.col("has_usage"), F.col(c)) for c in tokens})
    out = with_fallback(api_cost(resolve_price(masked, pricing)))
    return out.withColumn("latency_ms", floor_zero(F.col("completed_at") - F.col("started_at")))


def finalize_calls(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """Usage, cost and timing of every call in one aggregation over its costed attempts."""
    output = F.coalesce(*[F.col(c) for c in ("reported_output_tokens", "estimated_output_tokens") if c in attempts.columns])
    timing = F.struct(
        "first_token_at",
        "last_token_at",
        F.col("completed_at").alias("attempt_completed_at"),
        "provider_request_id",
        F.when(F.col("has_usage"), output).alias("timed_output"),
    )
    number = F.col("attempt_number")
    api, api_cur = strict_money(F.col("api_equivalent_cost_micros"), F.col("api_equivalent_currency"))
    metered, metered_cur = strict_money(F.col("metered_cost_micros"), F.col("metered_currency"))
    pid = F.col("pricing_snapshot_id")
    usage = U.usage_aggregates(attempts.columns)
    per_call = attempts.groupBy("call_id").agg(
        *[c.alias(n) for n, c in usage.items()],
        F.max_by(timing, F.when(F.col("status") == "completed", number)).alias("good"),
        F.max_by(timing, number).alias("last"),
        api.alias("api_equivalent_cost_micros"),
        api_cur.alias("api_equivalent_currency"),
        metered.alias("metered_cost_micros"),
        metered_cur.alias("metered_currency"),
        F.when(F.min(pid) == F.max(pid), F.min(pid)).alias("pricing_snapshot_id"),
    )
    joined = calls.join(per_call, "call_id", "left")
    joined = joined.withColumn("timed", F.coalesce("good", "last"))
    first = F.col("timed.first_token_at")
    end = F.coalesce(F.col("timed.last_token_at"), F.col("timed.attempt_completed_at"), F.col("completed_at"))
    duration = floor_zero(end - first)
    out = joined.select(
        *calls.columns,
        *usage,
        "api_equivalent_cost_micros",
        "api_equivalent_currency",
        "metered_cost_micros",
        "metered_currency",
        F.when(F.col("api_equivalent_cost_micros").isNotNull(), "attempt_aggregate").alias("api_equivalent_cost_source"),
        F.when(F.col("metered_cost_micros").isNotNull(), "attempt_aggregate").alias("metered_cost_source"),
        "pricing_snapshot_id",
        first.alias("first_token_at"),
        F.col("timed.last_token_at").alias("last_token_at"),
        F.coalesce("good.provider_request_id", "last.provider_request_id").alias("provider_request_id"),
        floor_zero(first - F.col("requested_at")).alias("ttft_ms"),
        duration.alias("generation_duration_ms"),
        floor_zero(F.col("completed_at") - F.col("requested_at")).alias("total_latency_ms"),
        F.col("timed.timed_output").alias("timed_output"),
    )
    speed = F.when(
        F.col("generation_duration_ms") > 0, js_round(F.col("timed_output") * F.lit(1e6) / F.col("generation_duration_ms"))
    )
    return call_context(
        out.withColumn("output_tokens_per_second_milli", speed)
        .withColumn("any_usage", F.coalesce("any_usage", F.lit(False)))
        .drop("timed_output")
    )


def call_context(calls: DataFrame) -> DataFrame:
    """Context utilisation in basis points and the cancellation time."""
    limit = F.col("model_context_limit")
    return calls.withColumns(
        {
            "context_utilization_bps": F.when(limit != 0, js_round(F.col("context_tokens") * F.lit(1e4) / limit)),
            "cancelled_at": F.when(F.col("status") == "cancelled", F.col("completed_at")),
        }
    )


def session_summary(calls: DataFrame) -> DataFrame:
    """Displayable usage per session from finalized calls.

    Token sums skip unknowns; cost is the sum of the known calls with an unknown
    flag; context percentage comes from the latest call that has both a usage row
    and a positive context limit. Sessions with nothing known have no row.
    """
    here = F.col("any_usage")
    tokens = {d: F.when(here, U.selected(d)) for d in ("input", "cache_read", "output")}
    amount, currency, unknown = known_money(F.col("api_equivalent_cost_micros"), F.col("api_equivalent_currency"))
    held = F.coalesce(tokens["input"], F.lit(0)) + F.coalesce(tokens["cache_read"], F.lit(0)) + F.coalesce(tokens["output"], F.lit(0))
    percent = F.least(F.lit(999.0), js_round(held * F.lit(1e3) / F.col("model_context_limit")) / 10)
    eligible = here & (F.col("model_context_limit") > 0)
    out = calls.groupBy("session_id").agg(
        *[skip_sum(c).alias(f"{d}_tokens") for d, c in tokens.items()],
        amount.alias("cost_micros"),
        currency.alias("currency"),
        unknown.alias("has_unknown_cost"),
        F.max_by(percent, F.when(eligible, F.struct("requested_at", "call_id"))).alias("context_percent"),
    )
    has_cost = F.col("currency").isNotNull()
    return out.withColumn("cost_micros", F.when(has_cost, F.col("cost_micros"))).filter(
        F.col("input_tokens").isNotNull() | F.col("cache_read_tokens").isNotNull() | F.col("output_tokens").isNotNull() | has_cost
    )


def turn_detail(calls: DataFrame, runs: DataFrame, accounts: DataFrame, default_agent: str = "agent") -> DataFrame:
    """Usage of each session's latest turn, taken from its last call that owns the turn.

    Without such a call, or outside a turn, the session's latest call stands in.
    """
    order = F.struct("requested_at", "call_id")
    latest = calls.groupBy("session_id").agg(
        F.max_by("turn_id", order).alias("latest_turn"), F.max_by("call_id", order).alias("latest_call")
    )
    owners = (
        calls.filter(F.col("turn_id").isNotNull())
        .groupBy(F.col("turn_id").alias("owned_turn"))
        .agg(F.max_by("call_id", F.when(F.col("owns_turn"), order)).alias("owner_call"))
    )
    chosen = latest.join(owners, F.col("latest_turn") == F.col("owned_turn"), "left").select(
        F.col("session_id").alias("for_session"), "latest_turn", F.coalesce("owner_call", "latest_call").alias("primary_call")
    )
    names = runs.select(F.col("agent_run_id"), F.col("agent_name_snapshot"))
    labels = accounts.select("provider_account_id", "display_label", "billing_mode")
    out = (
        chosen.join(calls, F.col("primary_call") == F.col("call_id"))
        .join(shuffled(names), "agent_run_id", "left")
        .join(labels, "provider_account_id", "left")
    )
    here = F.col("any_usage")
    return out.select(
        F.col("for_session").alias("session_id"),
        F.col("latest_turn").alias("turn_id"),
        "call_id",
        F.coalesce("agent_name_snapshot", F.lit(default_agent)).alias("agent_name"),
        "provider",
        "model",
        F.coalesce("display_label", "provider").alias("account_label"),
        F.coalesce("billing_mode", F.lit("unknown")).alias("billing_mode"),
        F.col("api_equivalent_cost_micros").alias("api_equivalent_micros"),
        "api_equivalent_currency",
        F.col("metered_cost_micros").alias("metered_micros"),
        "metered_currency",
        *[
            F.when(here, U.selected(d)).alias(f"{'uncached_input' if d == 'input' else d}_tokens")
            for d in ("input", "cache_read", "cache_write", "output", "reasoning")
        ],
        "ttft_ms",
        F.col("total_latency_ms").alias("latency_ms"),
        "output_tokens_per_second_milli",
    )


def allocated(calls: DataFrame, allocations: DataFrame) -> DataFrame:
    """Subscription cost allocated to each call; no allocation row means NULL, not unknown."""
    amount, currency, unknown = known_money(F.col("amount_micros"), F.col("currency"), F.col("allocation_id").isNotNull())
    return (
        calls.select("call_id")
        .join(allocations, "call_id", "left")
        .groupBy("call_id")
        .agg(amount.alias("allocated_micros"), currency.alias("allocated_currency"), unknown.alias("has_unknown"))
    )
