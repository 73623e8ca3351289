"""Device-wide energy estimates from battery counters.

Only differences of remaining-charge and remaining-energy counters are used, and
every doubt yields a reason code instead of a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import lagged

BLOCK = 100_000
SENTINEL = 2_147_483_647
HOUR_MS = 3_600_000
# counter column, largest reliable value, units per mAh / mWh, largest plausible draw (mA / mW), smallest usable delta
KINDS = {
    "charge": ("charge_counter_uah", 100_000_000, 1_000, 10_000, 10),
    "energy": ("energy_counter_nwh", 1_000_000_000_000, 1_000_000, 50_000, 10_000),
}


def screen_readings(df: DataFrame) -> DataFrame:
    """Raw battery properties -> readings; out-of-range values, sentinels and unknown flags become NULL."""
    charge, energy = F.col("charge_counter_uah"), F.col("energy_counter_nwh")
    current = lambda c: F.when(F.col(c).between(-20_000_000, 20_000_000) & (F.col(c) != 0), F.col(c))
    flags = F.col("plugged_flags")
    return df.withColumns(
        {
            "charge_counter_uah": F.when(charge.between(1, 100_000_000), charge),
            "current_now_ua": current("current_now_ua"),
            "current_average_ua": current("current_average_ua"),
            "energy_counter_nwh": F.when(energy.between(1, 1_000_000_000_000) & (energy != SENTINEL), energy),
            "plugged": F.when((flags >= 0) & (flags.bitwiseAND(~15) == 0), flags != 0),
            "status": F.when(F.col("status").between(1, 5), F.col("status")),
        }
    )


def _stepped(samples: DataFrame) -> DataFrame:
    """Samples with the previous sample's readings, in sample order."""
    s = samples.withColumn("_b", F.floor(F.col("seq") / BLOCK))
    cols = ["elapsed_realtime_ms", "charge_counter_uah", "energy_counter_nwh"]
    return lagged(s, ["run_id"], "_b", ["seq"], cols).drop("_b")


def _currents(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("current_now_ua", "current_average_ua") if c in df.columns]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _not_discharging() -> Column:
    return ~F.coalesce((~F.col("plugged")) & (F.col("status") == 3), F.lit(False))


def derive_energy(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Charge and energy used per run, per 100 documents and per 1,000 tokens, or the reason why not.

    ``samples``: run_id, seq, elapsed_realtime_ms, charge_counter_uah, energy_counter_nwh,
    current_now_ua, plugged, status. ``runs``: run_id, completed, total_tokens.
    """
    at = F.col("elapsed_realtime_ms")
    step_ms = at - F.col("prev_elapsed_realtime_ms")
    s = _stepped(samples)
    bad_time = at.isNull() | (at < 0) | (F.col("has_prev") & ~F.coalesce(step_ms > 0, F.lit(False)))
    invalid = (
        F.when(_not_discharging(), "not_discharging")
        .when(_any([(c > 0) & (c <= 20_000_000) for c in _currents(s)]), "positive_current")
        .when(bad_time, "time_not_increasing")
    )
    s = s.withColumn("invalid", invalid)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min_by("invalid", F.when(F.col("invalid").isNotNull(), F.col("seq"))).alias("first_invalid"),
        (F.max_by(at, "seq") - F.min_by(at, "seq")).alias("window_ms"),
    ]
    for kind, (col, top, unit, draw, _) in KINDS.items():
        v, prev = F.col(col), F.col(f"prev_{col}")
        delta = prev - v
        rate = delta / F.lit(float(unit)) * F.lit(float(HOUR_MS)) / step_ms
        issue = F.when(F.col("has_prev") & (step_ms > 0), F.when(delta < 0, "rose").when(rate > draw, "implausible"))
        aggs += [
            F.max(~F.coalesce(v.between(1, top) & (v != SENTINEL), F.lit(False))).alias(f"{kind}_bad"),
            F.min_by(issue, F.when(issue.isNotNull(), F.col("seq"))).alias(f"{kind}_issue"),
            F.sum(F.when(delta > 0, 1).otherwise(0)).alias(f"{kind}_drops"),
            F.max(delta).alias(f"{kind}_step"),
            (F.min_by(v, "seq") - F.max_by(v, "seq")).alias(f"{kind}_delta"),
        ]
    r = runs.select("run_id", "completed", "total_tokens").join(s.groupBy("run_id").agg(*aggs), "run_id", "left")
    whole = F.coalesce(F.col("first_invalid"), F.when(F.coalesce("n", F.lit(0)) < 3, "too_few_samples"), F.when(F.col("window_ms") < 60_000, "window_too_short"))
    r = r.withColumn("invalid", whole)
    for kind, (_, _, unit, _, least) in KINDS.items():
        d = F.col(f"{kind}_delta")
        coarse = (F.col(f"{kind}_drops") < 10) | (F.col(f"{kind}_step") > d / 10) | (d < least)
        reason = (
            F.when(F.col("invalid").isNotNull(), F.col("invalid"))
            .when(F.col(f"{kind}_bad"), f"{kind}_unreliable")
            .when(F.col(f"{kind}_issue").isNotNull(), F.concat(F.lit(f"{kind}_"), f"{kind}_issue"))
            .when(d <= 0, f"{kind}_no_decrease")
            .when(coarse, f"{kind}_too_coarse")
        )
        r = r.withColumn(f"{kind}_reason", reason)
        r = r.withColumn(f"{kind}_used", F.when(F.col(f"{kind}_reason").isNull(), d / F.lit(float(unit))))
    volts = F.col("energy_used") / F.col("charge_used")
    odd = F.coalesce(~volts.between(2, 20), F.lit(False))
    r = r.withColumn("_odd", odd)
    for kind in KINDS:
        r = r.withColumn(f"{kind}_used", F.when(~F.col("_odd"), F.col(f"{kind}_used")))
        r = r.withColumn(f"{kind}_reason", F.when(F.col("_odd"), "inconsistent_counters").otherwise(F.col(f"{kind}_reason")))
    return _normalise(r)


def _normalise(r: DataFrame) -> DataFrame:
    docs = F.when(F.col("completed") > 0, F.col("completed"))
    tokens = F.when(F.col("total_tokens") > 0, F.col("total_tokens"))
    shared = F.col("charge_reason").eqNullSafe(F.col("energy_reason")) & F.col("charge_reason").isNotNull()
    alone = shared & (F.col("charge_reason").isin("inconsistent_counters") | F.coalesce(F.col("charge_reason") == F.col("invalid"), F.lit(False)))
    parts = F.array_join(
        F.array_compact(
            F.array(
                F.col("charge_reason"), F.col("energy_reason"), F.when(docs.isNull(), "no_completed_documents"), F.when(tokens.isNull(), "no_tokens")
            )
        ),
        " ",
    )
    measured = F.col("charge_used").isNotNull() | F.col("energy_used").isNotNull()
    return r.select(
        "run_id",
        F.col("charge_used").alias("charge_consumed_mah"),
        F.col("energy_used").alias("energy_consumed_mwh"),
        (F.col("charge_used") * 100 / docs).alias("mah_per_100_documents"),
        (F.col("energy_used") * 100 / docs).alias("mwh_per_100_documents"),
        (F.col("energy_used") * 1000 / tokens).alias("mwh_per_1000_tokens"),
        "charge_reason",
        "energy_reason",
        F.when(alone, F.col("charge_reason")).otherwise(F.nullif(parts, F.lit(""))).alias("reason"),
        F.when(measured, "counter-estimate").otherwise("unavailable").alias("confidence"),
    )


def screen_energy(estimates: DataFrame, samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Apply the uncompacted samples to estimates made from compacted ones.

    A charging, missing or unordered sample anywhere voids both estimates; an
    invalid, rising or implausible counter step voids its own; unreported work
    voids the per-document and per-token figures.
    """
    at = F.col("elapsed_realtime_ms")
    step_ms = at - F.col("prev_elapsed_realtime_ms")
    s = _stepped(samples)
    unreliable = _not_discharging() | at.isNull() | (at < 0) | _any([c > 0 for c in _currents(s)])
    aggs = [F.max(unreliable).alias("voided")]
    for kind, (col, top, unit, draw, _) in KINDS.items():
        v, prev = F.col(col), F.col(f"prev_{col}")
        per_ms = draw * unit / HOUR_MS
        wild = F.col("has_prev") & ((step_ms <= 0) | (v > prev) | (prev - v > step_ms * per_ms))
        bad = ~F.coalesce(v.between(1, top) & (v != SENTINEL), F.lit(False)) | F.coalesce(wild, F.lit(False))
        aggs.append(F.max(~unreliable & bad).alias(f"{kind}_void"))
    seen = s.groupBy("run_id").agg(*aggs)
    r = estimates.join(seen, "run_id", "left").join(runs.select("run_id", "unreported"), "run_id", "left")
    voided = F.coalesce("voided", F.lit(False))
    cv, ev = F.coalesce("charge_void", F.lit(False)), F.coalesce("energy_void", F.lit(False))
    no_norm = F.coalesce(F.col("unreported") > 0, F.lit(False))
    charge_reason = F.when(voided, "unreliable_window").when(cv, "charge_window_invalid").otherwise(F.col("charge_reason"))
    energy_reason = F.when(voided, "unreliable_window").when(ev, "energy_window_invalid").otherwise(F.col("energy_reason"))
    charge, energy = F.when(~voided & ~cv, F.col("charge_consumed_mah")), F.when(~voided & ~ev, F.col("energy_consumed_mwh"))
    joined = F.nullif(F.array_join(F.array_compact(F.array(charge_reason, energy_reason)), " "), F.lit(""))
    reason = F.when(voided, "unreliable_window").when(cv | ev, joined).otherwise(F.col("reason"))
    reason = F.when(no_norm, F.concat_ws(" ", reason, F.lit("unreported_work"))).otherwise(reason)
    return r.select(
        "run_id",
        charge.alias("charge_consumed_mah"),
        energy.alias("energy_consumed_mwh"),
        F.when(~voided & ~cv & ~no_norm, F.col("mah_per_100_documents")).alias("mah_per_100_documents"),
        F.when(~voided & ~ev & ~no_norm, F.col("mwh_per_100_documents")).alias("mwh_per_100_documents"),
        F.when(~voided & ~ev & ~no_norm, F.col("mwh_per_1000_tokens")).alias("mwh_per_1000_tokens"),
        charge_reason.alias("charge_reason"),
        energy_reason.alias("energy_reason"),
        reason.alias("reason"),
        F.when(charge.isNotNull() | energy.isNotNull(), "counter-estimate").otherwise("unavailable").alias("confidence"),
    )
