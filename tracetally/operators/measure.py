"""Benchmark and device measurements: statistics, batches, throughput, safety, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import floor_zero, safe_div
from ..functions.scan import at_ranks, numbered, running_sum
from .packs import greedy_packs

MIB = 1024 * 1024
SAMPLE_LIMIT = 128
BATCH_TOKENS = 4096
SAFETY_CODES = ["LOW_MEMORY", "THERMAL_LIMIT", "SAFETY_UNAVAILABLE"]
# Batch sizes measured per input size, and the size's optional tier.
BATCH_TARGETS = {"short": [1, 2, 5, 10, 20, 50, 100], "128": [1, 2, 5, 10, 20, 50], "256": [1, 2, 5, 10, 20], "near512": [1, 2, 5, 10]}
OPTIONAL_TARGET = {"128": 50, "256": 20, "near512": 10}
LIMITS = ["n_batch", "n_ubatch", "n_ctx", "n_ctx_seq", "max_parallel_sequences", "backend_max_parallel_sequences"]


def is_finite(x: Column) -> Column:
    v = x.cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def nearest(p: float) -> Callable[[Column], Column]:
    """Rank of the nearest-rank percentile."""
    return lambda n: F.ceil(n * F.lit(p))


def with_ranks(out: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    named = ranked.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in ranked.columns if c not in keys])
    return out.join(named, on, "left").drop(*[f"_r_{k}" for k in keys])


def latency_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, total, mean, median and nearest-rank p95 per key; NULLs if a value is negative or not finite."""
    bad = ~is_finite(F.col(value)) | (F.col(value) < 0)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.max(bad).alias("invalid"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
    )
    middle = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.ceil((n + 1) / 2)}
    out = with_ranks(out, at_ranks(df, keys, value, {**middle, "p95": nearest(0.95)}), keys)
    out = out.select(*keys, "count", "invalid", "total", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95")
    return out.withColumns({c: F.when(~F.col("invalid"), F.col(c)) for c in ("total", "mean", "median", "p95")})


def backend_metrics(df: DataFrame, keys: list[str], ms: str = "duration_ms") -> DataFrame:
    """Nearest-rank p50 and p95 search times with candidate counts; 0 for an empty group."""
    out = df.groupBy(*keys).agg(
        F.count(ms).alias("runs"),
        F.min("candidates").alias("min_candidates"),
        F.max("candidates").alias("max_candidates"),
    )
    out = with_ranks(out, at_ranks(df, keys, ms, {"p50_ms": nearest(0.5), "p95_ms": nearest(0.95)}), keys)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50_ms", "p95_ms")]
    return out.select(*keys, "runs", *zero, "min_candidates", "max_candidates")


def benchmark_rollup(runs: DataFrame, items: DataFrame, samples: DataFrame) -> DataFrame:
    """Wall and inference throughput, non-inference time, cold/warm counts and peak memory per run."""
    inner = items.groupBy("run_id").agg(
        F.sum("inference_ms").alias("inference_ms"), F.sum(F.when(F.col("warm"), 1).otherwise(0)).alias("warm_inferences"),
        F.sum(F.when(F.col("warm"), 0).otherwise(1)).alias("cold_inferences"),
    )
    peak = samples.groupBy("run_id").agg(F.max("app_pss_bytes").alias("sample_peak_pss_bytes"))
    out = runs.join(inner, "run_id", "left").join(peak, "run_id", "left")
    inf = F.coalesce("inference_ms", F.lit(0))
    return out.select(
        "run_id",
        inf.alias("inference_only_ms"),
        floor_zero(F.col("elapsed_ms") - inf).alias("non_inference_ms"),
        safe_div(F.col("completed") * 1000, F.col("elapsed_ms")).alias("documents_per_second"),
        safe_div(F.col("completed") * 1000, inf).alias("inference_documents_per_second"),
        safe_div(F.col("total_tokens") * 1000, F.col("elapsed_ms")).alias("tokens_per_second"),
        safe_div(F.col("total_tokens") * 1000, inf).alias("inference_tokens_per_second"),
        F.coalesce("warm_inferences", F.lit(0)).alias("warm_inferences"),
        F.coalesce("cold_inferences", F.lit(0)).alias("cold_inferences"),
        "sample_peak_pss_bytes",
    )


def outcomes(runs: DataFrame, batch: bool = False) -> DataFrame:
    """Outcome, failures, cancelled and skipped of each run from its error code.

    One-by-one runs fail at least one and count attempted - completed; batch runs
    count unreported items, and an unavailable safety reading stops them safely.
    """
    code = F.col("error_code")
    safety = code.isin(SAFETY_CODES if batch else SAFETY_CODES[:2])
    outcome = F.when(code.isNull(), "success").when(code == "CANCELLED", "cancelled").when(safety, "safety-stop").otherwise("error")
    lost = F.col("unreported") if batch else F.col("attempted") - F.col("completed")
    cancelled = F.when(outcome == "cancelled", F.col("requested") - F.col("completed")).otherwise(0)
    failures = F.when(outcome == "error", F.greatest(F.lit(1), lost)).otherwise(0)
    out = runs.withColumns({"outcome": outcome, "cancelled": cancelled, "failures": failures})
    return out.withColumn("skipped", floor_zero(F.col("requested") - F.col("completed") - F.col("cancelled") - F.col("failures")))


def load_deltas(loads: DataFrame) -> DataFrame:
    """Observed memory change of each load; NULL if either reading is missing."""
    return loads.withColumn("observed_pss_delta_bytes", F.col("pss_after") - F.col("pss_before"))


def batch_capacity(inputs: DataFrame) -> DataFrame:
    """Effective policy and capacity for every batch target of an input size.

    ``inputs``: size, actual_tokens, count and the native limits. A tier is skipped
    when nothing fits, or when it is optional and does not fit whole.
    """
    targets = F.lit(None).cast("array<int>")
    optional = F.lit(None).cast("int")
    for size, tiers in BATCH_TARGETS.items():
        targets = F.when(F.col("size") == size, F.array(*[F.lit(t) for t in tiers])).otherwise(targets)
        if size in OPTIONAL_TARGET:
            optional = F.when(F.col("size") == size, F.lit(OPTIONAL_TARGET[size])).otherwise(optional)
    out = inputs.withColumn("target", F.explode(targets))
    valid = F.lit(True)
    for limit in LIMITS:
        valid = valid & F.coalesce(F.col(limit) > 0, F.lit(False))
    out = out.withColumns(
        {
            "max_sequences": F.least(F.col("target"), "max_parallel_sequences", "backend_max_parallel_sequences"),
            "max_tokens": F.least(F.lit(BATCH_TOKENS), "n_batch", "n_ubatch", "n_ctx"),
            "optional": F.coalesce(F.col("target") == optional, F.lit(False)),
        }
    )
    fits = F.least(F.col("max_sequences"), F.floor(F.col("max_tokens") / F.col("actual_tokens")))
    out = out.withColumn("capacity", F.when(F.col("actual_tokens") <= F.col("n_ctx_seq"), fits).otherwise(0))
    skipped = (F.col("capacity") == 0) | (F.col("optional") & (F.col("capacity") < F.col("target")))
    why = F.when(F.col("actual_tokens") > F.col("n_ctx_seq"), "input_exceeds_context").when(F.col("capacity") == 0, "no_sequence_fits").otherwise("target_exceeds_capacity")
    out = out.withColumns(
        {
            "chunk_size": F.least("target", "capacity", "count"),
            "skipped": skipped,
            "skip_reason": F.when(skipped, why),
            "required_tokens": F.col("target") * F.col("actual_tokens"),
        }
    )
    return out.withColumn("reject_code", F.when(~valid, "BATCH_LIMITS_UNAVAILABLE"))


def pack_batches(docs: DataFrame, max_sequences: int, max_tokens: int, n_ctx_seq: int) -> tuple[DataFrame, DataFrame]:
    """(packed, rejects): greedy packs in input order within each request.

    ``docs``: request_id, position, tokens. A pack is closed when the next document
    would exceed the sequence or token budget; documents are never split.
    Documents over the budget are rejected; null tokens count as none. A request's
    blocks of rows are packed side by side, however many it has.
    """
    budget = min(max_tokens, BATCH_TOKENS)
    code = F.when((F.col("tokens") > n_ctx_seq) | (F.col("tokens") > budget), "INPUT_TOO_LONG")
    rows = docs.withColumn("reject_code", code)
    ok = rows.filter(F.col("reject_code").isNull()).select("request_id", F.col("position").cast("long").alias("position"), F.col("tokens").cast("long").alias("tokens"))
    packed = greedy_packs(ok, max_sequences, budget)
    return packed, rows.filter(F.col("reject_code").isNotNull()).select("request_id", "position", "tokens", "reject_code")


def check_batches(results: DataFrame, decodes: DataFrame, items: DataFrame | None = None, expected_tokens: int | None = None) -> DataFrame:
    """Consistency of each batch's metrics with its decodes and items: NULL, TOKEN_SIZING or INVALID_BATCH_METRICS.

    ``results``: batch_id, item_count, total_tokens, native_decode_count, effective_batch_size,
    native_decode_ms, preparation_ms, total_elapsed_ms, max_sequences, max_tokens, n_ctx_seq.
    """
    caps = results.select("batch_id", "max_sequences", "max_tokens")
    d = decodes.join(caps, "batch_id")
    bad = ~F.col("sequences").between(1, F.col("max_sequences")) | ~F.col("tokens").between(1, F.col("max_tokens"))
    bad = bad | ~is_finite(F.col("native_decode_ms")) | (F.col("native_decode_ms") < 0)
    if expected_tokens is not None:
        bad = bad | (F.col("tokens") != F.col("sequences") * expected_tokens)
    agg = d.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("d_n"), F.sum("sequences").alias("d_seq"), F.sum("tokens").alias("d_tok"), F.sum("native_decode_ms").alias("d_ms"),
        F.max("sequences").alias("d_max"), F.max(F.coalesce(bad, F.lit(True))).alias("d_bad"),
    )
    r = results.join(agg, "batch_id", "left")
    if items is not None:
        sized = F.col("token_count") > F.col("n_ctx_seq")
        if expected_tokens is not None:
            sized = sized | (F.col("token_count") != expected_tokens)
        per = items.join(results.select("batch_id", "n_ctx_seq"), "batch_id").groupBy("batch_id").agg(
            F.max(sized).alias("i_bad"), F.sum("token_count").alias("i_tok"), F.count(F.lit(1)).alias("i_n")
        )
        r = r.join(per, "batch_id", "left")
    else:
        r = r.withColumns({"i_bad": F.lit(False), "i_tok": F.col("total_tokens"), "i_n": F.col("item_count")})
    times = ["native_decode_ms", "preparation_ms", "total_elapsed_ms"]
    shape = F.coalesce((F.col("d_n") == F.col("native_decode_count")) & (F.col("total_tokens") > 0) & (F.col("i_n") == F.col("item_count")), F.lit(False))
    for t in times:
        shape = shape & is_finite(F.col(t)) & (F.col(t) >= 0)
    sums = (
        (F.col("d_seq") == F.col("item_count"))
        & (F.col("i_tok") == F.col("total_tokens"))
        & (F.col("d_tok") == F.col("i_tok"))
        & (F.col("effective_batch_size") == F.col("d_max"))
        & (F.abs(F.col("d_ms") - F.col("native_decode_ms")) <= F.greatest(F.lit(0.01), F.col("d_ms") * 1e-6))
        & (F.col("native_decode_ms") + F.col("preparation_ms") <= F.col("total_elapsed_ms") + 0.01)
    )
    code = (
        F.when(~shape, "INVALID_BATCH_METRICS")
        .when(F.col("i_bad"), "TOKEN_SIZING")
        .when(F.col("d_bad") | ~F.coalesce(sums, F.lit(False)), "INVALID_BATCH_METRICS")
    )
    return r.select("batch_id", code.alias("reject_code"))


def batch_run_rollup(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Totals per run, largest batch, means per decode and amortised time per document."""
    r = results.groupBy("run_id").agg(
        F.sum("item_count").alias("completed"), F.sum("total_tokens").alias("total_tokens"), F.sum("native_decode_count").alias("native_decode_count"),
        F.max("effective_batch_size").alias("effective_batch_size"), F.sum("native_decode_ms").alias("native_decode_ms"),
        F.sum("total_elapsed_ms").alias("native_elapsed_ms"), F.sum("preparation_ms").alias("preparation_ms"),
    )
    wall = chunks.groupBy("run_id").agg((F.max("end_ms") - F.min("start_ms")).alias("elapsed_ms"))
    c = F.col("completed")
    return r.join(wall, "run_id", "left").select(
        "*",
        safe_div(c, F.col("native_decode_count")).alias("mean_sequences_per_decode"),
        safe_div(F.col("total_tokens"), F.col("native_decode_count")).alias("mean_tokens_per_decode"),
        safe_div(F.col("elapsed_ms"), c).alias("effective_ms_per_document"),
        safe_div(c * 1000, F.col("elapsed_ms")).alias("documents_per_second"),
        safe_div(F.col("total_tokens") * 1000, F.col("elapsed_ms")).alias("tokens_per_second"),
    )


def throughput_blocks(chunks: DataFrame, block_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(blocks, unavailable): initial, middle and final thirds of each run's chunks.

    ``chunks``: run_id, chunk_no, completed (positive), total_tokens, start_ms, end_ms. Whole
    contiguous chunks; the two cuts are the ones nearest to 1/3 and 2/3 of the
    completed documents, earliest on ties, leaving at least one chunk per block.
    Running sums grow strictly, so the nearest cut is a plain minimum. Runs with
    fewer than three chunks have no blocks.
    """
    rows = numbered(chunks.withColumn("_b", F.floor(F.col("chunk_no") / block_rows)), ["run_id"], "_b", ["chunk_no"], "idx")
    rows = running_sum(rows, ["run_id"], "_b", ["chunk_no"], "completed", "done").drop("_b")
    totals = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("completed").alias("total"))
    rows = rows.join(totals, "run_id")
    k = F.col("idx") + 1
    ok = rows.filter(F.col("n") >= 3)
    gap = lambda part: F.abs(F.col("done") * 3 - F.col("total") * part)
    cut1 = ok.groupBy("run_id").agg(F.min_by(k, F.when(k <= F.col("n") - 2, F.struct(gap(1), k))).alias("cut1"))
    ok = ok.join(cut1, "run_id")
    later = (k > F.col("cut1")) & (k <= F.col("n") - 1)
    cut2 = ok.groupBy("run_id").agg(F.min_by(k, F.when(later, F.struct(gap(2), k))).alias("cut2"))
    ok = ok.join(cut2, "run_id")
    phase = F.when(k <= F.col("cut1"), "initial").when(k <= F.col("cut2"), "middle").otherwise("final")
    blocks = ok.withColumn("phase", phase).groupBy("run_id", "phase").agg(
        F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"),
        F.sum("completed").alias("completed"), F.sum("total_tokens").alias("total_tokens"),
    ).withColumn("elapsed_ms", F.col("end_ms") - F.col("start_ms"))
    blocks = blocks.select(
        "*",
        safe_div(F.col("completed") * 1000, F.col("elapsed_ms")).alias("documents_per_second"),
        safe_div(F.col("total_tokens") * 1000, F.col("elapsed_ms")).alias("tokens_per_second"),
    )
    return blocks, totals.filter(F.col("n") < 3).select("run_id", F.lit("too_few_chunks").alias("throughput_reason"))


def safety(samples: DataFrame) -> DataFrame:
    """Safety class of each device sample; a missing reading is never safe."""
    ram, threshold = F.col("available_ram_bytes"), F.col("threshold_bytes")
    low = F.coalesce(F.col("low_memory"), F.lit(False)) | F.coalesce(
        threshold.isNotNull() & (ram < F.greatest(threshold + 256 * MIB, F.lit(512 * MIB))), F.lit(False)
    )
    hot = F.coalesce(F.col("thermal_status") >= 3, F.lit(False)) | F.coalesce(F.col("battery_temperature_c") >= 42, F.lit(False))
    missing = (
        F.coalesce(F.col("low_memory"), F.lit(True))
        | F.coalesce(ram < 0, F.lit(True))
        | F.coalesce(threshold < 0, F.lit(True))
        | F.coalesce(F.col("thermal_status") < 0, F.lit(True))
        | ~is_finite(F.col("battery_temperature_c"))
    )
    return samples.withColumn("safety", F.when(low, "LOW_MEMORY").when(hot, "THERMAL_LIMIT").when(missing, "SAFETY_UNAVAILABLE"))


def sample_peaks(samples: DataFrame) -> DataFrame:
    """Peaks and end points of each run's device samples, in sample order. Heaps that were not sampled have no peak."""
    heap = lambda c: F.max(F.col(c) if c in samples.columns else F.lit(None).cast("long"))
    return samples.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max("app_pss_bytes").alias("peak_pss_bytes"),
        heap("native_heap_bytes").alias("peak_native_heap_bytes"),
        heap("java_heap_bytes").alias("peak_java_heap_bytes"),
        F.max("battery_temperature_c").alias("peak_temperature_c"),
        F.max("thermal_status").alias("peak_thermal"),
        F.min("available_ram_bytes").alias("minimum_available_ram_bytes"),
        F.min_by("battery_temperature_c", "seq").alias("initial_temperature_c"),
        F.max_by("battery_temperature_c", "seq").alias("final_temperature_c"),
        F.min_by("thermal_status", "seq").alias("initial_thermal"),
        F.max_by("thermal_status", "seq").alias("final_thermal"),
    )


def compact_samples(samples: DataFrame, limit: int = SAMPLE_LIMIT, block_rows: int = 100_000) -> DataFrame:
    """At most ``limit`` samples per run on a power-of-two index grid, first and last kept."""
    rows = numbered(samples.withColumn("_b", F.floor(F.col("seq") / block_rows)), ["run_id"], "_b", ["seq"], "idx").drop("_b")
    last = samples.groupBy("run_id").agg((F.count(F.lit(1)) - 1).alias("last_idx"))
    strides = F.array(*[F.lit(2**j).cast("long") for j in range(40)])
    fits = F.filter(strides, lambda s: F.floor(F.col("last_idx") / s) + 1 + F.when(F.col("last_idx") % s != 0, 1).otherwise(0) <= limit)
    last = last.withColumn("stride", F.element_at(fits, 1))
    return rows.join(last, "run_id").filter((F.col("idx") % F.col("stride") == 0) | (F.col("idx") == F.col("last_idx"))).drop("last_idx")


def fastest(runs: DataFrame) -> DataFrame:
    """The tier of each comparison that is observably fastest, if there is one.

    ``runs``: up to seven tiers per comparison. Every measured tier must be complete,
    comparable and free of errors under one policy and one set of limits; the best must beat the
    second by more than 10 % and not repeat another tier's capped policy.
    """
    measured = runs.filter(F.col("outcome") != "skipped")
    eq = lambda a, b: F.coalesce(F.abs(a - b) < 0.001, F.lit(False))
    c = F.col
    clean = (
        (c("outcome") == "success")
        & c("error_code").isNull()
        & (c("requested") > 0)
        & (c("completed") == c("requested"))
        & (c("attempted") == c("requested"))
        & (c("failures") + c("cancelled") + c("skipped") + c("unreported") == 0)
        & (c("actual_tokens") > 0)
        & (c("total_tokens") == c("completed") * c("actual_tokens"))
        & (c("elapsed_ms") > 0)
        & eq(c("documents_per_second"), c("completed") * 1000 / c("elapsed_ms"))
        & eq(c("tokens_per_second"), c("documents_per_second") * c("actual_tokens"))
        & (c("effective_batch_size") > 0)
        & c("gate_passed")
    )
    per = Window.partitionBy("comparison_id")
    ranked = per.orderBy(F.desc("documents_per_second"), "target")
    one = lambda x: F.min(x).over(per) == F.max(x).over(per)
    same_policy = Window.partitionBy("comparison_id", "mode", "effective_batch_size", "capacity", "chunk_size", "max_tokens")
    rows = measured.withColumns(
        {
            "comparable": F.min(F.coalesce(clean, F.lit(False))).over(per) & one("requested") & one("actual_tokens") & one("max_tokens") & one("limits_key") & (F.count(F.lit(1)).over(per) >= 2),
            "place": F.row_number().over(ranked),
            "next_rate": F.lead("documents_per_second").over(ranked),
            "alike": F.count(F.lit(1)).over(same_policy),
        }
    )
    wins = c("comparable") & (c("alike") == 1) & (c("documents_per_second") > c("next_rate") * 1.1)
    return rows.filter("place = 1").select("comparison_id", F.when(wins, c("target")).alias("fastest_target"))


def indexing_report(diagnostics: DataFrame, runs: DataFrame) -> DataFrame:
    """Lexical time during admission and end-to-end rate of each indexing run.

    ``diagnostics``: run_id, event, duration_ms. ``runs``: run_id, items, ready, admission_ms, end_to_end_ms.
    """
    lex = diagnostics.filter(F.col("event") == "lexical_ready").groupBy("run_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("admission_lexical_ms"))
    return runs.join(lex, "run_id", "left").withColumns(
        {
            "admission_lexical_ms": F.coalesce("admission_lexical_ms", F.lit(0)),
            "items_per_second": F.col("ready") * 1000 / F.greatest(F.lit(1), F.col("end_to_end_ms")),
        }
    )
