"""Queries over benchmark runs, batches, device samples and reports, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as T
from ..operators import energy as E
from ..operators import measure as M
from ..operators import report as P
from .derived import DEFS, NEEDS, table, with_ctes

DEFS.update(
    {
        "search_times": """
SELECT CASE l_returnflag WHEN 'A' THEN 'lexical' WHEN 'N' THEN 'vector' ELSE 'hybrid' END AS mode, CASE WHEN l_linenumber < 3 THEN 100 WHEN l_linenumber < 5 THEN 1000 ELSE 10000 END AS scale,
  CAST(floor(l_extendedprice / 100) AS BIGINT) AS duration_ms, CAST(l_quantity AS BIGINT) AS candidates FROM lineitem""",
        "run_items": """
SELECT 'run'||user_id AS run_id, CASE WHEN event_type <> 'error' THEN value END AS inference_ms, event_type = 'click' AS warm FROM events""",
        "loads": """
SELECT 'run'||user_id AS run_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id * 10 AS BIGINT) END AS pss_before,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id * 10 + 500 - user_id AS BIGINT) END AS pss_after FROM events""",
        "sizing": """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'short' WHEN 1 THEN '128' WHEN 2 THEN '256' ELSE 'near512' END AS size, CASE p_size % 4 WHEN 0 THEN 24 WHEN 1 THEN 126 WHEN 2 THEN 250 ELSE 510 END AS actual_tokens,
  100 AS count, CASE WHEN p_partkey % 10 = 0 THEN 512 ELSE 4096 END AS n_batch, CASE WHEN p_partkey % 15 = 0 THEN 2048 ELSE 4096 END AS n_ubatch, 4096 AS n_ctx, CASE WHEN p_partkey % 7 = 0 THEN 256 ELSE 512 END AS n_ctx_seq,
  CASE WHEN p_partkey % 6 = 0 THEN 8 ELSE 64 END AS max_parallel_sequences, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 256 END AS backend_max_parallel_sequences FROM part""",
        "pack_docs": """
SELECT 'req'||CAST(floor(l_orderkey / 40) AS BIGINT) AS request_id, l_orderkey * 100000 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS position,
  CAST(l_quantity * 12 AS BIGINT) AS tokens FROM lineitem""",
        "tier_runs": """
SELECT *, completed * 1000.0 / elapsed_ms AS documents_per_second, CASE WHEN p_partkey % 43 = 0 THEN 1.0 ELSE completed * 1000.0 / elapsed_ms * actual_tokens END AS tokens_per_second FROM (
  SELECT p_partkey, 'cmp'||CAST(floor(p_partkey / 5) AS BIGINT) AS comparison_id, CAST(power(2, p_partkey % 5) AS BIGINT) AS target, CASE WHEN p_partkey % 5 = 0 THEN 'sequential' ELSE 'true_batch' END AS mode,
   CASE WHEN p_partkey % 31 = 0 THEN 'skipped' WHEN p_partkey % 37 = 0 THEN 'error' ELSE 'success' END AS outcome, CASE WHEN p_partkey % 37 = 0 THEN 'NATIVE_ERROR' END AS error_code,
   CAST(100 AS BIGINT) AS requested, CAST(100 AS BIGINT) AS attempted, CASE WHEN p_partkey % 37 = 0 THEN CAST(90 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS completed, 0 AS failures, 0 AS cancelled, 0 AS skipped, CASE WHEN p_partkey % 53 = 0 THEN 1 ELSE 0 END AS unreported,
   CAST(24 AS BIGINT) AS actual_tokens, CASE WHEN p_partkey % 37 = 0 THEN CAST(2160 AS BIGINT) ELSE CAST(2400 AS BIGINT) END AS total_tokens, CAST(1000 + p_size * 90 AS DOUBLE) AS elapsed_ms, CASE WHEN p_partkey % 5 >= 3 AND p_partkey % 3 = 0 THEN 4 ELSE p_partkey % 5 + 1 END AS effective_batch_size,
   CASE WHEN p_partkey % 5 >= 3 AND p_partkey % 3 = 0 THEN 4 ELSE p_partkey % 5 + 1 END AS capacity, 8 AS chunk_size, 4096 AS max_tokens, CASE WHEN p_partkey % 59 = 0 THEN 'other' ELSE 'same' END AS limits_key, p_partkey % 47 <> 0 AS gate_passed FROM part) t""",
        "lab_history": """
SELECT 'lab'||(user_id % 7) AS lab_id, CASE event_type WHEN 'view' THEN 'benchmark' WHEN 'signup' THEN 'benchmark' WHEN 'click' THEN 'load' WHEN 'error' THEN 'error' ELSE 'comparison' END AS kind, @MS(ts) AS at_ms, event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'Pixel 8 (test)' WHEN event_id % 3 = 1 THEN props ELSE 'sys/path' END AS model, CASE WHEN event_id % 2 = 0 THEN 'vendor/model-'||user_id ELSE '../etc/passwd' END AS model_id,
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'java.lang.Error' WHEN value > 20 THEN 'NETWORK_IO' ELSE 'LOW_MEMORY' END END AS code, CASE WHEN value > 40 THEN 'free text' WHEN value > 20 THEN 'not_discharging' WHEN value > 10 THEN 'charge_rose energy_rose' END AS reason,
  CAST(event_id * 7 - 500 AS BIGINT) AS rss_bytes, CASE WHEN event_type = 'view' THEN 'warm' WHEN event_type = 'signup' THEN 'lukewarm' END AS mode FROM events""",
        "index_diagnostics": """
SELECT 'run'||user_id AS run_id, CASE WHEN event_type IN ('view', 'click') THEN 'lexical_ready' ELSE 'index_staged' END AS event, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS duration_ms FROM events""",
        "index_runs": """
SELECT 'run'||user_id AS run_id, count(*) AS items, CAST(sum(CASE WHEN value > 2 THEN 1 ELSE 0 END) AS BIGINT) AS ready, CAST(user_id * 3 AS BIGINT) AS admission_ms, CAST(user_id * 40 AS BIGINT) AS end_to_end_ms FROM events GROUP BY user_id""",
        "raw_readings": """
SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 7 = 0 THEN 100000001 ELSE event_id * 100 END AS BIGINT) AS charge_counter_uah, CAST(CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 9 = 0 THEN -20000001 ELSE -350000 END AS BIGINT) AS current_now_ua,
  CAST(event_id - 3000 AS BIGINT) AS current_average_ua, CAST(CASE WHEN event_id % 6 = 0 THEN 2147483647 WHEN event_id % 11 = 0 THEN -9223372036854775807 ELSE event_id * 1000000000 END AS BIGINT) AS energy_counter_nwh,
  CAST(event_id % 20 - 1 AS INTEGER) AS plugged_flags, CAST(event_id % 8 AS INTEGER) AS status FROM events""",
    }
)


def latency_stats(s, d):
    rows = table(s, d, "attempts").withColumn("latency_ms", F.col("last_token_at") - F.col("first_token_at")).filter("latency_ms IS NOT NULL")
    out = M.latency_stats(rows, ["provider", "model"], "latency_ms")
    return out.select("provider", "model", "count", "invalid", "total", F.round("mean", 6).alias("mean"), "median", "p95")


def backend_metrics(s, d):
    return M.backend_metrics(table(s, d, "search_times"), ["mode", "scale"])


def benchmark_rollup(s, d):
    out = M.benchmark_rollup(table(s, d, "benchmark_runs"), table(s, d, "run_items"), table(s, d, "device_samples"))
    return out.select(*[F.round(c, 6).alias(c) if c not in ("run_id", "warm_inferences", "cold_inferences", "sample_peak_pss_bytes") else F.col(c) for c in out.columns])


def _runs(s, d):
    return table(s, d, "benchmark_runs").withColumn("attempted", F.col("completed") + F.col("unreported"))


OUT = ["run_id", "outcome", "cancelled", "failures", "skipped"]


def outcomes(s, d):
    return M.outcomes(_runs(s, d)).select(*OUT)


def batch_outcomes(s, d):
    return M.outcomes(_runs(s, d), batch=True).select(*OUT)


def load_deltas(s, d):
    return M.load_deltas(table(s, d, "loads")).select("event_id", "observed_pss_delta_bytes")


def batch_capacity(s, d):
    return M.batch_capacity(table(s, d, "sizing")).select("p_partkey", "target", "max_sequences", "max_tokens", "capacity", "chunk_size", "optional", "skipped", "skip_reason", "required_tokens", "reject_code")


def pack_batches(s, d):
    return M.pack_batches(table(s, d, "pack_docs"), 16, 2048, 512)[0]


def pack_rejects(s, d):
    return M.pack_batches(table(s, d, "pack_docs"), 16, 2048, 512)[1]


def check_batches(s, d):
    return M.check_batches(table(s, d, "batch_results"), table(s, d, "decodes"))


def batch_run_rollup(s, d):
    out = M.batch_run_rollup(table(s, d, "batch_results"), table(s, d, "chunks"))
    exact = ("run_id", "completed", "total_tokens", "native_decode_count", "effective_batch_size", "elapsed_ms")
    return out.select(*[F.col(c) if c in exact else F.round(c, 4).alias(c) for c in out.columns])


def throughput_blocks(s, d):
    out = M.throughput_blocks(table(s, d, "chunks"))[0]
    rate = ("documents_per_second", "tokens_per_second")
    return out.select(*[F.round(c, 6).alias(c) if c in rate else F.col(c) for c in out.columns])


def throughput_reasons(s, d):
    """Runs cut short: every forty chunk numbers start a new one."""
    short = F.concat_ws("-", "run_id", F.floor(F.col("chunk_no") / 40).cast("string"))
    return M.throughput_blocks(table(s, d, "chunks").withColumn("run_id", short))[1]


def safety(s, d):
    return M.safety(table(s, d, "device_samples")).select("run_id", "seq", "safety")


def sample_peaks(s, d):
    return M.sample_peaks(table(s, d, "device_samples"))


def compact_samples(s, d):
    return M.compact_samples(table(s, d, "device_samples"), 16).select("run_id", "seq", "idx", "stride")


ENERGY = ["charge_consumed_mah", "energy_consumed_mwh", "mah_per_100_documents", "mwh_per_100_documents", "mwh_per_1000_tokens"]
REASONS = ["charge_reason", "energy_reason", "reason", "confidence"]


def _energy(df):
    return df.select("run_id", *[F.round(c, 6).alias(c) for c in ENERGY], *REASONS)


def derive_energy(s, d):
    return _energy(E.derive_energy(table(s, d, "device_samples"), table(s, d, "benchmark_runs")))


def screen_energy(s, d):
    raw, runs = table(s, d, "device_samples"), table(s, d, "benchmark_runs")
    kept = M.compact_samples(raw, 64)
    return _energy(E.screen_energy(E.derive_energy(kept, runs), raw, runs))


def screen_readings(s, d):
    return E.screen_readings(table(s, d, "raw_readings")).drop("plugged_flags")


def fastest(s, d):
    return M.fastest(table(s, d, "tier_runs"))


def _report(s, d):
    masks = {
        "model": P.label(F.col("model")), "model_id": P.identifier(F.col("model_id")), "code": P.error_code(F.col("code")), "reason": P.reason(F.col("reason")),
        "rss_bytes": P.byte_count(F.col("rss_bytes")), "mode": P.choice(F.col("mode"), ["cold", "warm"]),
    }
    return P.safe_report(table(s, d, "lab_history"), masks, 3000)


def safe_report(s, d):
    return _report(s, d)[0].drop("size")


def report_omissions(s, d):
    return _report(s, d)[1]


def _errors(s, d):
    return table(s, d, "lab_history").filter("kind = 'error'").select("lab_id", "code", "at_ms", "seq")


def error_summary(s, d):
    return P.error_summary(_errors(s, d))[0]


def latest_errors(s, d):
    return P.error_summary(_errors(s, d))[1]


def indexing_report(s, d):
    out = M.indexing_report(table(s, d, "index_diagnostics"), table(s, d, "index_runs"))
    return out.withColumn("items_per_second", F.round("items_per_second", 6))


def format_measurement(s, d):
    c = F.col
    return table(s, d, "device_samples").select(
        "run_id", "seq",
        T.format_measurement(c("battery_temperature_c"), "C").alias("temperature"),
        T.format_bytes(c("available_ram_bytes")).alias("ram"),
        T.format_transfer_rate(c("app_pss_bytes")).alias("rate"),
        T.format_seconds(c("seq")).alias("seconds"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        latency_stats, backend_metrics, benchmark_rollup, outcomes, batch_outcomes, load_deltas, batch_capacity, pack_batches, pack_rejects, check_batches,
        batch_run_rollup, throughput_blocks, throughput_reasons, safety, sample_peaks, compact_samples, derive_energy, screen_energy, screen_readings, fastest,
        safe_report, report_omissions, error_summary, latest_errors, indexing_report, format_measurement,
    ]
}


def _outcome(batch: bool) -> str:
    safe = "('LOW_MEMORY', 'THERMAL_LIMIT'" + (", 'SAFETY_UNAVAILABLE')" if batch else ")")
    return f"""SELECT run_id, outcome, cancelled, failures, greatest(0, requested - completed - cancelled - failures) AS skipped FROM (SELECT *, CASE WHEN outcome = 'cancelled' THEN requested - completed ELSE 0 END AS cancelled,
      CASE WHEN outcome = 'error' THEN greatest(1, unreported) ELSE 0 END AS failures FROM (SELECT *, CASE WHEN error_code IS NULL THEN 'success' WHEN error_code = 'CANCELLED' THEN 'cancelled' WHEN error_code IN {safe} THEN 'safety-stop' ELSE 'error' END AS outcome FROM benchmark_runs))"""


def _blocks(src: str) -> str:
    return f"""cum AS (SELECT *, row_number() OVER w AS k, sum(completed) OVER w AS done, count(*) OVER (PARTITION BY run_id) AS n, sum(completed) OVER (PARTITION BY run_id) AS total FROM {src} WINDOW w AS (PARTITION BY run_id ORDER BY chunk_no)),
c1 AS (SELECT run_id, arg_min(k, (abs(done * 3 - total), k)) AS cut1 FROM cum WHERE n >= 3 AND k <= n - 2 GROUP BY run_id),
c2 AS (SELECT run_id, any_value(cut1) AS cut1, arg_min(k, (abs(done * 3 - total * 2), k)) AS cut2 FROM cum JOIN c1 USING (run_id) WHERE k > cut1 AND k <= n - 1 GROUP BY run_id)"""


def _derive(samples: str, suffix: str = "") -> str:
    def kind(k, col, top, unit, draw, least):
        return f"""CASE WHEN invalid IS NOT NULL THEN invalid WHEN {k}_bad THEN '{k}_unreliable' WHEN {k}_issue IS NOT NULL THEN '{k}_'||{k}_issue WHEN {k}_delta <= 0 THEN '{k}_no_decrease'
          WHEN {k}_drops < 10 OR {k}_step > {k}_delta / 10.0 OR {k}_delta < {least} THEN '{k}_too_coarse' END AS {k}_r0"""

    def agg(k, col, top, unit, draw, least):
        return f"""bool_or({col} IS NULL OR {col} <= 0 OR {col} > {top} OR {col} = 2147483647) AS {k}_bad,
          arg_min(CASE WHEN {col} > p_{k} THEN 'rose' ELSE 'implausible' END, seq) FILTER (WHERE dt > 0 AND ({col} > p_{k} OR (p_{k} - {col}) / {unit}.0::DOUBLE * 3600000.0 / dt > {draw})) AS {k}_issue,
          count(*) FILTER (WHERE p_{k} > {col}) AS {k}_drops, max(p_{k} - {col}) AS {k}_step, arg_min({col}, seq) - arg_max({col}, seq) AS {k}_delta"""

    kinds = [(k, *v) for k, v in E.KINDS.items()]
    used = ", ".join(f"CASE WHEN {k}_r0 IS NULL THEN {k}_delta / {v[2]}.0::DOUBLE END AS {k}_u0" for k, v in E.KINDS.items())
    return f"""lagged{suffix} AS (SELECT *, elapsed_realtime_ms - lag(elapsed_realtime_ms) OVER w AS dt, lag(charge_counter_uah) OVER w AS p_charge, lag(energy_counter_nwh) OVER w AS p_energy FROM {samples} WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
judged{suffix} AS (SELECT *, CASE WHEN plugged IS DISTINCT FROM false OR status IS DISTINCT FROM 3 THEN 'not_discharging' WHEN current_now_ua > 0 AND current_now_ua <= 20000000 THEN 'positive_current' WHEN elapsed_realtime_ms < 0 OR dt <= 0 THEN 'time_not_increasing' END AS inv FROM lagged{suffix}),
per{suffix} AS (SELECT run_id, count(*) AS n, arg_min(inv, seq) FILTER (WHERE inv IS NOT NULL) AS first_inv, arg_max(elapsed_realtime_ms, seq) - arg_min(elapsed_realtime_ms, seq) AS win, {', '.join(agg(*k) for k in kinds)} FROM judged{suffix} GROUP BY run_id),
why{suffix} AS (SELECT *, {', '.join(kind(*k) for k in kinds)} FROM (SELECT r.run_id, completed, total_tokens, unreported, p.* EXCLUDE (run_id), coalesce(first_inv, CASE WHEN coalesce(n, 0) < 3 THEN 'too_few_samples' WHEN win < 60000 THEN 'window_too_short' END) AS invalid FROM benchmark_runs r LEFT JOIN per{suffix} p USING (run_id))),
used{suffix} AS (SELECT *, coalesce(energy_u0 / charge_u0 < 2 OR energy_u0 / charge_u0 > 20, false) AS odd FROM (SELECT *, {used} FROM why{suffix})),
est{suffix} AS (SELECT run_id, unreported, cu AS charge_consumed_mah, eu AS energy_consumed_mwh, cu * 100 / nullif(completed, 0) AS mah_per_100_documents, eu * 100 / nullif(completed, 0) AS mwh_per_100_documents, eu * 1000 / nullif(total_tokens, 0) AS mwh_per_1000_tokens,
  cr AS charge_reason, er AS energy_reason, CASE WHEN odd THEN 'inconsistent_counters' WHEN invalid IS NOT NULL THEN invalid ELSE nullif(concat_ws(' ', cr, er, CASE WHEN completed > 0 THEN NULL ELSE 'no_completed_documents' END, CASE WHEN total_tokens > 0 THEN NULL ELSE 'no_tokens' END), '') END AS reason,
  CASE WHEN cu IS NOT NULL OR eu IS NOT NULL THEN 'counter-estimate' ELSE 'unavailable' END AS confidence
  FROM (SELECT *, CASE WHEN NOT odd THEN charge_u0 END AS cu, CASE WHEN NOT odd THEN energy_u0 END AS eu, CASE WHEN odd THEN 'inconsistent_counters' ELSE charge_r0 END AS cr, CASE WHEN odd THEN 'inconsistent_counters' ELSE energy_r0 END AS er FROM used{suffix}))"""


def _compact(limit: int) -> str:
    return f"""cs AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS idx, n - 1 AS m, CASE {' '.join(f'WHEN (n - 1) // {2**j} + 1 + CASE WHEN (n - 1) % {2**j} <> 0 THEN 1 ELSE 0 END <= {limit} THEN {2**j}' for j in range(16))} END AS stride
   FROM device_samples s JOIN (SELECT run_id, count(*) AS n FROM device_samples GROUP BY 1) USING (run_id)) WHERE idx % stride = 0 OR idx = m)"""


def _void(k: str, col: str, top: int, per_hour: int) -> str:
    return f"bool_or(NOT bad AND ({col} IS NULL OR {col} <= 0 OR {col} > {top} OR {col} = 2147483647 OR coalesce(dt <= 0 OR {col} > p_{k} OR (p_{k} - {col}) > dt * ({per_hour} / 3600000.0::DOUBLE), false))) AS {k}_void"


R6 = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
SANE = """CASE WHEN regexp_full_match(model, '[a-zA-Z0-9][a-zA-Z0-9 _().+\\-]*') THEN model END AS model, CASE WHEN regexp_full_match(model_id, '[a-zA-Z0-9][a-zA-Z0-9_.\\-]*(/[a-zA-Z0-9][a-zA-Z0-9_.\\-]*)?') THEN model_id END AS model_id,
  CASE WHEN code = 'java.lang.Error' THEN 'OPERATION_FAILED' ELSE code END AS code, CASE WHEN reason = 'free text' THEN 'reason_omitted' ELSE reason END AS reason, CASE WHEN rss_bytes >= 0 THEN rss_bytes END AS rss_bytes, CASE WHEN mode = 'warm' THEN mode END AS mode"""
KEPT = f"""ag AS (SELECT lab_id, kind, at_ms, seq, {SANE}, row_number() OVER (PARTITION BY lab_id, kind ORDER BY at_ms DESC, seq DESC) AS age FROM lab_history),
sz AS (SELECT *, CASE WHEN kind = 'comparison' AND age = 1 THEN 4 WHEN kind = 'comparison' THEN 0 WHEN kind = 'benchmark' THEN 1 WHEN kind = 'load' THEN 2 ELSE 3 END AS tier,
  length('{{"kind":"'||kind||'","at_ms":'||at_ms||coalesce(',"model":"'||model||'"', '')||coalesce(',"model_id":"'||model_id||'"', '')||coalesce(',"code":"'||code||'"', '')||coalesce(',"reason":"'||reason||'"', '')||coalesce(',"rss_bytes":'||rss_bytes, '')||coalesce(',"mode":"'||mode||'"', '')||'}}') AS size
  FROM ag WHERE age <= CASE kind WHEN 'error' THEN 50 WHEN 'comparison' THEN 10 ELSE 20 END),
kept AS (SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY lab_id ORDER BY tier DESC, age ROWS UNBOUNDED PRECEDING) AS upto FROM sz) WHERE upto <= 3000)"""

ORACLES = {
    "latency_stats": with_ctes(
        ["attempts"],
        """SELECT provider, model, count(*) AS count, bool_or(ms < 0) AS invalid, CAST(sum(ms) AS BIGINT) AS total, round(avg(ms), 6) AS mean, quantile_cont(ms, 0.5) AS median, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95
        FROM (SELECT *, last_token_at - first_token_at AS ms FROM attempts WHERE last_token_at IS NOT NULL AND first_token_at IS NOT NULL) GROUP BY 1, 2""",
    ),
    "backend_metrics": with_ctes(
        ["search_times"],
        "SELECT mode, scale, count(*) AS runs, CAST(quantile_disc(duration_ms, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS DOUBLE) AS p95_ms, min(candidates) AS min_candidates, max(candidates) AS max_candidates FROM search_times GROUP BY 1, 2",
    ),
    "benchmark_rollup": with_ctes(
        ["benchmark_runs", "run_items", "device_samples"],
        """SELECT r.run_id, round(inf, 6) AS inference_only_ms, round(CASE WHEN elapsed_ms - inf < 0 THEN 0 ELSE elapsed_ms - inf END, 6) AS non_inference_ms, CASE WHEN elapsed_ms > 0 THEN round(completed * 1000 / elapsed_ms, 6) END AS documents_per_second,
        CASE WHEN inf > 0 THEN round(completed * 1000 / inf, 6) END AS inference_documents_per_second, CASE WHEN elapsed_ms > 0 THEN round(total_tokens * 1000 / elapsed_ms, 6) END AS tokens_per_second,
        CASE WHEN inf > 0 THEN round(total_tokens * 1000 / inf, 6) END AS inference_tokens_per_second, warm AS warm_inferences, cold AS cold_inferences, peak AS sample_peak_pss_bytes
        FROM benchmark_runs r JOIN (SELECT run_id, sum(inference_ms) AS inf, count(*) FILTER (WHERE warm) AS warm, count(*) FILTER (WHERE NOT warm) AS cold FROM run_items GROUP BY 1) USING (run_id)
        JOIN (SELECT run_id, max(app_pss_bytes) AS peak FROM device_samples GROUP BY 1) USING (run_id)""",
    ),
    "outcomes": with_ctes(["benchmark_runs"], _outcome(False)),
    "batch_outcomes": with_ctes(["benchmark_runs"], _outcome(True)),
    "load_deltas": with_ctes(["loads"], "SELECT event_id, pss_after - pss_before AS observed_pss_delta_bytes FROM loads"),
    "batch_capacity": with_ctes(
        ["sizing"],
        """SELECT p_partkey, target, ms AS max_sequences, mt AS max_tokens, cap AS capacity, least(target, cap, count) AS chunk_size, opt AS optional, cap = 0 OR (opt AND cap < target) AS skipped, CASE WHEN cap = 0 OR (opt AND cap < target) THEN CASE WHEN actual_tokens > n_ctx_seq THEN 'input_exceeds_context' WHEN cap = 0 THEN 'no_sequence_fits' ELSE 'target_exceeds_capacity' END END AS skip_reason, target * actual_tokens AS required_tokens, CASE WHEN backend_max_parallel_sequences IS NULL THEN 'BATCH_LIMITS_UNAVAILABLE' END AS reject_code
        FROM (SELECT *, CASE WHEN actual_tokens <= n_ctx_seq THEN least(ms, mt // actual_tokens) ELSE 0 END AS cap FROM (SELECT *, least(target, max_parallel_sequences, coalesce(backend_max_parallel_sequences, 1000)) AS ms, least(4096, n_batch, n_ubatch, n_ctx) AS mt,
          (size = '128' AND target = 50) OR (size = '256' AND target = 20) OR (size = 'near512' AND target = 10) AS opt
          FROM (SELECT *, unnest(CASE size WHEN 'short' THEN [1, 2, 5, 10, 20, 50, 100] WHEN '128' THEN [1, 2, 5, 10, 20, 50] WHEN '256' THEN [1, 2, 5, 10, 20] ELSE [1, 2, 5, 10] END) AS target FROM sizing)))""",
    ),
    "pack_batches": with_ctes(
        ["pack_docs"],
        """SELECT d.request_id, d.position, d.tokens, w.pack FROM walk w JOIN good d ON d.request_id = w.request_id AND d.n = w.n""",
        recursive=True,
        extra="""good AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position) AS n FROM pack_docs WHERE tokens <= 512),
walk AS (SELECT request_id, n, 0 AS pack, 1 AS seqs, tokens AS used FROM good WHERE n = 1 UNION ALL
  SELECT g.request_id, g.n, CASE WHEN w.seqs >= 16 OR w.used + g.tokens > 2048 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.seqs >= 16 OR w.used + g.tokens > 2048 THEN 1 ELSE w.seqs + 1 END,
    CASE WHEN w.seqs >= 16 OR w.used + g.tokens > 2048 THEN g.tokens ELSE w.used + g.tokens END FROM walk w JOIN good g ON g.request_id = w.request_id AND g.n = w.n + 1)""",
    ),
    "pack_rejects": with_ctes(["pack_docs"], "SELECT request_id, position, tokens, 'INPUT_TOO_LONG' AS reject_code FROM pack_docs WHERE tokens > 512"),
    "check_batches": with_ctes(
        ["batch_results"],
        """SELECT batch_id, CASE WHEN bad OR seq <> item_count OR tok <> total_tokens OR n <> native_decode_count OR mx <> effective_batch_size OR abs(ms - native_decode_ms) > greatest(0.01, ms * 1e-6)
          OR native_decode_ms + preparation_ms > total_elapsed_ms + 0.01 THEN 'INVALID_BATCH_METRICS' END AS reject_code FROM batch_results JOIN
        (SELECT batch_id, count(*) AS n, sum(sequences) AS seq, sum(tokens) AS tok, sum(native_decode_ms) AS ms, max(sequences) AS mx, bool_or(sequences NOT BETWEEN 1 AND 8 OR tokens NOT BETWEEN 1 AND 128) AS bad FROM decodes GROUP BY 1) USING (batch_id)""",
    ),
    "batch_run_rollup": with_ctes(
        ["batch_results", "chunks"],
        """SELECT r.*, elapsed_ms, round(completed / native_decode_count, 4) AS mean_sequences_per_decode, round(total_tokens / native_decode_count, 4) AS mean_tokens_per_decode, round(elapsed_ms / completed, 4) AS effective_ms_per_document,
        CASE WHEN elapsed_ms > 0 THEN round(completed * 1000 / elapsed_ms, 4) END AS documents_per_second, CASE WHEN elapsed_ms > 0 THEN round(total_tokens * 1000 / elapsed_ms, 4) END AS tokens_per_second
        FROM (SELECT run_id, CAST(sum(item_count) AS BIGINT) AS completed, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(native_decode_count) AS BIGINT) AS native_decode_count, max(effective_batch_size) AS effective_batch_size,
          round(sum(native_decode_ms), 4) AS native_decode_ms, round(sum(total_elapsed_ms), 4) AS native_elapsed_ms, round(sum(preparation_ms), 4) AS preparation_ms FROM batch_results GROUP BY 1) r
        LEFT JOIN (SELECT run_id, max(end_ms) - min(start_ms) AS elapsed_ms FROM chunks GROUP BY 1) USING (run_id)""",
    ),
    "throughput_blocks": with_ctes(
        ["chunks"],
        """SELECT run_id, phase, start_ms, end_ms, completed, total_tokens, end_ms - start_ms AS elapsed_ms, CASE WHEN end_ms > start_ms THEN round(completed * 1000 / (end_ms - start_ms), 6) END AS documents_per_second,
        CASE WHEN end_ms > start_ms THEN round(total_tokens * 1000 / (end_ms - start_ms), 6) END AS tokens_per_second FROM (SELECT run_id, CASE WHEN k <= cut1 THEN 'initial' WHEN k <= cut2 THEN 'middle' ELSE 'final' END AS phase,
          arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM cum JOIN c2 USING (run_id) GROUP BY 1, 2)""",
        extra=_blocks("chunks"),
    ),
    "throughput_reasons": with_ctes(["chunks"], "SELECT run_id||'-'||(chunk_no // 40) AS run_id, 'too_few_chunks' AS throughput_reason FROM chunks GROUP BY 1 HAVING count(*) < 3"),
    "safety": with_ctes(
        ["device_samples"],
        """SELECT run_id, seq, CASE WHEN low_memory OR available_ram_bytes < greatest(threshold_bytes + 268435456, 536870912) THEN 'LOW_MEMORY' WHEN thermal_status >= 3 OR battery_temperature_c >= 42 THEN 'THERMAL_LIMIT'
        WHEN low_memory IS NULL OR available_ram_bytes IS NULL OR thermal_status IS NULL OR battery_temperature_c IS NULL THEN 'SAFETY_UNAVAILABLE' END AS safety FROM device_samples""",
    ),
    "sample_peaks": with_ctes(
        ["device_samples"],
        """SELECT run_id, count(*) AS sample_count, max(app_pss_bytes) AS peak_pss_bytes, max(native_heap_bytes) AS peak_native_heap_bytes, max(java_heap_bytes) AS peak_java_heap_bytes, max(battery_temperature_c) AS peak_temperature_c, max(thermal_status) AS peak_thermal, min(available_ram_bytes) AS minimum_available_ram_bytes,
        first(battery_temperature_c ORDER BY seq) AS initial_temperature_c, last(battery_temperature_c ORDER BY seq) AS final_temperature_c, first(thermal_status ORDER BY seq) AS initial_thermal, last(thermal_status ORDER BY seq) AS final_thermal
        FROM device_samples GROUP BY run_id""",
    ),
    "compact_samples": with_ctes(["device_samples"], "SELECT run_id, seq, idx, stride FROM cs", extra=_compact(16)),
    "derive_energy": with_ctes(["device_samples", "benchmark_runs"], f"SELECT run_id, {R6(ENERGY)}, {', '.join(REASONS)} FROM est", extra=_derive("device_samples")),
    "screen_energy": with_ctes(
        ["device_samples", "benchmark_runs"],
        f"""SELECT run_id, {R6(ENERGY)}, charge_reason, energy_reason, CASE WHEN unreported > 0 THEN concat_ws(' ', r, 'unreported_work') ELSE r END AS reason, CASE WHEN charge_consumed_mah IS NOT NULL OR energy_consumed_mwh IS NOT NULL THEN 'counter-estimate' ELSE 'unavailable' END AS confidence
        FROM (SELECT e.run_id, unreported, CASE WHEN NOT (voided OR charge_void) THEN charge_consumed_mah END AS charge_consumed_mah, CASE WHEN NOT (voided OR energy_void) THEN energy_consumed_mwh END AS energy_consumed_mwh,
          CASE WHEN NOT (voided OR charge_void OR unreported > 0) THEN mah_per_100_documents END AS mah_per_100_documents, CASE WHEN NOT (voided OR energy_void OR unreported > 0) THEN mwh_per_100_documents END AS mwh_per_100_documents,
          CASE WHEN NOT (voided OR energy_void OR unreported > 0) THEN mwh_per_1000_tokens END AS mwh_per_1000_tokens, CASE WHEN voided THEN 'unreliable_window' WHEN charge_void THEN 'charge_window_invalid' ELSE charge_reason END AS charge_reason,
          CASE WHEN voided THEN 'unreliable_window' WHEN energy_void THEN 'energy_window_invalid' ELSE energy_reason END AS energy_reason,
          CASE WHEN voided THEN 'unreliable_window' WHEN charge_void OR energy_void THEN nullif(concat_ws(' ', CASE WHEN charge_void THEN 'charge_window_invalid' ELSE charge_reason END, CASE WHEN energy_void THEN 'energy_window_invalid' ELSE energy_reason END), '') ELSE reason END AS r
          FROM est e JOIN seen USING (run_id))""",
        extra=_compact(64) + ",\n" + _derive("cs") + f""",
rl AS (SELECT *, plugged IS DISTINCT FROM false OR status IS DISTINCT FROM 3 OR coalesce(current_now_ua > 0, false) AS bad, elapsed_realtime_ms - lag(elapsed_realtime_ms) OVER w AS dt, lag(charge_counter_uah) OVER w AS p_charge, lag(energy_counter_nwh) OVER w AS p_energy FROM device_samples WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
seen AS (SELECT run_id, bool_or(bad) AS voided, {_void('charge', 'charge_counter_uah', 100_000_000, 10_000 * 1_000)}, {_void('energy', 'energy_counter_nwh', 1_000_000_000_000, 50_000 * 1_000_000)} FROM rl GROUP BY run_id)""",
    ),
    "screen_readings": with_ctes(
        ["raw_readings"],
        """SELECT event_id, CASE WHEN charge_counter_uah BETWEEN 1 AND 100000000 THEN charge_counter_uah END AS charge_counter_uah, CASE WHEN current_now_ua <> 0 AND abs(current_now_ua) <= 20000000 THEN current_now_ua END AS current_now_ua,
        CASE WHEN current_average_ua <> 0 AND abs(current_average_ua) <= 20000000 THEN current_average_ua END AS current_average_ua, CASE WHEN energy_counter_nwh BETWEEN 1 AND 1000000000000 AND energy_counter_nwh <> 2147483647 THEN energy_counter_nwh END AS energy_counter_nwh,
        CASE WHEN plugged_flags BETWEEN 0 AND 15 THEN plugged_flags <> 0 END AS plugged, CASE WHEN status BETWEEN 1 AND 5 THEN status END AS status FROM raw_readings""",
    ),
    "fastest": with_ctes(
        ["tier_runs"],
        """SELECT comparison_id, CASE WHEN bool_and(coalesce(ok, false)) AND count(*) >= 2 AND count(DISTINCT limits_key) = 1 AND max(CASE WHEN place = 1 THEN alike END) = 1 AND max(CASE WHEN place = 1 THEN documents_per_second END) > max(CASE WHEN place = 2 THEN documents_per_second END) * 1.1
          THEN max(CASE WHEN place = 1 THEN target END) END AS fastest_target FROM (SELECT *, outcome = 'success' AND error_code IS NULL AND completed = requested AND unreported = 0 AND abs(tokens_per_second - documents_per_second * actual_tokens) < 0.001 AND gate_passed AS ok,
          row_number() OVER (PARTITION BY comparison_id ORDER BY documents_per_second DESC, target) AS place, count(*) OVER (PARTITION BY comparison_id, mode, effective_batch_size, capacity) AS alike FROM tier_runs WHERE outcome <> 'skipped') GROUP BY 1""",
    ),
    "safe_report": with_ctes(["lab_history"], "SELECT lab_id, kind, at_ms, seq, model, model_id, code, reason, rss_bytes, mode FROM kept", extra=KEPT),
    "report_omissions": with_ctes(
        ["lab_history"],
        "SELECT lab_id, kind, count(*) AS total, count(*) - (SELECT count(*) FROM kept k WHERE k.lab_id = h.lab_id AND k.kind = h.kind) AS omitted FROM lab_history h GROUP BY lab_id, kind",
        extra=KEPT,
    ),
    "error_summary": with_ctes(
        ["lab_history"], "SELECT lab_id, CASE WHEN code = 'java.lang.Error' THEN 'OPERATION_FAILED' ELSE code END AS code, count(*) AS errors FROM lab_history WHERE kind = 'error' GROUP BY 1, 2"
    ),
    "latest_errors": with_ctes(
        ["lab_history"],
        "SELECT lab_id, arg_max(CASE WHEN code = 'java.lang.Error' THEN 'OPERATION_FAILED' ELSE code END, (at_ms, seq)) AS latest_code, max(at_ms) AS latest_at FROM lab_history WHERE kind = 'error' GROUP BY 1",
    ),
    "indexing_report": with_ctes(
        ["index_diagnostics", "index_runs"],
        """SELECT r.*, (SELECT CAST(coalesce(sum(coalesce(duration_ms, 0)), 0) AS BIGINT) FROM index_diagnostics d WHERE d.run_id = r.run_id AND event = 'lexical_ready') AS admission_lexical_ms, round(ready * 1000 / greatest(1, end_to_end_ms), 6) AS items_per_second FROM index_runs r""",
    ),
    "format_measurement": with_ctes(
        ["device_samples"],
        """SELECT run_id, seq, printf('%.2f', battery_temperature_c)||' C' AS temperature, CASE WHEN available_ram_bytes IS NULL THEN 'unavailable' ELSE printf('%.2f', available_ram_bytes / 1048576.0 + CASE WHEN (available_ram_bytes * 1000) % 10485760 = 5242880 THEN 1e-9 ELSE 0 END)||' MiB ('||available_ram_bytes||' bytes)' END AS ram,
        printf('%.3f', app_pss_bytes / 1000000.0)||' MB/s' AS rate, printf('%.2f', seq / 1000.0 + CASE WHEN seq % 250 = 125 THEN 1e-9 ELSE 0 END)||' s' AS seconds FROM device_samples""",
    ),
}
