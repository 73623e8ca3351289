"""Measurements, formats and streams on hand-made cases."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracetally.functions import formats as T
from tracetally.operators import energy as E
from tracetally.operators import measure as M
from tracetally.operators import report as P
from tracetally.streaming import streams as S


def test_latency_statistics(spark):
    rows = [("a", float(i)) for i in range(1, 21)] + [("bad", 1.0), ("bad", -1.0)]
    got = {r.k: r for r in M.latency_stats(spark.createDataFrame(rows, "k string, ms double"), ["k"], "ms").collect()}
    assert (got["a"].p95, got["a"].median, got["a"].mean) == (19.0, 10.5, 10.5)
    assert got["bad"].invalid and got["bad"].p95 is None


def test_compaction_matches_the_online_rule(spark):
    def online(n, limit):
        stride, kept = 1, []
        for i in range(n):
            if kept and kept[-1] % stride:
                kept.pop()
            kept.append(i)
            while len(kept) > limit:
                stride *= 2
                kept = [k for k in kept if k % stride == 0 or k == i]
        return kept

    sizes = [1, 7, 8, 9, 15, 16, 17, 33, 100, 257]
    rows = [(f"r{n}", i * 3) for n in sizes for i in range(n)]
    out = M.compact_samples(spark.createDataFrame(rows, "run_id string, seq bigint"), 8, block_rows=50).collect()
    for n in sizes:
        assert sorted(r.idx for r in out if r.run_id == f"r{n}") == online(n, 8)


def test_throughput_cuts_match_the_greedy_rule(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for run in range(12):
        sizes = [rnd.randrange(1, 20) for _ in range(rnd.randrange(3, 40))]
        total, cuts, at, acc = sum(sizes), [], 0, 0
        for phase in range(2):
            to = at + 1
            s = acc + sizes[at]
            while to < len(sizes) - (2 - phase) and abs(s + sizes[to] - total * (phase + 1) / 3) < abs(s - total * (phase + 1) / 3):
                s += sizes[to]
                to += 1
            cuts.append(to)
            acc, at = s, to
        want[f"r{run}"] = [sum(sizes[: cuts[0]]), sum(sizes[cuts[0] : cuts[1]]), sum(sizes[cuts[1] :])]
        rows += [(f"r{run}", i, c, c * 10, i * 100, i * 100 + 90) for i, c in enumerate(sizes)]
    rows += [("short", 0, 1, 1, 0, 1), ("short", 1, 1, 1, 1, 2)]
    blocks, missing = M.throughput_blocks(spark.createDataFrame(rows, "run_id string, chunk_no bigint, completed bigint, total_tokens bigint, start_ms bigint, end_ms bigint"), block_rows=7)
    got = {}
    for r in blocks.collect():
        got.setdefault(r.run_id, {})[r.phase] = r.completed
    assert {k: [v["initial"], v["middle"], v["final"]] for k, v in got.items()} == want
    assert [r.run_id for r in missing.collect()] == ["short"]


SAMPLE = "run_id string, seq bigint, elapsed_realtime_ms bigint, charge_counter_uah bigint, energy_counter_nwh bigint, current_now_ua bigint, plugged boolean, status int"


def window(run, n=11, step=1_000, plugged=False, rise=False, current=-300):
    out = []
    for i in range(n):
        charge = 3_000_000 - i * step + (5_000 if rise and i == 5 else 0)
        out.append((run, i, i * 6_000, charge, 12_000_000_000 - i * step * 4_000, current, plugged, 3))
    return out


def test_energy(spark):
    rows = window("good") + window("charging", plugged=True) + window("few", n=2) + window("rise", rise=True) + window("current", current=5) + window("short", n=10)
    runs = spark.createDataFrame([(r, 100, 1_000, 0) for r in ("good", "charging", "few", "rise", "current", "short", "empty")], "run_id string, completed bigint, total_tokens bigint, unreported bigint")
    samples = spark.createDataFrame(rows, SAMPLE)
    est = E.derive_energy(samples, runs)
    got = {r.run_id: r for r in est.collect()}
    assert (got["good"].charge_consumed_mah, got["good"].energy_consumed_mwh, got["good"].mwh_per_1000_tokens, got["good"].reason) == (10.0, 40.0, 40.0, None)
    reasons = {k: v.reason for k, v in got.items()}
    assert reasons["charging"] == "not_discharging" and reasons["few"] == "too_few_samples" and reasons["current"] == "positive_current"
    assert reasons["short"] == "window_too_short" and reasons["empty"] == "too_few_samples"
    assert got["rise"].charge_reason == "charge_rose" and got["rise"].energy_consumed_mwh == 40.0
    screened = {r.run_id: r for r in E.screen_energy(est, samples, runs).collect()}
    assert screened["rise"].charge_reason == "charge_window_invalid" and screened["good"].charge_consumed_mah == 10.0


def test_whitelist(spark):
    rows = [("Pixel 8", "a/b", "LOW_MEMORY", "charge_rose energy_rose"), ("/etc/passwd", "a/../b", "boom", "free text"), ("x\n", "a/b\n", None, None)]
    df = spark.createDataFrame(rows, "l string, i string, c string, r string")
    got = [tuple(r) for r in df.select(P.label(F.col("l")), P.identifier(F.col("i")), P.error_code(F.col("c")), P.reason(F.col("r"))).collect()]
    assert got == [("Pixel 8", "a/b", "LOW_MEMORY", "charge_rose energy_rose"), (None, None, "OPERATION_FAILED", "reason_omitted"), (None, None, None, None)]


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 6])
def test_fixed_point_text_rounds_the_exact_value(spark, digits):
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(digits)
    xs = [0.0, 0.00035, 0.00025, 1.25, 2.5, 0.5, 1.005, 123456.789, 0.1 + 0.2, -1.25, 1e-9] + [round(rnd.uniform(0, 100), 5) for _ in range(300)] + [rnd.randrange(10**6) / 8 for _ in range(50)]
    got = [r.t for r in spark.createDataFrame([(x,) for x in xs], "x double").select(T.fixed(F.col("x"), digits).alias("t")).collect()]
    unit = Decimal(1).scaleb(-digits)
    for x, t in zip(xs, got):
        assert Decimal(t) == Decimal(x).quantize(unit, ROUND_HALF_UP), (x, t)


EVENT = "attempt_id string, event string, at_ms bigint, seq bigint, http_status bigint"


def split_stream(spark, batches, schema):
    """A stream that sees one file per micro-batch."""
    folder = tempfile.mkdtemp(prefix="/tmp/run-")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    st = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    return st.withColumn("ts", F.timestamp_millis("at_ms"))


def test_stream_over_several_batches_equals_batch(spark):
    batches = [
        [("a", "started", 1, 1, None), ("a", "response", 2, 2, 200), ("b", "started", 1, 3, None)],
        [("a", "token", 5, 5, None), ("a", "token", 4, 4, None), ("b", "failed", 6, 6, None)],
        [("a", "completed", 9, 8, None), ("a", "token", 8, 7, None), ("b", "token", 9, 9, None), ("c", "token", 1, 10, None)],
    ]
    live = S.attempt_fold(split_stream(spark, batches, EVENT))
    twin = S.attempt_fold_batch(spark.createDataFrame([r for b in batches for r in b], EVENT))
    cols = sorted(twin.columns)
    got = sorted(map(tuple, live.select(cols).collect()), key=str)
    assert got == sorted(map(tuple, twin.select(cols).collect()), key=str)
    rows = {r.attempt_id: r for r in twin.collect()}
    assert (rows["a"].first_token_at, rows["a"].last_token_at, rows["a"].status) == (4, 8, "completed")
    assert (rows["b"].failure_stage, rows["b"].first_token_at, rows["c"].status) == ("request", None, "streaming")


def test_late_events_are_not_lost(spark):
    """Events of one key days apart, the newest first: the stream gives what the batch twin gives."""
    day = 86_400_000
    batches = [
        [("a", "token", 9 * day, 5, None), ("b", "completed", 8 * day, 9, None)],
        [("a", "started", 1, 1, None), ("a", "completed", 10 * day, 6, None)],
        [("b", "token", 2, 2, None), ("a", "token", 2 * day, 3, None), ("a", "token", 11 * day, 7, None)],
    ]
    everything = spark.createDataFrame([r for b in batches for r in b], EVENT)
    live = S.attempt_fold(split_stream(spark, batches, EVENT))
    cols = sorted(live.columns)
    assert sorted(map(str, live.select(cols).collect())) == sorted(map(str, S.attempt_fold_batch(everything).select(cols).collect()))
    minutes = lambda df: df.withColumns({"code": F.lit("c"), "duration_ms": F.col("seq"), "ts": F.timestamp_millis("at_ms")})
    added = S.add_up(minutes(split_stream(spark, batches, EVENT)), S.diagnostics_windows, ["minute_ms", "event", "code"])
    assert added.agg(F.sum("events"), F.sum("duration_ms")).first()[:] == (7, 33)
    once = S.settle(S.terminal_once(split_stream(spark, batches, EVENT)).select("attempt_id"), None, "append")
    assert sorted(r.attempt_id for r in once.collect()) == ["a", "b"]


def test_large_requests_are_packed_whole(spark):
    docs = spark.createDataFrame([("r", i, 100 + i % 7) for i in range(5_000)] + [("s", 0, 600), ("s", 1, 5)], "request_id string, position long, tokens long")
    packed, rejects = M.pack_batches(docs, 16, 2048, 512)
    rows = sorted((r.position, r.tokens, r.pack) for r in packed.filter("request_id = 'r'").collect())
    pack, seqs, used = 0, 0, 0
    for position, tokens, got in rows:
        if seqs >= 16 or used + tokens > 2048:
            pack, seqs, used = pack + 1, 0, 0
        seqs, used = seqs + 1, used + tokens
        assert got == pack
    assert len(rows) == 5_000 and [tuple(r) for r in rejects.collect()] == [("s", 0, 600, "INPUT_TOO_LONG")]


def test_heap_peaks(spark):
    rows = [("r", 1, 10, 20, None, 30.0, 0, 9), ("r", 2, 12, 25, None, 31.5, 3, 7), ("r", 3, 11, None, None, 31.0, 1, 8)]
    cols = "run_id string, seq bigint, app_pss_bytes bigint, native_heap_bytes bigint, java_heap_bytes bigint, battery_temperature_c double, thermal_status bigint, available_ram_bytes bigint"
    samples = spark.createDataFrame(rows, cols)
    r = M.sample_peaks(samples).first()
    assert (r.peak_pss_bytes, r.peak_native_heap_bytes, r.peak_java_heap_bytes, r.minimum_available_ram_bytes) == (12, 25, None, 7)
    assert (r.initial_temperature_c, r.peak_temperature_c, r.final_temperature_c, r.initial_thermal, r.peak_thermal, r.final_thermal) == (30.0, 31.5, 31.0, 0, 3, 1)
    assert M.sample_peaks(samples.drop("native_heap_bytes")).first().peak_native_heap_bytes is None
