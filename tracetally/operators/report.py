"""Whitelisted measurement reports: masking, retention, size budget, error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measure import is_finite

ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LABEL_MARKS, PART_MARKS = " _().+-", "_.-"
LONGEST = 160
MAX_REPORT = 1024 * 1024
RETAIN = {"benchmark": 20, "load": 20, "error": 50, "comparison": 10}
# Error codes that may appear in a report; any other becomes OPERATION_FAILED.
KNOWN_CODES = """
CANCELLED NOT_LOADED MODEL_NOT_LOADED MODEL_NOT_INSTALLED NO_MODEL EMPTY_INPUT INPUT_TOO_LONG INVALID_ARGUMENT INVALID_PATH UNSAFE_PATH
INVALID_MODEL MODEL_LOAD_FAILED NATIVE_INIT_FAILED NATIVE_ERROR BRIDGE_ERROR INFERENCE_FAILED TOKENIZATION_FAILED OUT_OF_MEMORY HASH_MISMATCH
SIZE_MISMATCH FILE_CHANGED INSUFFICIENT_STORAGE STORAGE_UNAVAILABLE STORAGE_IO DELETE_FAILED METADATA_IO METADATA_RECOVERED NETWORK_IO HTTP_ERROR
HTTP_ENCODING HTTP_SIZE DOWNLOAD_INCOMPLETE UNSAFE_REDIRECT TOO_MANY_REDIRECTS DOWNLOAD_FAILED VERIFICATION_FAILED INSTALL_FAILED INTERRUPTED BUSY
QUEUE_FULL UNSUPPORTED_PLATFORM COLD_REQUIRES_UNLOADED CONFIRM_REQUIRED LOW_MEMORY THERMAL_LIMIT INVALID_VECTOR TOKEN_SIZING INVALID_BENCHMARK
BATCH_UNAVAILABLE BATCH_LIMITS_UNAVAILABLE BATCH_CAPACITY INVALID_BATCH_METRICS BATCH_CORRECTNESS SAFETY_UNAVAILABLE UNAVAILABLE OPERATION_FAILED
""".split()
# The reasons our own operators produce; nothing else may appear as a reason.
KNOWN_REASONS = """
not_discharging positive_current time_not_increasing too_few_samples window_too_short charge_unreliable energy_unreliable charge_rose energy_rose
charge_implausible energy_implausible charge_no_decrease energy_no_decrease charge_too_coarse energy_too_coarse inconsistent_counters
no_completed_documents no_tokens unreliable_window charge_window_invalid energy_window_invalid unreported_work too_few_chunks
""".split()


def number(x: Column) -> Column:
    """A finite number or NULL."""
    return F.when(is_finite(x), x)


def byte_count(x: Column) -> Column:
    return F.when(is_finite(x) & (x >= 0), x)


def made_of(x: Column, marks: str) -> Column:
    """Only ASCII letters, digits and the given marks, and no mark in front."""
    drop = lambda v, chars: F.translate(v, chars, "")
    return (F.length(x) > 0) & (drop(x, ALNUM + marks) == "") & (drop(F.substring(x, 1, 1), ALNUM) == "")


def label(x: Column) -> Column:
    """Plain metadata text: no paths, URLs, control or non-ASCII characters."""
    return F.when(made_of(x, LABEL_MARKS) & (F.length(x) <= LONGEST), x)


def identifier(x: Column) -> Column:
    """One or two plain parts with a slash between them."""
    parts = F.split(x, "/", -1)
    plain = F.forall(parts, lambda p: made_of(p, PART_MARKS)) & (F.size(parts) <= 2)
    return F.when(plain & (F.length(x) <= LONGEST) & ~x.contains(".."), x)


def choice(x: Column, allowed: list[str]) -> Column:
    return F.when(x.isin(allowed), x)


def error_code(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(x.isin(KNOWN_CODES), x).otherwise("OPERATION_FAILED"))


def reason(x: Column) -> Column:
    """Known reasons, alone or space-joined; anything else is replaced."""
    parts = F.split(x, " ")
    ok = F.forall(parts, lambda p: p.isin(KNOWN_REASONS))
    return F.when(x.isNotNull(), F.when(ok & (F.length(x) <= 2048), x).otherwise("reason_omitted"))


def safe_report(history: DataFrame, masks: dict[str, Column], budget: int = MAX_REPORT) -> tuple[DataFrame, DataFrame]:
    """(rows, omissions) of one report per lab.

    ``history``: lab_id, kind (benchmark, load, error, comparison), at_ms, seq and any
    fields; only the masked fields leave. The newest rows of each kind are kept
    within the retention limits; then whole rows are dropped until the JSON text
    fits the budget: all comparisons but the newest, benchmarks, loads, errors,
    the last comparison, oldest first.
    """
    newest = Window.partitionBy("lab_id", "kind").orderBy(F.desc("at_ms"), F.desc("seq"))
    deepest = max(RETAIN.values())
    keep = F.lit(0)
    for kind, n in RETAIN.items():
        keep = F.when(F.col("kind") == kind, n).otherwise(keep)
    rows = history.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= deepest).filter(F.col("age") <= keep)
    rows = rows.select("lab_id", "kind", "at_ms", "seq", "age", *[c.alias(n) for n, c in masks.items()])
    rows = rows.withColumn("size", F.length(F.to_json(F.struct("kind", "at_ms", *masks))))
    # larger = dropped later
    tier = (
        F.when((F.col("kind") == "comparison") & (F.col("age") == 1), 4)
        .when(F.col("kind") == "comparison", 0)
        .when(F.col("kind") == "benchmark", 1)
        .when(F.col("kind") == "load", 2)
        .otherwise(3)
    )
    importance = Window.partitionBy("lab_id").orderBy(F.desc(tier), "age").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(importance)).filter(F.col("upto") <= budget)
    kept = rows.select("lab_id", "kind", "at_ms", "seq", "size", *masks)
    totals = history.groupBy("lab_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    shown = kept.groupBy("lab_id", "kind").agg(F.count(F.lit(1)).alias("shown"))
    omitted = totals.join(shown, ["lab_id", "kind"], "left").select("lab_id", "kind", "total", (F.col("total") - F.coalesce("shown", F.lit(0))).alias("omitted"))
    return kept, omitted


def error_summary(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts per lab and code, latest error per lab). ``errors``: lab_id, code, at_ms, seq."""
    safe = errors.select("lab_id", error_code(F.col("code")).alias("code"), "at_ms", "seq").filter(F.col("code").isNotNull())
    counts = safe.groupBy("lab_id", "code").agg(F.count(F.lit(1)).alias("errors"))
    latest = safe.groupBy("lab_id").agg(F.max_by("code", F.struct("at_ms", "seq")).alias("latest_code"), F.max("at_ms").alias("latest_at"))
    return counts, latest
