"""Structured Streaming forms of the event folds, with their batch twins.

Events may arrive in any order and any time late: nothing is dropped by a clock. A fold that
depends on event order appends every micro-batch to a log and computes the keys it touched anew;
counts are kept as partial sums per micro-batch and added up when read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import cut, shared_folder
from ..operators import index as X

TERMINAL = ["completed", "failed", "cancelled", "interrupted"]
LOG_BUCKETS = 64  # folders of an event log; a micro-batch reads back those of its keys


# ---- running a stream to its end ----------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the one all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a sink over everything available now."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version per key."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def settle(stream: DataFrame, keys: list[str] | None, mode: str = "update") -> DataFrame:
    """Process everything available now and return the newest row per key (or all rows).

    Each micro-batch overwrites only its own output folder, so a repeated batch
    changes nothing.
    """
    out = work_folder(stream.sparkSession)
    drain(stream, out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}"), mode)
    rows = stream.sparkSession.read.parquet(f"{out}/rows")
    return rows.drop("batch_id") if keys is None else newest(rows, keys, "batch_id")


def refold(stream: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch fold of all events of each key, kept up to date batch by batch.

    Events go to a log laid out by bucket of the key. Only the keys of a micro-batch are folded
    again, from all of their events so far, so the order of arrival has no effect.
    """
    spark, out = stream.sparkSession, work_folder(stream.sparkSession)
    bucket = F.pmod(F.hash(key), F.lit(LOG_BUCKETS))

    def sink(batch: DataFrame, n: int) -> None:
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/log/batch={n}")
        log = spark.read.option("basePath", f"{out}/log").parquet(f"{out}/log").filter(F.col("batch") <= n)
        touched = log.filter(F.col("batch") == n)
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most LOG_BUCKETS
        events = log.filter(F.col("bucket").isin(buckets)).join(touched.select(key).distinct(), key, "left_semi")
        fold(events.select(*batch.columns)).write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}")

    drain(stream, out, sink)
    return newest(spark.read.parquet(f"{out}/rows"), [key], "batch_id")


def add_up(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Partial sums of every micro-batch, added up when read; no state is kept."""
    out = work_folder(stream.sparkSession)
    drain(stream, out, lambda batch, n: partial(batch).write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}"))
    rows = stream.sparkSession.read.parquet(f"{out}/rows")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "batch_id")])


def read_stream(spark: SparkSession, folder: str, name: str, max_files: int = 1) -> DataFrame:
    """A Parquet file or files of a folder as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", max_files).parquet(folder)


# ---- S1, S4: attempt timing and lifecycle -------------------------------


def attempt_fold(events: DataFrame) -> DataFrame:
    """Streaming fold of attempt events (attempt_id, event, at_ms, seq, http_status), run to the end."""
    return refold(events, "attempt_id", attempt_fold_batch)


def attempt_fold_batch(events: DataFrame) -> DataFrame:
    """Batch twin: everything up to each attempt's first terminal event."""
    here = F.struct("at_ms", "seq")
    ends = events.filter(F.col("event").isin(TERMINAL)).groupBy(F.col("attempt_id").alias("e_id")).agg(F.min(here).alias("end"))
    live = events.join(ends, F.col("attempt_id") == F.col("e_id"), "left").filter(F.col("end").isNull() | (here <= F.col("end")))
    when = lambda kind, c="at_ms": F.when(F.col("event") == kind, F.col(c))
    done = F.col("event").isin(TERMINAL)
    moves = F.when(~(F.col("event").isin("started", "response")), F.col("event"))
    out = live.groupBy("attempt_id").agg(
        F.coalesce(F.max_by(F.when(F.col("event") == "token", "streaming").otherwise(moves), F.when(moves.isNotNull(), here)), F.lit("connecting")).alias("status"),
        F.min(when("started")).alias("started_at"),
        F.max(when("response")).alias("response_received_at"),
        F.max_by("http_status", F.when((F.col("event") == "response") & F.col("http_status").isNotNull(), here)).alias("http_status"),
        F.min(when("token")).alias("first_token_at"),
        F.max(when("token")).alias("last_token_at"),
        F.max(F.when(done, F.col("at_ms"))).alias("completed_at"),
    )
    stage = F.when(F.col("completed_at").isNotNull() & (F.col("status") != "completed"), F.when(F.col("first_token_at").isNotNull(), "stream").otherwise("request"))
    return out.withColumn("failure_stage", stage)


# ---- S2: text ------------------------------------------------------------


def assembled_text(deltas: DataFrame) -> DataFrame:
    """Final text per generation from its ordered deltas (one model response each)."""
    parts = F.array_sort(F.collect_list(F.struct("at_ms", "seq", "delta")))
    return deltas.groupBy("generation_id").agg(F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"), F.count(F.lit(1)).alias("deltas"))


# ---- S3, S5, S6, S7 ------------------------------------------------------


def terminal_once(events: DataFrame, key: str = "attempt_id") -> DataFrame:
    """One terminal event of each key, however late others arrive; the state is one row per key."""
    return events.filter(F.col("event").isin(TERMINAL)).dropDuplicates([key])


CORRELATION = ["session_id", "turn_id"]


def tool_fold(events: DataFrame) -> DataFrame:
    """One row per tool invocation from its events; the same aggregation runs batch or streaming.

    ``events``: invocation_id, type, at_ms, tool_name, decision, status, failure_stage and
    the correlation ids; an invocation that carries two values of one id conflicts.
    """
    at = lambda kind: F.max(F.when(F.col("type") == kind, F.col("at_ms")))
    of = lambda c, kind: F.max_by(c, F.when(F.col("type") == kind, F.col("at_ms")))
    conflict = F.lit(False)
    for c in CORRELATION:
        conflict = conflict | F.coalesce(F.min(c) != F.max(c), F.lit(False))
    out = events.groupBy("invocation_id").agg(
        F.max("tool_name").alias("tool_name"),
        *[F.min(c).alias(c) for c in CORRELATION],
        conflict.alias("conflicting_correlation"),
        at("invocation_started").alias("started_at"),
        of("decision", "authorization_decided").alias("decision"),
        at("execution_started").alias("execution_started_at"),
        at("invocation_finished").alias("finished_at"),
        of("status", "invocation_finished").alias("status"),
        of("failure_stage", "invocation_finished").alias("failure_stage"),
    )
    took = F.col("finished_at") - F.col("started_at")
    return out.withColumn("duration_ms", F.when(took < 0, 0).otherwise(took))


def diagnostics_windows(events: DataFrame) -> DataFrame:
    """Counts and durations per minute, event and code (event time ``ts``)."""
    return events.groupBy(F.window("ts", "1 minute").alias("w"), "event", "code").agg(
        F.count(F.lit(1)).alias("events"), F.sum("duration_ms").alias("duration_ms")
    ).select(F.unix_millis("w.start").alias("minute_ms"), "event", "code", "events", "duration_ms")


def recent(events: DataFrame, order: list[str], limit: int = 200) -> DataFrame:
    """The newest events, for display; Spark keeps ``limit`` rows per partition."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(limit)


def running_gauge(events: DataFrame) -> DataFrame:
    """Unfinished work per session."""
    change = F.when(F.col("type") == "work_started", 1).when(F.col("type") == "work_finished", -1).otherwise(0)
    return events.groupBy("session_id").agg(F.sum(change).alias("running"))


# ---- S8: incremental indexing -------------------------------------------


def incremental_index(stream: DataFrame, folder: str, fingerprint: str, clock: Callable[[int], int], empty_items: DataFrame) -> None:
    """Validate, stage and project every micro-batch; only the rows it changes are written.

    Version n of a table holds the rows that micro-batch n changed; ``latest`` takes the newest per
    id. Items that share neither id nor source with the batch cannot be affected by it.
    """
    spark = stream.sparkSession

    def before(name: str, n: int, empty: DataFrame) -> DataFrame:
        if n == 0:
            return empty
        past = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").filter(F.col("version") < n)
        return newest(past, ["id"], "version").select(*empty.columns)

    def apply(batch: DataFrame, n: int) -> None:
        ok, bad = X.validate_items(batch)
        ids, owners = ok.select("id").distinct(), ok.select(*X.NATURAL).distinct()
        every = before("items", n, empty_items)
        near = every.join(ids, "id", "left_semi").unionByName(every.join(owners, X.NATURAL, "left_semi").join(ids, "id", "left_anti"))
        staged, rejects = X.stage(cut(near), cut(ok), fingerprint, clock(n), f"batch{n}")
        staged = cut(staged)
        pending = before("lexical", n, X.build_lexical(empty_items)).join(ids, "id", "left_semi")
        done, postings = X.index_lexical(staged, pending)
        done.join(ids, "id", "left_semi").write.mode("overwrite").parquet(f"{folder}/items/version={n}")
        postings.write.mode("overwrite").parquet(f"{folder}/lexical/version={n}")
        refused = bad.select("id", "seq", "reject_code").unionByName(rejects)
        refused.write.mode("overwrite").parquet(f"{folder}/rejects/version={n}")

    drain(stream, folder, apply)


def latest(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The newest row per id of a table written by ``incremental_index``."""
    return newest(spark.read.parquet(f"{folder}/{table}"), ["id"], "version")


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that ``incremental_index`` refused."""
    return spark.read.parquet(f"{folder}/rejects").drop("version")
