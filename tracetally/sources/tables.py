"""Reading, writing and maintaining the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import shuffled
from .schemas import SCHEMAS

SAFE_MAX = 2**53 - 1
TERMINAL = ["completed", "failed", "cancelled", "interrupted"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a fixed schema: absent columns become NULL, 0/1 becomes boolean."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with its fixed schema; JSON and Parquet folders are supported."""
    schema = SCHEMAS[name]
    path = f"{folder}/{name}"
    if fmt == "json":
        raw = T.StructType([T.StructField(f.name, T.IntegerType() if f.dataType == T.BooleanType() else f.dataType) for f in schema])
        return conform(spark.read.schema(raw).json(path), schema)
    return conform(spark.read.format(fmt).load(path), schema)


def write_snapshot(df: DataFrame, folder: str, name: str, version: str) -> str:
    """Write a new immutable snapshot folder; a retried job overwrites only its own version."""
    path = f"{folder}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: list[str], patch: bool = False) -> DataFrame:
    """Last write wins by ``order``. With ``patch`` each column keeps the newest non-NULL
    value: newest change first, then the stored value."""
    cols = [c for c in current.columns if c != key]
    rank = F.struct(*order)
    if patch:
        news = incoming.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"new_{c}") for c in cols])
        pick = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c))
    else:
        news = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("new"))
        pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c))
    return current.join(news, key, "full_outer").select(key, *[pick(c).alias(c) for c in cols])


def insert_missing(current: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append incoming rows whose key is not stored yet; the first of several wins."""
    cols = [c for c in current.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
    return current.unionByName(first.join(current, key, "left_anti"))


def append_immutable(
    current: DataFrame, incoming: DataFrame, key: str, rules: dict[str, Column], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(table, rejects). A key that is stored, by earlier runs or earlier in the batch, is
    'already_exists'; otherwise the first broken rule names the reject."""
    stored = current.select(F.col(key).alias("stored_key"))
    rule = F.lit(None).cast("string")
    for code, broken in reversed(rules.items()):
        rule = F.when(F.coalesce(broken, F.lit(False)), code).otherwise(rule)
    rank = F.struct(*order)
    rows = incoming.withColumn("_rule", rule)
    firsts = rows.filter(F.col("_rule").isNull()).groupBy(F.col(key).alias("first_key")).agg(F.min(rank).alias("_first"))
    rows = rows.join(firsts, F.col(key) == F.col("first_key"), "left").join(stored, F.col(key) == F.col("stored_key"), "left")
    exists = F.col("stored_key").isNotNull() | F.coalesce(rank > F.col("_first"), F.lit(False))
    rows = rows.withColumn("reject_code", F.when(exists, "already_exists").otherwise(F.col("_rule")))
    rows = rows.drop("_rule", "first_key", "_first", "stored_key")
    ok = rows.filter(F.col("reject_code").isNull()).select(*current.columns)
    return current.unionByName(ok), rows.filter(F.col("reject_code").isNotNull())


def unsafe(*names: str) -> Column:
    """True when one of the columns is negative or beyond the safe integer range."""
    return reduce(lambda a, b: a | b, [F.coalesce(~F.col(n).between(0, SAFE_MAX), F.lit(False)) for n in names])


def first_terminal(events: DataFrame, key: str, at: str, seq: str, status: str = "status") -> DataFrame:
    """The first terminal record of each key; later ones never replace it."""
    cols = [c for c in events.columns if c != key]
    done = events.filter(F.col(status).isin(TERMINAL))
    return done.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(at, seq)).alias("r")).select(key, "r.*")


def soft_delete(agents: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Set deleted_at once for the listed agents; earlier deletions keep their time."""
    hit = ids.select(F.col("agent_id").alias("gone")).distinct()
    deleted = F.when(F.col("gone").isNotNull(), F.coalesce("deleted_at", F.lit(at))).otherwise(F.col("deleted_at"))
    return agents.join(hit, F.col("agent_id") == F.col("gone"), "left").withColumn("deleted_at", deleted).drop("gone")


def integrity_report(calls: DataFrame, attempts: DataFrame, runs: DataFrame, agents: DataFrame) -> DataFrame:
    """One row per broken reference or context rule: (rule, id)."""

    def missing(rule, child, key, child_id, parent, parent_key):
        refs = child.filter(F.col(key).isNotNull()).select(F.col(child_id).alias("id"), F.col(key).alias("ref"))
        return refs.join(parent.select(F.col(parent_key).alias("ref")), "ref", "left_anti").select(F.lit(rule).alias("rule"), "id")

    run_ctx = runs.select(
        F.col("agent_run_id"), F.col("session_id").alias("rs"), F.col("turn_id").alias("rt"), F.col("agent_id").alias("ra")
    )
    call_run = calls.join(shuffled(run_ctx), "agent_run_id").filter(
        (F.col("session_id") != F.col("rs")) | ~F.col("turn_id").eqNullSafe(F.col("rt")) | (F.col("agent_id") != F.col("ra"))
    )
    parents = run_ctx.withColumnRenamed("agent_run_id", "parent_agent_run_id")
    parent_ctx = runs.join(shuffled(parents), "parent_agent_run_id").filter(
        (F.col("session_id") != F.col("rs")) | ~F.col("turn_id").eqNullSafe(F.col("rt"))
    )
    live = agents.filter(F.col("deleted_at").isNull())
    finished = calls.filter(F.col("completed_at").isNotNull()).select("call_id", F.col("completed_at").alias("closed"))
    late = attempts.join(shuffled(finished), "call_id").filter(F.col("started_at") > F.col("closed"))
    parts = [
        missing("attempt_call_missing", attempts, "call_id", "attempt_id", shuffled(calls), "call_id"),
        missing("call_run_missing", calls, "agent_run_id", "call_id", shuffled(runs), "agent_run_id"),
        missing("fallback_call_missing", calls, "fallback_from_call_id", "call_id", shuffled(calls), "call_id"),
        missing("parent_run_missing", runs, "parent_agent_run_id", "agent_run_id", shuffled(runs), "agent_run_id"),
        missing("run_agent_missing_or_deleted", runs, "agent_id", "agent_run_id", live, "agent_id"),
        call_run.select(F.lit("call_context_mismatch").alias("rule"), F.col("call_id").alias("id")),
        parent_ctx.select(F.lit("parent_run_context_mismatch").alias("rule"), F.col("agent_run_id").alias("id")),
        late.select(F.lit("attempt_after_call_finalized").alias("rule"), F.col("attempt_id").alias("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def upgrade(df: DataFrame, table: str, from_version: int) -> DataFrame:
    """Project a table written under schema version 2-5 onto version 6."""
    if not 2 <= from_version <= 6:
        raise ValueError(f"unsupported schema version {from_version}")
    out = df
    if table == "model_call_attempts" and from_version < 4:
        out = out.drop("fallback_from_attempt_id", "fallback_reason")
    if table == "sessions" and from_version < 6:
        defaults = {"kind": "chat", "state": "active", "owner_agent_id": None, "parent_session_id": None, "archived_at": None}
        out = out.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in out.columns})
    return conform(out, SCHEMAS[table])
