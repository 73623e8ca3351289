"""Checked broadcasts and durable cut points."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # fixed-width dimension rows: well under 100 MB in memory


def count_up_to(df: DataFrame, limit: int) -> int:
    """Row count, giving up (limit + 1) as soon as the limit is exceeded."""
    return df.limit(limit + 1).count()


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when a table is proven to hold at most ``limit`` rows. Reads no more than that."""
    return count_up_to(df, limit) <= limit


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose size was checked; otherwise leave the choice to Spark,
    which shuffles on the key and splits hot partitions at run time."""
    return F.broadcast(df) if small else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the input and must not be sent to the driver. Spark's own estimate takes
    a row that is exploded or computed from a narrow column for as small as its source, and broadcasts it."""
    return df.hint("merge")


def chunks_for(rows: int, per_chunk: int) -> int:
    return max(1, math.ceil(rows / per_chunk))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the checkpoint folder the cluster names, else one beside the warehouse's tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    tables = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if tables.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local one")
    return f"{tables}/_shared"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so later steps restart from durable columnar files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
