"""Keyed and filtered lookups, in bulk form where a key table is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import valid_at


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def by_value(df: DataFrame, order: list[Column | str], **equals) -> DataFrame:
    """Rows with the given column values, ordered."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df.orderBy(*order)


def by_status(df: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """Rows in one of the statuses; an empty list matches nothing."""
    return df.filter(F.col(column).isin(statuses)) if statuses else df.filter(F.lit(False))


def latest_by(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, NULL keys left out."""
    cols = [c for c in df.columns if c != key]
    rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, tie)).alias("r"))
    return rows.select(key, "r.*")


def prices_valid_at(pricing: DataFrame, at: int) -> DataFrame:
    return pricing.filter(valid_at(F.lit(at)))


def sessions_by_state(sessions: DataFrame, state: str | None = None) -> DataFrame:
    """Sessions, newest update first."""
    rows = sessions if state is None else sessions.filter(F.col("state") == state)
    return rows.orderBy(F.desc("updated_at"), "id")


def children_of(sessions: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct children of the listed sessions."""
    keys = parents.select(F.col("id").alias("parent_session_id")).distinct()
    return sessions.join(keys, "parent_session_id", "left_semi")
