"""Token usage: selection per dimension and aggregation over attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ["input", "uncached_input", "cache_read", "cache_write", "output", "reasoning", "total"]
TOKEN_COLUMNS = [f"{kind}_{d}_tokens" for kind in ("reported", "estimated") for d in DIMENSIONS]


def with_token_columns(df: DataFrame) -> DataFrame:
    """Add the token columns a table does not carry as unknown (NULL)."""
    missing = [c for c in TOKEN_COLUMNS if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("long").alias(c) for c in missing])


def picked(kind: str, dim: str) -> Column:
    if dim == "input":
        return F.coalesce(F.col(f"{kind}_uncached_input_tokens"), F.col(f"{kind}_input_tokens"))
    return F.col(f"{kind}_{dim}_tokens")


def selected(dim: str) -> Column:
    """Reported value where known, else the estimate."""
    return F.coalesce(picked("reported", dim), picked("estimated", dim))


PRICED = ["input", "cache_read", "cache_write", "output", "reasoning"]


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def select_usage(df: DataFrame, source: str = "usage_source") -> DataFrame:
    """One value per priced dimension as sel_<dimension>, plus cost_provenance.

    Each reported value is picked once in a projection of its own, which keeps
    the generated code of the later steps small enough to be compiled.
    """
    df = with_token_columns(df)
    df = df.select("*", *[picked("reported", d).alias(f"rep_{d}") for d in PRICED])
    df = df.select("*", *[F.coalesce(F.col(f"rep_{d}"), picked("estimated", d)).alias(f"sel_{d}") for d in PRICED])
    sel_null = [F.col(f"sel_{d}").isNull() for d in PRICED]
    rep_null = [F.col(f"rep_{d}").isNull() for d in PRICED]
    trusted = F.col(source).isin("provider_reported", "unknown")
    where = (
        F.when(_all(sel_null), "unknown")
        .when(_all([a == b for a, b in zip(sel_null, rep_null)]), F.when(trusted, "provider_reported").otherwise("mixed"))
        .when(_all(rep_null), "locally_estimated")
        .otherwise("mixed")
    )
    return df.withColumn("cost_provenance", where).drop(*[f"rep_{d}" for d in PRICED])


def usage_aggregates(columns: list[str], present: str = "has_usage", source: str = "usage_source") -> dict[str, Column]:
    """Per-call usage as aggregate expressions over its attempts.

    A token column is NULL as soon as one attempt lacks it or has no usage row;
    the source is the single common one, otherwise 'mixed'. Token columns the
    table does not carry (``columns`` lists what it has) stay NULL without work.
    """
    here = F.col(present)
    src = F.when(here, F.col(source))
    one_source = (F.count(src) == F.count(F.lit(1))) & (F.min(src) == F.max(src))
    out = {
        "any_usage": F.max(here),
        "usage_source": F.when(one_source, F.min(src)).otherwise("mixed"),
        "attempt_count": F.count(F.lit(1)),
    }
    for c in TOKEN_COLUMNS:
        if c not in columns:
            out[c] = F.lit(None).cast("long")
            continue
        value = F.when(here, F.col(c))
        out[c] = F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
    return out


def call_usage(attempts: DataFrame) -> DataFrame:
    """Usage per call; calls whose attempts all lack usage have no row."""
    aggs = usage_aggregates(attempts.columns)
    out = attempts.groupBy("call_id").agg(*[c.alias(n) for n, c in aggs.items()])
    return out.filter("any_usage").drop("any_usage")
