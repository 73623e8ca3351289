"""Ordered scans that do not put a whole key into one task.

A key's rows are split into blocks whose order agrees with the row order (an
index range or a time bucket). Each block is summarised once, the summaries
are scanned per key, and the rows are then scanned inside (key, block) with
the summary of everything before the block joined in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_blocks(
    df: DataFrame,
    keys: list[str],
    block: str,
    summary: dict[str, Column],
    prefix: dict[str, Column | str],
) -> DataFrame:
    """Join to every row the prefix (over all earlier blocks of its key) of block summaries.

    ``summary`` holds per-block aggregates; ``prefix`` maps an output name to an
    aggregate over the summary columns of the earlier blocks.
    """
    blocks = df.groupBy(*keys, block).agg(*[c.alias(n) for n, c in summary.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    on = {k: f"_scan_{k}" for k in [*keys, block]}
    carried = blocks.select(*[F.col(k).alias(v) for k, v in on.items()], *[c.over(before).alias(n) for n, c in prefix.items()])
    cond = F.lit(True)
    for k, v in on.items():
        cond = cond & F.col(k).eqNullSafe(F.col(v))
    return df.join(carried, cond).drop(*on.values())


def numbered(df: DataFrame, keys: list[str], block: str, order: list, name: str = "idx") -> DataFrame:
    """0-based row number per key, computed block by block."""
    out = carry_blocks(df, keys, block, {"_n": F.count(F.lit(1))}, {"_scan_carry": F.sum("_n")})
    w = Window.partitionBy(*keys, block).orderBy(*order)
    return out.withColumn(name, F.coalesce("_scan_carry", F.lit(0)) + F.row_number().over(w) - 1).drop("_scan_carry")


def lagged(df: DataFrame, keys: list[str], block: str, order: list, cols: list[str]) -> DataFrame:
    """Previous row's ``cols`` per key as ``prev_<col>``, plus ``has_prev``, across block borders."""
    packed = F.struct(*cols)
    out = carry_blocks(
        df,
        keys,
        block,
        {"_last": F.max_by(packed, F.struct(*order)), "_edge": F.max(F.struct(*order))},
        {"_prev": F.max_by("_last", F.struct("_edge"))},
    )
    w = Window.partitionBy(*keys, block).orderBy(*order)
    prev = F.coalesce(F.lag(packed).over(w), F.col("_prev"))
    out = out.withColumn("_p", prev)
    return out.select(
        *df.columns,
        *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in cols],
        F.col("_p").isNotNull().alias("has_prev"),
    )


def running_sum(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str) -> DataFrame:
    """Inclusive running sum per key."""
    out = carry_blocks(df, keys, block, {"_s": F.sum(value)}, {"_scan_carry": F.sum("_s")})
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce("_scan_carry", F.lit(0)) + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_scan_carry")


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and, per name, the value at a 1-based rank computed from the number of values of the key.

    Equal values are counted first and the counts summed up in blocks of the value range, so
    neither a hot key nor its values are gathered anywhere. NULL and NaN are left out.
    """
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    block = F.signum("_v") * F.floor(F.log2(1 + F.abs(F.col("_v"))) * 32)  # grows with the value
    summed = running_sum(counts.withColumn("_block", block), keys, "_block", ["_v"], "_c", "_upto")
    totals = counts.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("_c").alias("_n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return summed.join(totals, on).groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= r(F.col("_n")), F.col("_v"))).alias(n) for n, r in ranks.items()])


def running_max_before(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str) -> DataFrame:
    """Maximum over all earlier rows of the key (NULL for the first)."""
    out = carry_blocks(df, keys, block, {"_m": F.max(value)}, {"_scan_carry": F.max("_m")})
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn(name, F.greatest(F.max(value).over(w), F.col("_scan_carry"))).drop("_scan_carry")
