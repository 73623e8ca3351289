"""Integer, rounding and NULL-policy helpers.

Four NULL policies exist side by side and never share a helper: ``poison_sum``
(one unknown makes the sum unknown), ``skip_sum`` (unknowns are left out),
``strict_money`` (every part known, one currency) and ``known_money`` (sum of
the known parts with an explicit unknown flag).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_MAX = 2**53 - 1  # largest integer the records may hold


def js_round(x: Column) -> Column:
    """Half-up rounding of a double to a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def floor_zero(x: Column) -> Column:
    """max(0, x) that keeps NULL (``greatest`` alone would turn NULL into 0)."""
    return F.when(x < 0, F.lit(0)).otherwise(x)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is NULL or not positive."""
    return F.when(den > 0, num / den)


def safe_sum(total: Column) -> Column:
    """A sum beyond the safe integer range is unknown (NULL); other keys keep theirs."""
    return F.when(total.between(-SAFE_MAX, SAFE_MAX), total)


def poison_sum(x: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), safe_sum(F.sum(x)))


def skip_sum(x: Column) -> Column:
    """Sum of the known inputs; NULL only when all are NULL."""
    return safe_sum(F.sum(x))


def strict_money(amount: Column, currency: Column) -> tuple[Column, Column]:
    """(amount, currency), both NULL unless every part is known in one currency."""
    complete = (
        (F.count(amount) == F.count(F.lit(1)))
        & (F.count(currency) == F.count(F.lit(1)))
        & (F.min(currency) == F.max(currency))
    )
    return F.when(complete, safe_sum(F.sum(amount))), F.when(complete, F.min(currency))


def money_parts(amount: Column, currency: Column, present: Column | None = None) -> dict[str, Column]:
    """Mergeable state of ``known_money``; ``present`` masks rows that are no component at all."""
    there = F.lit(True) if present is None else present
    known = there & amount.isNotNull()
    return {
        "parts": F.sum(F.when(there, 1).otherwise(0)),
        "known": F.sum(F.when(known, 1).otherwise(0)),
        "amount": F.sum(F.when(known, amount)),
        "min_cur": F.min(F.when(known, currency)),
        "max_cur": F.max(F.when(known, currency)),
        "no_cur": F.sum(F.when(known & currency.isNull(), 1).otherwise(0)),
    }


def merge_money(prefix: str) -> dict[str, Column]:
    """Aggregate expressions that merge columns written by ``money_parts``."""
    c = lambda name: F.col(f"{prefix}{name}")
    return {
        "parts": F.sum(c("parts")),
        "known": F.sum(c("known")),
        "amount": F.sum(c("amount")),
        "min_cur": F.min(c("min_cur")),
        "max_cur": F.max(c("max_cur")),
        "no_cur": F.sum(c("no_cur")),
    }


def finish_money(parts: Column, known: Column, amount: Column, min_cur: Column, max_cur: Column, no_cur: Column):
    """(amount, currency, has_unknown) of a ``known_money`` state.

    No parts: (NULL, NULL, false). More than one currency among the known parts
    (a missing currency counts as one): (NULL, NULL, true). Nothing known:
    (0, NULL, true). Otherwise the sum of the known parts.
    """
    empty = F.coalesce(parts, F.lit(0)) == 0
    mixed = (min_cur != max_cur) | ((no_cur > 0) & min_cur.isNotNull())
    mixed = F.coalesce(mixed, F.lit(False))
    value = F.when(empty | mixed, F.lit(None).cast("long")).otherwise(safe_sum(F.coalesce(amount, F.lit(0)).cast("long")))
    currency = F.when(~empty & ~mixed, min_cur)
    unknown = ~empty & (mixed | (known < parts) | (no_cur > 0))
    return value, currency, unknown


def known_money(amount: Column, currency: Column, present: Column | None = None):
    """(amount, currency, has_unknown) as aggregate expressions over one group."""
    p = money_parts(amount, currency, present)
    return finish_money(p["parts"], p["known"], p["amount"], p["min_cur"], p["max_cur"], p["no_cur"])
