"""Display text for money, counts, durations and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dash shown for unknown values.
DASH = "—"


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounding the exact value of the double half away from zero.

    The scaled value is kept as product plus rounding error (error-free
    multiplication), so 0.00035, stored slightly below the tie, shows as 0.0003
    with four digits.
    """
    scale = 10**digits
    split = float(2**27 + 1)
    v = F.abs(x.cast("double"))
    p = v * F.lit(float(scale))
    hi = v * F.lit(split) - (v * F.lit(split) - v)
    lo = v - hi
    s_hi = scale * split - (scale * split - scale)
    s_lo = scale - s_hi
    err = ((hi * F.lit(s_hi) - p) + hi * F.lit(s_lo) + lo * F.lit(s_hi)) + lo * F.lit(s_lo)
    n = F.floor(p)
    over = ((p - (n + F.lit(0.5))) + err) >= 0
    n = F.when(over, n + 1).otherwise(n)
    sign = F.when((x < 0) & (n > 0), "-").otherwise("")
    if digits == 0:
        text = F.concat(sign, n.cast("string"))
    else:
        cents = n % scale
        text = F.concat(sign, ((n - cents) / scale).cast("long").cast("string"), F.lit("."), F.lpad(cents.cast("string"), digits, "0"))
    shown = F.when(p < float(2**52), text).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
    return F.when(x.isNotNull(), shown)


def format_money(micros: Column, currency: Column) -> Column:
    amount = micros / F.lit(1_000_000)
    text = (
        F.when(micros == 0, "0.0000")
        .when(amount >= 1, fixed(amount, 2))
        .when(amount >= 0.0001, fixed(amount, 4))
        .otherwise(fixed(amount, 6))
    )
    dollars = currency.isNull() | (currency == "") | (currency == "USD")
    return F.when(micros.isNull(), DASH).when(dollars, F.concat(F.lit("$"), text)).otherwise(F.concat_ws(" ", text, currency))


def format_tokens(n: Column) -> Column:
    return (
        F.when(n.isNull(), DASH)
        .when(n >= 1_000_000, F.concat(fixed(n / F.lit(1_000_000), 1), F.lit("M")))
        .when(n >= 1_000, F.concat(fixed(n / F.lit(1_000), 1), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def format_count(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit(DASH))


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), DASH)
        .when(ms >= 1000, F.concat(fixed(ms / F.lit(1000), 1), F.lit(" s")))
        .otherwise(F.concat(F.floor(ms + F.lit(0.5)).cast("string"), F.lit(" ms")))
    )


def format_speed(milli: Column) -> Column:
    rate = milli / F.lit(1000)
    text = F.when(rate >= 10, F.floor(rate + F.lit(0.5)).cast("string")).otherwise(fixed(rate, 1))
    return F.when(milli.isNull(), DASH).otherwise(F.concat(text, F.lit(" tok/s")))


def format_usd(usd: Column) -> Column:
    text = F.when(usd >= 0.01, fixed(usd, 2)).when(usd >= 0.0001, fixed(usd, 4)).otherwise(fixed(usd, 6))
    return F.when(usd == 0, "$0").otherwise(F.concat(F.lit("$"), text))


def format_model_price(input_usd: Column, output_usd: Column) -> Column:
    left = F.when(input_usd.isNull(), f"{DASH} in").otherwise(F.concat(format_usd(input_usd), F.lit(" in")))
    right = F.when(output_usd.isNull(), f"{DASH} out").otherwise(F.concat(format_usd(output_usd), F.lit(" out")))
    return F.when(input_usd.isNull() & output_usd.isNull(), "No price yet").otherwise(F.concat_ws(" · ", left, right))


def format_cache_price(read_usd: Column, write_usd: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(read_usd > 0, F.concat(format_usd(read_usd), F.lit(" cache read"))),
            F.when(write_usd > 0, F.concat(format_usd(write_usd), F.lit(" cache write"))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " · "))


def format_draft(usd: Column) -> Column:
    """Editable text of a rate: up to six decimals without trailing zeros; blank when unknown."""
    trimmed = F.regexp_replace(F.regexp_replace(fixed(usd, 6), "0+$", ""), r"\.$", "")
    return F.when(usd.isNull(), "").otherwise(trimmed)


def format_measurement(x: Column, unit: str = "", digits: int = 2) -> Column:
    known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(known, F.concat(fixed(x, digits), F.lit(f" {unit}" if unit else ""))).otherwise("unavailable")


def format_bytes(x: Column, signed: bool = False) -> Column:
    shown = F.concat(format_measurement(x / F.lit(1048576), "MiB"), F.lit(" ("), fixed(x.cast("double"), 0), F.lit(" bytes)"))
    ok = x.isNotNull() if signed else x >= 0
    return F.when(ok, shown).otherwise("unavailable")


def format_transfer_rate(x: Column) -> Column:
    return F.when(x >= 0, format_measurement(x / F.lit(1_000_000), "MB/s", 3)).otherwise("unavailable")


def format_seconds(ms: Column) -> Column:
    return F.when(ms >= 0, format_measurement(ms / F.lit(1000), "s")).otherwise("unavailable")
