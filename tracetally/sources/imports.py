"""Importing provider usage records, price sheets and vector blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SAFE_MAX

# JSON field -> (token column, provenance key). Fixed values.
USAGE_FIELDS = {
    "input": ("reported_uncached_input_tokens", "uncachedInputTokens"),
    "cacheRead": ("reported_cache_read_tokens", "cacheReadTokens"),
    "cacheWrite": ("reported_cache_write_tokens", "cacheWriteTokens"),
    "output": ("reported_output_tokens", "outputTokens"),
    "reasoning": ("reported_reasoning_tokens", "reasoningTokens"),
    "totalTokens": ("reported_total_tokens", "totalTokens"),
}
COST_FIELDS = ["input", "output", "cacheRead", "cacheWrite", "total"]
_COST = "cost STRUCT<" + ", ".join(f"{c}: STRING" for c in COST_FIELDS) + ">"
USAGE_JSON = "STRUCT<" + ", ".join(f"{f}: STRING" for f in USAGE_FIELDS) + ">"
NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def _members(doc: Column, names: list[str]) -> Column:
    """The named members of a JSON object as a struct of variants, taken in one pass."""
    return F.try_variant_get(doc, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def _variant_number(value: Column) -> Column:
    """A JSON value as double, NULL unless it is written as a number."""
    is_number = F.schema_of_variant(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number, F.try_variant_get(value, "$", "double"))


def _with_numbers(df: DataFrame, json_col: str) -> DataFrame:
    """The members of the JSON text as ``_doc`` and its usage numbers as ``_<field>``; the text is parsed once."""
    out = df.withColumn("_doc", _members(F.try_parse_json(json_col), [*USAGE_FIELDS, "cost"]))
    return out.withColumns({f"_{f}": _variant_number(F.col(f"_doc.{f}")) for f in USAGE_FIELDS})


def normalize_usage(df: DataFrame, json_col: str) -> DataFrame:
    """Provider usage JSON -> token columns, provenance and has_usage.

    ``input`` counts uncached input. Values that are not non-negative safe
    integers are unknown. A record whose numbers are all zero is a placeholder
    and yields no usage at all, as does one without any usable number.
    """
    return _normalized(_with_numbers(df, json_col), json_col).drop("_doc", *[f"_{f}" for f in USAGE_FIELDS])


def _normalized(out: DataFrame, json_col: str) -> DataFrame:
    raw = [F.col(f"_{f}") for f in USAGE_FIELDS]
    any_number, all_zero = F.lit(False), F.lit(True)
    for r in raw:
        any_number = any_number | r.isNotNull()
        all_zero = all_zero & (r.isNull() | (r == 0))
    tokens = {
        col: F.when((F.col(f"_{f}") >= 0) & (F.col(f"_{f}") <= SAFE_MAX) & (F.col(f"_{f}") == F.floor(F.col(f"_{f}"))), F.col(f"_{f}").cast("long"))
        for f, (col, _) in USAGE_FIELDS.items()
    }
    out = out.withColumn("_empty", any_number & all_zero).withColumns(tokens)
    usable = F.lit(False)
    for col in tokens:
        usable = usable | F.col(col).isNotNull()
    out = out.withColumn("has_usage", F.col("_doc").isNotNull() & ~F.col("_empty") & usable)
    out = out.withColumns({col: F.when(F.col("has_usage"), F.col(col)) for col in tokens})
    listed = F.array_compact(
        F.array(*[F.when(F.col(col).isNotNull(), F.lit(f'"{key}":"provider_reported"')) for col, key in USAGE_FIELDS.values()])
    )
    return out.withColumns(
        {
            "provenance_json": F.when(F.size(listed) > 0, F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))),
            "usage_source": F.when(F.col("has_usage"), "provider_reported"),
            "provider_usage_json": F.when(F.col("has_usage"), F.col(json_col)),
        }
    ).drop("_empty")


def generation_usage(df: DataFrame, json_col: str) -> DataFrame:
    """Usage as kept with a generation: plain numbers as given, request id and finish reason.

    Without usable usage only the ids survive; a pending stop reason is no finish
    reason when usage is present.
    """
    out = _normalized(_with_numbers(df, json_col), json_col)
    out = out.withColumn("_cost", _members(F.col("_doc.cost"), COST_FIELDS))
    usage = F.col("has_usage")
    names = {"input": "input_tokens", "output": "output_tokens", "cacheRead": "cached_tokens", "cacheWrite": "cache_write_tokens",
             "reasoning": "reasoning_tokens", "totalTokens": "total_tokens"}
    cols = {n: F.when(usage, F.col(f"_{f}")) for f, n in names.items()}
    cost = {f"cost_{c}": F.when(usage, _variant_number(F.col(f"_cost.{c}"))) for c in COST_FIELDS}
    stop, raw = F.col("stop_reason"), F.col("raw_stop_reason")
    finish = F.when(F.length(stop) > 0, F.when(F.length(raw) > 0, raw).otherwise(stop))
    finish = F.when(~usage | (stop != "pending"), finish)
    out = out.withColumns({**cols, **cost}).withColumns(
        {"request_id": F.when(F.length("response_id") > 0, F.col("response_id")), "finish_reason": finish}
    )
    keep = [*names.values(), *cost, "request_id", "finish_reason"]
    known = F.lit(False)
    for k in keep:
        known = known | F.col(k).isNotNull()
    return out.withColumn("has_generation_usage", known).drop("_doc", "_cost", *[f"_{f}" for f in USAGE_FIELDS])


UNITS = {"": 1.0, "usd": 1.0, "c": 100.0, "¢": 100.0, "cent": 100.0, "cents": 100.0}  # per dollar
BLANKS = r"[\s\x{FEFF}\p{Z}]+"


def bare(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANKS}", ""), f"{BLANKS}\\z", "")


def parse_usd(text: Column) -> Column:
    """'$1,200.5', '30c', '.5 usd' -> USD per million tokens; NULL when it is no price."""
    t = bare(F.replace(F.lower(text), F.lit(","), F.lit("")))
    t = bare(F.when(t.startswith("$"), F.substring(t, 2, 1 << 20)).otherwise(t))
    number, unit = F.regexp_extract(t, r"^[0-9.]*", 0), bare(F.regexp_replace(t, r"^[0-9.]*", ""))
    whole, part = F.substring_index(number, ".", 1), F.when(number.contains("."), F.substring_index(number, ".", -1))
    one_point = F.length(F.regexp_replace(number, "[0-9]", "")) <= 1
    decimal = one_point & (F.length(number) > 0) & F.coalesce(F.length(part) > 0, F.lit(True))
    worth = F.element_at(F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv]), unit)
    full = (F.length(whole) > 0) | (worth == 1.0)  # cents need a digit before the point
    return F.when(decimal & full & worth.isNotNull(), number.try_cast("double") / worth)


def import_price_sheet(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects) for rows with input_text, output_text, cache_read_text, cache_write_text.

    Input and output are required; blank cache prices mean none; any other text is rejected.
    """
    required, optional = ["input", "output"], ["cache_read", "cache_write"]
    usd = {f"{c}_usd": parse_usd(F.col(f"{c}_text")) for c in required + optional}
    out = df.withColumns(usd)
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(f"{c}_usd").isNull()
    for c in optional:
        blank = bare(F.coalesce(F.col(f"{c}_text"), F.lit(""))) == ""
        bad = bad | (~blank & F.col(f"{c}_usd").isNull())
    scaled = {c: F.col(f"{c}_usd") * F.lit(1e6) for c in required + optional}
    too_big = F.lit(False)
    for v in scaled.values():
        too_big = too_big | F.coalesce(v > SAFE_MAX, F.lit(False))
    out = out.withColumn("reject_code", F.when(bad, "invalid_price").when(too_big, "unsafe_integer"))
    micros = {f"{c}_per_million_micros": F.floor(v + F.lit(0.5)).cast("long") for c, v in scaled.items()}
    ok = out.filter(F.col("reject_code").isNull()).withColumns(micros)
    return ok, out.filter(F.col("reject_code").isNotNull())


def encode_vectors(df: DataFrame, vector: str = "vector", blob: str = "data") -> DataFrame:
    """Vectors as little-endian float32 blobs."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())

    return df.withColumn(blob, pack(F.col(vector)))


def decode_vectors(df: DataFrame, blob: str = "data", dims: str = "dimensions") -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): blobs whose byte length is not dims * 4, or that hold a number that is not finite, are rejected."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    fits = F.coalesce(F.octet_length(blob) == F.col(dims) * 4, F.lit(False))
    finite = F.coalesce(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    out = df.withColumn("vector", F.when(fits, unpack(F.col(blob))))
    return out.filter(finite), out.filter(~finite).drop("vector").withColumn("reject_code", F.lit("invalid_vector"))
