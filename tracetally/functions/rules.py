"""Name, scope, access and filter rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import SAFE_MAX

NAME = r"^[a-z][a-z0-9_-]*(\.[a-z0-9_-]+)*\z"
CONTROL = r"[\x00-\x1f]"
NOT_BLANK = r"[^\s ﻿\p{Z}]"
MAX_LIST = 64

GRANTS = "array<struct<kind:string,key:string>>"
FILTER = (
    "struct<namespaces:array<struct<value:string,subtree:boolean>>,types:array<string>,"
    "source_system:string,source_type:string,source_id:string,created_from:bigint,created_to:bigint,"
    "updated_from:bigint,updated_to:bigint,scopes:array<struct<kind:string,key:string>>>"
)


def no(cond: Column) -> Column:
    """Negation that treats NULL as 'rule broken'."""
    return ~F.coalesce(cond, F.lit(False))


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def within(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-16 units; the exact count is taken only where it can matter."""
    return F.when(F.length(text) * 2 <= limit, True).otherwise(units(text) <= limit)


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & (F.length(name) <= 128)


def valid_scope(kind: Column, key: Column) -> Column:
    """A named kind and a 1-256 character key without control characters; 'global' only with '*'."""
    ok = valid_name(kind) & (F.length(key) > 0) & within(key, 256) & ~key.rlike(CONTROL)
    return F.coalesce(ok & ((kind != "global") | (key == "*")), F.lit(False))


def valid_grants(grants: Column) -> Column:
    return F.coalesce(
        (F.size(grants) <= MAX_LIST) & F.forall(grants, lambda g: valid_scope(g["kind"], g["key"])), F.lit(False)
    )


def _time_ok(lo: Column, hi: Column) -> Column:
    ok = lambda x: x.isNull() | x.between(0, SAFE_MAX)
    return ok(lo) & ok(hi) & (lo.isNull() | hi.isNull() | (lo <= hi))


def valid_filter(f: Column) -> Column:
    """Bounded lists of valid names and scopes, ordered non-negative ranges. NULL is valid."""
    ns, types, scopes = f["namespaces"], f["types"], f["scopes"]
    name_or_null = lambda c: c.isNull() | valid_name(c)
    sid = f["source_id"]
    ok = (
        (ns.isNull() | ((F.size(ns) <= MAX_LIST) & F.forall(ns, lambda n: F.coalesce(valid_name(n["value"]), F.lit(False)))))
        & (types.isNull() | ((F.size(types) <= MAX_LIST) & F.forall(types, lambda t: F.coalesce(valid_name(t), F.lit(False)))))
        & (scopes.isNull() | ((F.size(scopes) <= MAX_LIST) & F.forall(scopes, lambda s: valid_scope(s["kind"], s["key"]))))
        & name_or_null(f["source_system"])
        & name_or_null(f["source_type"])
        & (sid.isNull() | ((F.length(sid) > 0) & within(sid, 512)))
        & _time_ok(f["created_from"], f["created_to"])
        & _time_ok(f["updated_from"], f["updated_to"])
    )
    return f.isNull() | F.coalesce(ok, F.lit(False))


def matches(f: Column, item=lambda n: F.col(n)) -> Column:
    """Does an item pass a filter struct? Absent parts match all, an empty list matches nothing."""
    ns, types, scopes = f["namespaces"], f["types"], f["scopes"]
    name = item("namespace")
    test = ns.isNull() | F.exists(
        ns,
        lambda n: (name == n["value"])
        | (F.coalesce(n["subtree"], F.lit(False)) & F.startswith(name, F.concat(n["value"], F.lit(".")))),
    )
    test = test & (types.isNull() | F.array_contains(types, item("type")))
    test = test & (
        scopes.isNull() | F.exists(scopes, lambda s: (s["kind"] == item("scope_kind")) & (s["key"] == item("scope_key")))
    )
    for part in ("system", "type", "id"):
        test = test & (f[f"source_{part}"].isNull() | (f[f"source_{part}"] == item(f"source_{part}")))
    for col in ("created", "updated"):
        at = item(f"{col}_at")
        test = test & (f[f"{col}_from"].isNull() | (at >= f[f"{col}_from"])) & (f[f"{col}_to"].isNull() | (at <= f[f"{col}_to"]))
    return f.isNull() | F.coalesce(test, F.lit(False))


def granted(grants: Column, item=lambda n: F.col(n)) -> Column:
    """One grant equals the item's scope."""
    return F.coalesce(
        F.exists(grants, lambda g: (g["kind"] == item("scope_kind")) & (g["key"] == item("scope_key"))), F.lit(False)
    )


def json_depth_ok(doc: Column, limit: int = 20) -> Column:
    """Every value of a JSON text sits in fewer than ``limit`` containers."""
    bare = F.regexp_replace(doc, r'"(\\.|[^"\\])*"', "0")
    bare = F.regexp_replace(bare, r"[\[{]\s*[\]}]", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    deepest = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, m: F.struct(
            (acc["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["top"], acc["now"] + F.when(m.isin("[", "{"), 1).otherwise(0)).alias("top"),
        ),
        lambda acc: acc["top"],
    )
    return deepest < limit
