"""Agent-run trees: cost attribution, display rows, turn totals, fallback chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import format_money
from ..functions.numbers import finish_money, known_money, merge_money, money_parts
from ..functions.sizing import cut
from .tree import fold_ancestors, sum_descendants

PARTS = ["parts", "known", "amount", "min_cur", "max_cur", "no_cur"]
KINDS = ["api", "metered", "allocated"]


def attribution(runs: DataFrame, calls: DataFrame, allocations: DataFrame) -> DataFrame:
    """Self, descendant and total cost of every agent run for three kinds of money.

    Follows the documented contract: known values of the subtree are summed; a
    total is NULL when known currencies differ; has_unknown is set when any
    contributing value is unknown or currencies are mixed. A run without calls
    has self 0; descendant is NULL without children; an allocation is NULL only
    where no allocation row exists, which is not an unknown.
    """
    call_money = calls.filter(F.col("turn_id").isNotNull()).select(
        "call_id", "turn_id", F.col("agent_run_id").alias("run"), *[f"{k}_{c}" for k in ("api", "metered") for c in ("amount", "currency")]
    )
    per_kind = {
        "api": money_parts(F.col("api_amount"), F.col("api_currency")),
        "metered": money_parts(F.col("metered_amount"), F.col("metered_currency")),
    }
    own = call_money.groupBy("run", "turn_id").agg(
        F.count(F.lit(1)).alias("calls"),
        *[c.alias(f"{k}_{n}") for k, parts in per_kind.items() for n, c in parts.items()],
    )
    shares = allocations.join(call_money.select("call_id", "run", "turn_id"), "call_id")
    shares = shares.groupBy("run", "turn_id").agg(
        *[c.alias(f"allocated_{n}") for n, c in money_parts(F.col("amount_micros"), F.col("currency")).items()]
    )
    base = (
        runs.select("agent_run_id", "session_id", "turn_id", "parent_agent_run_id", "agent_name_snapshot", "started_at")
        .join(own.withColumnRenamed("run", "agent_run_id"), ["agent_run_id", "turn_id"], "left")
        .join(shares.withColumnRenamed("run", "agent_run_id"), ["agent_run_id", "turn_id"], "left")
    )
    state = [f"{k}_{n}" for k in KINDS for n in PARTS]
    counted = ("parts", "known", "no_cur")
    base = base.withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in state if s.endswith(counted)})
    # amounts are finished where their parts are summed: fewer columns to join, and code the JVM compiles
    idle, zero = F.coalesce("calls", F.lit(0)) == 0, F.lit(0).cast("long")
    finished = lambda prefix: finish_money(*[F.col(f"{prefix}_{n}") for n in PARTS])
    base = base.withColumns({f"{k}_self": F.when(idle & (F.col(f"{k}_parts") == 0), zero).otherwise(finished(k)[0]) for k in KINDS})
    base = cut(base)  # read three times below
    merge, add = {}, {}
    for k in KINDS:
        for n, c in merge_money(f"{k}_").items():
            merge[f"{k}_{n}"] = c
            if n in counted:
                add[f"{k}_{n}"] = lambda a, b: a + F.coalesce(b, F.lit(0))
            elif n == "amount":
                add[f"{k}_{n}"] = lambda a, b: F.coalesce(a + b, a, b)
            else:
                add[f"{k}_{n}"] = (lambda a, b: F.least(a, b)) if n == "min_cur" else (lambda a, b: F.greatest(a, b))
    total = sum_descendants(base, "agent_run_id", "parent_agent_run_id", state, merge, add)
    total = total.withColumnsRenamed({s: f"t_{s}" for s in state})
    kids = (
        runs.filter(F.col("parent_agent_run_id").isNotNull())
        .groupBy("parent_agent_run_id")
        .agg(F.count(F.lit(1)).alias("children"))
        .withColumnRenamed("parent_agent_run_id", "kid_of")
    )
    # strictly below = the children's subtrees, merged per parent
    below = (
        runs.filter(F.col("parent_agent_run_id").isNotNull())
        .select("agent_run_id", F.col("parent_agent_run_id").alias("up"))
        .join(total, "agent_run_id")
        .groupBy("up")
        .agg(*[c.alias(f"d_{k}_{n}") for k in KINDS for n, c in merge_money(f"t_{k}_").items()])
        .select("up", *[F.when(F.col(f"d_{k}_parts") == 0, zero).otherwise(finished(f"d_{k}")[0]).alias(f"{k}_below") for k in KINDS])
    )
    rows = base.drop(*state).join(total, "agent_run_id").join(kids, F.col("agent_run_id") == F.col("kid_of"), "left")
    rows = rows.join(below, F.col("agent_run_id") == F.col("up"), "left")
    out = [
        "agent_run_id", "session_id", "turn_id", "parent_agent_run_id", "agent_name_snapshot", "started_at",
        F.coalesce("children", F.lit(0)).alias("children"), "cyclic",
    ]
    for k in KINDS:
        t_amount, t_cur, t_unknown = finished(f"t_{k}")
        empty_tree = F.col(f"t_{k}_parts") == 0
        if k == "allocated":
            total_amount = F.when(empty_tree, F.when(idle, zero)).otherwise(t_amount)
        else:
            total_amount = F.when(empty_tree, zero).otherwise(t_amount)
        out += [
            f"{k}_self",
            F.when(F.col("children").isNotNull(), F.col(f"{k}_below")).alias(f"{k}_descendant"),
            total_amount.alias(f"{k}_total"),
            t_unknown.alias(f"{k}_has_unknown"),
            t_cur.alias(f"{k}_currency"),
        ]
    return rows.select(*out)


def turn_total(attr: DataFrame) -> DataFrame:
    """Display total per turn over its root runs, with '+' when partly unknown; NULL for a single run."""
    root = F.col("parent_agent_run_id").isNull()
    priced = F.col("api_currency").isNotNull()
    amount, currency, unknown = known_money(F.when(priced, F.col("api_total")), F.col("api_currency"), root)
    out = attr.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("runs"),
        amount.alias("amount"),
        currency.alias("currency"),
        (unknown | F.coalesce(F.max(F.when(root, F.col("api_has_unknown"))), F.lit(False))).alias("partial"),
    )
    text = format_money(F.when(F.col("currency").isNotNull(), F.col("amount")), F.col("currency"))
    plus = F.when(F.col("currency").isNotNull() & F.col("partial"), "+").otherwise("")
    return out.select("turn_id", "runs", F.when(F.col("runs") > 1, F.concat(text, plus)).alias("turn_total"))


def flatten_tree(attr: DataFrame) -> DataFrame:
    """Display rows of every turn's tree: label with branch prefix, own cost, depth and sort path.

    Siblings are ordered by (started_at, id). Sorting a turn's rows by
    ``sort_path`` gives the depth-first display order.
    """
    order = F.struct("started_at", "agent_run_id")
    lasts = (
        attr.groupBy(F.col("turn_id").alias("lt"), F.coalesce("parent_agent_run_id", F.lit("")).alias("lp")).agg(F.max(order).alias("last"))
    )
    rows = attr.join(
        lasts, (F.col("turn_id") == F.col("lt")) & (F.coalesce("parent_agent_run_id", F.lit("")) == F.col("lp"))
    ).withColumn("is_last", F.col("last") == order)
    step = F.format_string("%020d|%s/", "started_at", "agent_run_id")
    join = lambda upper, lower: F.concat(upper, lower)
    state = {
        "sort_path": step,
        "flags": F.when(F.col("is_last"), "1").otherwise("0"),
    }
    paths = fold_ancestors(rows, "agent_run_id", "parent_agent_run_id", state, {"sort_path": join, "flags": join})
    inner = F.expr("substring(flags, 2, cast(depth as int) - 1)")
    prefix = F.replace(F.replace(inner, F.lit("1"), F.lit("   ")), F.lit("0"), F.lit("│  "))
    branch = F.when(F.col("is_last"), "└─ ").otherwise("├─ ")
    name = F.col("agent_name_snapshot")
    return rows.join(paths, "agent_run_id").select(
        "turn_id",
        "agent_run_id",
        "depth",
        "sort_path",
        F.when(F.col("depth") == 0, name).otherwise(F.concat(F.when(F.col("depth") > 1, prefix).otherwise(""), branch, name)).alias("label"),
        format_money(F.col("api_self"), F.col("api_currency")).alias("cost"),
    )


def fallback_chain(calls: DataFrame) -> DataFrame:
    """Chain root, position and chain outcome of every call linked by fallback_from_call_id.

    The outcome is the status of the chain's deepest call; ``dangling`` marks a
    chain whose first link points to a call that does not exist.
    """
    paths = fold_ancestors(calls, "call_id", "fallback_from_call_id", {}, {})
    rows = calls.select("call_id", "status", "requested_at").join(paths, "call_id")
    ends = rows.groupBy(F.col("root").alias("chain_id")).agg(
        F.max_by("status", F.struct("depth", "requested_at", "call_id")).alias("final_status"),
        F.count(F.lit(1)).alias("chain_length"),
    )
    return rows.join(ends, F.col("root") == F.col("chain_id")).select(
        "call_id", "chain_id", "depth", "final_status", "chain_length", F.col("missing").alias("dangling"), "cyclic"
    )
