"""Prices, attempt costs and NULL policies on hand-made cases."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tracetally.functions.numbers import known_money
from tracetally.operators import cost as C
from tracetally.operators import pricing as P
from tracetally.operators import rollup as R

PRICE = (
    "pricing_snapshot_id string, provider string, provider_account_id string, model string, input_per_million_micros bigint, cache_read_per_million_micros bigint, "
    "cache_write_per_million_micros bigint, output_per_million_micros bigint, reasoning_per_million_micros bigint, currency string, effective_from bigint, effective_to bigint, source string, created_at bigint"
)
ATTEMPT = (
    "attempt_id string, call_id string, attempt_number bigint, provider string, model string, provider_account_id string, started_at bigint, completed_at bigint, status string, has_usage boolean, "
    "reported_uncached_input_tokens bigint, reported_cache_read_tokens bigint, reported_output_tokens bigint, reported_reasoning_tokens bigint, usage_source string, registry_cost_usd double"
)


def price(id, account=None, rates=(1_000_000, None, None, 2_000_000, None), start=0, end=None, created=0):
    return (id, "p", account, "m", *rates, "USD", start, end, "s", created)


def attempt(id, tokens, at=100, account="a", usage=True, registry=None):
    return (id, "c" + id, 1, "p", "m", account, at, at + 50, "completed", usage, *tokens, "provider_reported", registry)


def costs(spark, attempts, prices):
    out = C.attempt_cost(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(prices, PRICE))
    return {r.attempt_id: r for r in out.collect()}


def test_amounts_are_exact_and_rounded_half_up(spark):
    rows = [attempt("1", (1_500, None, 900, None)), attempt("2", (0, None, 0, None)), attempt("3", (2**52, None, 0, None)), attempt("4", (2**53 - 1, None, 2**53 - 1, None)), attempt("5", (-1, None, 5, None))]
    got = costs(spark, rows, [price("x")])
    assert got["1"].api_equivalent_cost_micros == 1_500 + 1_800
    assert got["2"].api_equivalent_cost_micros == 0
    assert got["3"].api_equivalent_cost_micros == 2**52
    assert got["4"].api_equivalent_cost_micros is None and got["4"].cost_reject == "cost_overflow"
    assert got["5"].api_equivalent_cost_micros is None and got["5"].cost_reject == "unsafe_integer"
    half = costs(spark, [attempt("h", (1, None, 0, None)), attempt("d", (1, None, 0, None), account="b")], [price("x", rates=(500_000, None, None, 1, None)), price("y", "b", rates=(499_999, None, None, 1, None))])
    assert (half["h"].api_equivalent_cost_micros, half["d"].api_equivalent_cost_micros) == (1, 0)


def test_unknown_dimensions_void_the_cost(spark):
    rows = [attempt("rate", (1, 7, 1, None)), attempt("count", (None, None, 1, None)), attempt("none", (None, None, None, None)), attempt("nousage", (1, None, 1, None), usage=False), attempt("fallback", (1, 7, 1, None), registry=0.0000125)]
    got = costs(spark, rows, [price("x")])
    assert all(got[k].api_equivalent_cost_micros is None for k in ("rate", "count", "none", "nousage"))
    assert (got["fallback"].api_equivalent_cost_micros, got["fallback"].api_equivalent_cost_source, got["fallback"].pricing_snapshot_id) == (13, "external_fallback", None)


def test_reasoning_is_priced_apart(spark):
    rates = (1_000_000, None, None, 2_000_000, 3_000_000)
    got = costs(spark, [attempt("1", (100, None, 500, 200)), attempt("2", (100, None, 500, None)), attempt("3", (100, None, 100, 200))], [price("x", rates=rates)])
    assert got["1"].api_equivalent_cost_micros == 100 + 600 + 600
    assert got["2"].api_equivalent_cost_micros is None
    assert got["3"].api_equivalent_cost_micros == 100 + 0 + 600


def brute(prices, account, at):
    ok = [p for p in prices if p[10] <= at and (p[11] is None or p[11] > at) and p[2] in (None, account)]
    ok.sort(key=lambda p: (p[2] is None, -p[10], -p[13], p[0]))
    best = [p for p in ok if (p[2] is None, p[10], p[13]) == (ok[0][2] is None, ok[0][10], ok[0][13])] if ok else []
    return max(p[0] for p in best) if best else None


def test_price_timeline_matches_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    prices = []
    for i in range(60):
        start = rnd.randrange(0, 200)
        prices.append(price(f"x{i:02}", rnd.choice([None, None, "a", "b"]), start=start, end=rnd.choice([None, start, start + rnd.randrange(1, 90)]), created=rnd.randrange(3)))
    rows = [attempt(f"{acc}{t}", (1, None, 1, None), at=t, account=acc) for t in range(0, 300, 3) for acc in ("a", "b", "z")]
    df, pr = spark.createDataFrame(rows, ATTEMPT), spark.createDataFrame(prices, PRICE)
    want = {r[0]: brute(prices, r[5], r[6]) for r in rows}
    for limit in (10_000, 3):  # 3: the price list counts as large and takes the bucketed join
        monkeypatch.setattr(P, "fits", lambda d, n=limit: d.limit(n + 1).count() <= n)
        got = {r.attempt_id: r.p for r in P.resolve_price(df, pr).select("attempt_id", F.col("price.pricing_snapshot_id").alias("p")).collect()}
        assert got == want


def test_known_money(spark):
    rows = [("mix", 1, "USD"), ("mix", 2, "EUR"), ("part", 1, "USD"), ("part", None, None), ("none", None, None), ("nocur", 4, None), ("all", 1, "USD"), ("all", 2, "USD"), ("half", 1, "USD"), ("half", 2, None)]
    a, c, u = known_money(F.col("amount"), F.col("cur"))
    out = spark.createDataFrame(rows, "k string, amount bigint, cur string").groupBy("k").agg(a.alias("a"), c.alias("c"), u.alias("u"))
    assert {r.k: (r.a, r.c, r.u) for r in out.collect()} == {
        "mix": (None, None, True), "part": (1, "USD", True), "none": (0, None, True), "nocur": (4, None, True), "all": (3, "USD", False), "half": (None, None, True),
    }


def test_tree_counts_nested_cost_once(spark):
    runs = spark.createDataFrame([(i, "s", "t", p, n, int(i[1:])) for i, p, n in [("r1", None, "lead"), ("r2", "r1", "left"), ("r3", "r1", "right"), ("r4", "r3", "leaf")]], "agent_run_id string, session_id string, turn_id string, parent_agent_run_id string, agent_name_snapshot string, started_at bigint")
    call = "call_id string, turn_id string, agent_run_id string, api_amount bigint, api_currency string, metered_amount bigint, metered_currency string"
    calls = spark.createDataFrame([("c1", "t", "r1", 1_000_000, "USD", None, None), ("c2", "t", "r2", 500_000, "USD", 7, "USD"), ("c4", "t", "r4", 1_500_000, "USD", 5, "EUR")], call)
    alloc = spark.createDataFrame([("a1", "c2", 40, "USD", 1)], "allocation_id string, call_id string, amount_micros bigint, currency string, created_at bigint")
    attr = R.attribution(runs, calls, alloc)
    rows = {r.agent_run_id: r for r in attr.collect()}
    assert (rows["r1"].api_self, rows["r1"].api_descendant, rows["r1"].api_total, rows["r1"].api_has_unknown) == (1_000_000, 2_000_000, 3_000_000, False)
    assert (rows["r3"].api_self, rows["r3"].api_total, rows["r3"].api_currency) == (0, 1_500_000, "USD")
    assert (rows["r1"].metered_self, rows["r1"].metered_total, rows["r1"].metered_has_unknown) == (0, None, True)
    assert (rows["r1"].allocated_self, rows["r1"].allocated_total, rows["r4"].allocated_total, rows["r3"].allocated_total) == (None, 40, None, 0)
    assert R.turn_total(attr).first().turn_total == "$3.00"
    tree = [r.label for r in R.flatten_tree(attr).orderBy("sort_path").collect()]
    assert tree == ["lead", "├─ left", "└─ right", "   └─ leaf"]


def test_fallback_chain_marks_cycles_and_dangling_links(spark):
    rows = [Row(call_id=f"c{i}", fallback_from_call_id=f"c{i-1}" if i else None, status="failed" if i < 299 else "completed", requested_at=i) for i in range(300)]
    rows += [Row(call_id="x", fallback_from_call_id="y", status="failed", requested_at=1), Row(call_id="y", fallback_from_call_id="x", status="failed", requested_at=2), Row(call_id="d", fallback_from_call_id="gone", status="failed", requested_at=1)]
    got = {r.call_id: r for r in R.fallback_chain(spark.createDataFrame(rows)).collect()}
    assert (got["c299"].depth, got["c299"].chain_id, got["c0"].final_status, got["c0"].chain_length) == (299, "c0", "completed", 300)
    assert got["x"].cyclic and got["y"].cyclic and got["d"].dangling and not got["c5"].dangling
