"""Block scans, tree folds, sessions and conversation context on hand-made cases."""

import random

from pyspark.sql import functions as F

from tracetally.functions import scan
from tracetally.operators import sessions as N
from tracetally.operators.tree import fold_ancestors, sum_descendants


def test_block_scans_match_plain_loops(spark):
    rnd = random.Random(1)
    rows = [(k, s, rnd.choice([None, rnd.randrange(100)])) for k in ("a", "b") for s in sorted(rnd.sample(range(1000), 120))]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint").repartition(7).withColumn("b", F.floor(F.col("seq") / 90))
    out = scan.numbered(df, ["k"], "b", ["seq"])
    out = scan.lagged(out, ["k"], "b", ["seq"], ["v"])
    out = scan.running_max_before(out, ["k"], "b", ["seq"], "v", "top")
    out = scan.running_sum(out, ["k"], "b", ["seq"], "v", "total")
    got = {(r.k, r.seq): (r.idx, r.prev_v, r.has_prev, r.top, r.total) for r in out.collect()}
    for k in ("a", "b"):
        top, total, prev = None, None, None
        for i, (_, s, v) in enumerate([r for r in rows if r[0] == k]):
            total = total if v is None else (total or 0) + v
            g = got[(k, s)]
            assert g[:4] == (i, prev, i > 0, top) and g[4] == (total or 0)
            prev, top = v, v if top is None else top if v is None else max(top, v)


def test_deep_chain_and_cycle(spark):
    rows = [(f"n{i}", f"n{i-1}" if i else None, i) for i in range(260)] + [("x", "y", 1), ("y", "x", 1), ("z", "x", 1), ("o", "nowhere", 5)]
    df = spark.createDataFrame(rows, "id string, up string, v bigint")
    got = {r.id: r for r in fold_ancestors(df, "id", "up", {"s": F.col("v")}, {"s": lambda a, b: a + b}).collect()}
    assert got["n259"].s == sum(range(260)) and got["n259"].depth == 259 and got["n259"].root == "n0"
    assert got["x"].cyclic and got["z"].cyclic and got["o"].missing and not got["o"].cyclic
    down = {r.id: r for r in sum_descendants(df, "id", "up", ["v"], {"v": F.sum("v")}, {"v": lambda a, b: a + F.coalesce(b, F.lit(0))}).collect()}
    assert down["n0"].v == sum(range(260)) and down["n250"].v == sum(range(250, 260)) and down["o"].v == 5


SESSION = "id string, parent_session_id string, state string, updated_at bigint, archived_at bigint"


def tree(spark):
    rows = [("root", None, "active"), ("kid", "root", "active"), ("grandkid", "kid", "archived"), ("leaf", "grandkid", "active"), ("other", None, "active"), ("lost", "gone", "active"), ("c1", "c2", "active"), ("c2", "c1", "active")]
    return spark.createDataFrame([(i, p, s, 1, 2 if s == "archived" else None) for i, p, s in rows], SESSION)


def test_archive_and_restore(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    out, bad = N.archive(tree(spark), ids("kid", "nope"), 99)
    got = {r.id: (r.state, r.archived_at) for r in out.collect()}
    assert got["kid"] == ("archived", 99) and got["grandkid"] == ("archived", 2) and got["leaf"] == ("archived", 99)
    assert got["root"] == ("active", None) and [tuple(r) for r in bad.collect()] == [("nope", "not_found")]
    ancestry = {r.id: r.ancestry for r in N.active_sessions(tree(spark)).collect()}
    assert ancestry == {"root": "ok", "kid": "ok", "grandkid": "archived", "leaf": "archived", "other": "ok", "lost": "missing", "c1": "cycle", "c2": "cycle"}
    out, bad = N.restore(out, ids("grandkid", "kid", "nope"), 100)
    got = {r.id: r.state for r in out.collect()}
    assert got["kid"] == "active" and got["grandkid"] == "archived"
    assert {tuple(r) for r in bad.collect()} == {("grandkid", "parent_archived"), ("nope", "not_found")}


def test_context_and_titles(spark):
    payload = '{"role":"assistant","stopReason":"stop"}'
    rows = [
        ("m1", "user", "  Hello   there, this title is much longer than forty characters ", "completed", None, 1),
        ("m2", "assistant", "", "failed", payload, 2),
        ("m3", "assistant", "", "completed", payload, 3),
        ("m4", "assistant", "text", "failed", '{"role":"assistant","stopReason":"aborted"}', 4),
        ("m5", "assistant", "ok", "interrupted", "{broken", 5),
        ("m6", "assistant", "", "completed", None, 6),
    ]
    m = spark.createDataFrame([(i, "k", r, c, s, p, t) for i, r, c, s, p, t in rows], "id string, conversation_id string, role string, content string, status string, payload_json string, created_at bigint")
    got = [(r.id, r.turn_kind, r.stop_reason) for r in N.build_context(m).orderBy("created_at").collect()]
    assert got == [("m1", "user", None), ("m3", "payload", None), ("m4", "text", "error"), ("m5", "text", "stop")]
    retry = N.retry_context(m, spark.createDataFrame([("m4",), ("m3",)], "id string")).orderBy("created_at").collect()
    assert [(r.retry_of, r.id) for r in retry] == [("m4", "m1"), ("m4", "m3")]
    title = N.titles(m).first().title
    assert title == "Hello there, this title is much longe..." and len(title) == 40


def test_retry_lineage(spark):
    calls = spark.createDataFrame(
        [("c1", "m1", "t1", 1), ("c2", "m1", "t2", 5), ("c3", "m1", "t1", 5), ("c4", "m2", None, 1), ("c5", None, "t2", 9), ("c6", "m3", "gone", 1)],
        "call_id string, message_id string, turn_id string, requested_at long",
    )
    turns = spark.createDataFrame([("t1", "s", 0, "completed", 3), ("t2", "s", 0, "failed", 4)], "turn_id string, session_id string, started_at long, status string, completed_at long")
    asked = spark.createDataFrame(
        [("n1", "m1"), ("n2", "m2"), ("n3", "nowhere"), ("n4", None), ("n5", "m3"), ("n6", "m1")], "message_id string, retry_of_message_id string"
    ).withColumns({"session_id": F.lit("s"), "asked_at": F.lit(99).cast("long")})
    links, after = N.retry_lineage(asked, calls, turns)
    got = {r.message_id: (r.turn_id, r.fallback_from_call_id, r.spawn_reason, r.reopened) for r in links.collect()}
    assert got == {
        "n1": ("t1", "c3", "user_retry", True), "n6": ("t1", "c3", "user_retry", True), "n2": ("turn-n2", "c4", "user_retry", False),
        "n3": ("turn-n3", None, "user_retry", False), "n4": ("turn-n4", None, "user_turn", False), "n5": ("gone", "c6", "user_retry", True),
    }
    new = {(f"turn-n{i}", 99, "running", None) for i in (2, 3, 4)}
    assert {(r.turn_id, r.started_at, r.status, r.completed_at) for r in after.collect()} == {("t1", 0, "running", None), ("t2", 0, "failed", 4)} | new
