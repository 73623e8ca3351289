"""Scans for phrases keep no state per document and query: phrases are counted where the documents are read."""

import random

from tracetally.operators import inverted as I
from tracetally.operators import search as S
from tracetally.plans import search as P

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrase_tf_needs_no_exchange(spark):
    rng = random.Random(8)
    docs = [(f"d{i}", [rng.choice("abc") for _ in range(rng.randrange(30))]) for i in range(50)] + [("none", []), ("same", ["a"] * 9)]
    said = ["a", "b", "a b", "a a", "a a a", "a b c", "a b a b", "c c c c c", "x", "a x", "b x a", "a a a a a a a a a"]
    lexical = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "id string, tokens array<string>, n_tokens int").repartition(3)
    out = S.phrase_tf(lexical, spark.createDataFrame([(p, p.split()) for p in said], "phrase string, words array<string>"))
    count = lambda t, p: sum(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1))
    want = {(i, len(t), p, n) for p in said for i, t in docs if (n := count(t, p.split()))}
    assert {tuple(r) for r in out.select("id", "n_tokens", "phrase", "tf").collect()} == want
    plan = plan_of(S.phrase_tf(lexical.coalesce(1), spark.createDataFrame([("a", ["a"])], "phrase string, words array<string>")))
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_scanned_search_has_no_row_per_document_and_query(spark):
    out = S.search_lexical(P.asking(spark, FOLDER), P.items(spark, FOLDER, False), P.lexical(spark, FOLDER))
    plan = plan_of(out)
    assert "BroadcastNestedLoop" not in plan and "FlatMapCoGroups" in plan and "HashAggregate" not in plan.split("FlatMapCoGroups")[0]


def test_scan_gives_the_hits_of_the_index(spark):
    docs = [(f"d{i}", f"a b{i % 3} c a b{i % 5}".split()[: i % 6]) for i in range(80)]
    lexical = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "id string, tokens array<string>, n_tokens bigint")
    ph = spark.createDataFrame([(p, p.split()) for p in ["a", "c", "c a", "a b1", "b2 c a", "no"]], "phrase string, words array<string>")
    flat = lambda hits, numbers: {(r.shard, r.phrase, *x) for r in hits.collect() for x in zip(r.ids, r.lengths, r.tfs)}
    index = I.write_inverted(I.build_inverted(lexical, shard_docs=10))
    ph = S.cut(ph)
    a, b = flat(*I.phrase_hits(index, ph)), flat(*I.scan_hits(lexical, ph, I.totals(index)[2]))
    assert a == b and len(a) > 100
