"""Search, fusion, access and index states on hand-made cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracetally.functions import rules as R
from tracetally.operators import index as X
from tracetally.operators import search as S

ITEM = (
    "id string, namespace string, type string, source_system string, source_type string, source_id string, content string, created_at bigint, updated_at bigint, scope_kind string, scope_key string, "
    "lexical_state string, vector_state string, revision string, fingerprint string"
)


def item(id, content, scope="a", ns="notes", lex="ready", vec="ready", rev="r1"):
    return (id, ns, "note", "sys", "rec", id, content, 1, 2, "team", scope, lex, vec, rev, "fp")


def corpus(spark):
    rows = [item("d1", "The café by the river"), item("d2", "River river delta"), item("d3", "by the sea", scope="b"), item("d4", "exact phrase here", lex="pending"), item("d5", "phrase exact here"), item("d6", "quiet hills")]
    return spark.createDataFrame(rows, ITEM)


def ask(spark, *rows, grants=(("team", "a"),)):
    df = spark.createDataFrame([(i, t, m) for i, t, m in rows], "query_id string, text string, mode string")
    g = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("key")) for k, v in grants])
    ok, bad = S.validate_queries(df.withColumn("grants", g))
    assert bad.count() == 0
    return ok


def test_phrases_and_diacritics(spark):
    q = ask(spark, ("q1", 'hi; OR "exact phrase" -hello', "lexical"), ("q2", "CAFE", "lexical"), ("q3", '"', "lexical"))
    got = {}
    for r in S.parse_queries(q).orderBy("phrase_no").collect():
        got.setdefault(r.query_id, []).append(" ".join(r.words))
    assert got == {"q1": ["hi", "or", "exact phrase", "hello"], "q2": ["cafe"]}
    items = corpus(spark)
    hits = S.search_lexical(q, items, X.build_lexical(items)).collect()
    # d4 holds the phrase but is not ready, d5 has the words in another order
    assert [(r.query_id, r.id) for r in hits] == [("q2", "d1")]


def bm25(docs, words, id):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    total = 0.0
    for w in words:
        df = sum(w in d for d in docs.values())
        tf = docs[id].count(w)
        if tf:
            idf = math.log((n - df + 0.5) / (df + 0.5))
            total += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[id]) / mean))
    return total


def test_statistics_cover_the_index_and_access_applies_first(spark, monkeypatch):
    items = corpus(spark)
    docs = {r.id: r.tokens for r in X.build_lexical(items).collect()}
    rows = [(f"q{i}", "river the phrase", "lexical") for i in range(7)]
    want = sorted([(-round(bm25(docs, ["river", "the", "phrase"], d), 9), d) for d in ("d1", "d2", "d5")])
    for chunk in (4_000, 3):  # 3: more than one pass over the corpus
        monkeypatch.setattr(S, "QUERY_CHUNK", chunk)
        out = S.search_lexical(ask(spark, *rows), items, X.build_lexical(items)).collect()
        assert len(out) == 21
        for q in range(7):
            got = sorted((r.rank, -round(r.score, 9), r.id) for r in out if r.query_id == f"q{q}")
            assert [(s, d) for _, s, d in got] == want


def test_vector_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    vecs[7] = vecs[3]  # an exact tie
    items = spark.createDataFrame([item(f"v{i:03}", "x", scope="a" if i % 3 else "b", rev="r1" if i % 11 else "r2") for i in range(300)], ITEM)
    vectors = spark.createDataFrame([(f"v{i:03}", "r1", "fp" if i % 13 else "old", v.tolist()) for i, v in enumerate(vecs)], "id string, revision string, fingerprint string, vector array<float>").repartition(5)
    qs = rng.normal(size=(9, 8))
    qs[0] = vecs[3]
    q = ask(spark, *[(f"q{i}", "t", "vector") for i in range(9)])
    q = q.join(spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(qs)], "query_id string, query_vector array<double>"), "query_id").withColumn("candidate_limit", F.lit(12).cast("bigint"))
    monkeypatch.setattr(S, "VECTOR_CHUNK", 4)
    got = {}
    for r in S.search_vector(q, items, vectors, "fp", 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    ok = [i for i in range(300) if i % 3 and i % 11 and i % 13]
    for j in range(9):
        sims = {i: float(np.dot(vecs[i].astype(float), qs[j]) / (np.linalg.norm(vecs[i].astype(float)) * np.linalg.norm(qs[j]))) for i in ok}
        want = sorted(ok, key=lambda i: (-round(sims[i], 12), i))[:12]
        assert got[f"q{j}"] == [f"v{i:03}" for i in want]


def test_fusion(spark):
    cand = "query_id string, id string, revision string, score double, rank int, score_kind string"
    lex = spark.createDataFrame([("q", "a", "r1", 5.0, 1, "l"), ("q", "b", "r1", 4.0, 2, "l"), ("q", "b", "r1", 3.0, 3, "l")], cand)
    vec = spark.createDataFrame([("q", "b", "r1", 0.9, 1, "v"), ("q", "a", "r2", 0.8, 2, "v"), ("q", "c", "r1", 0.7, 3, "v")], cand)
    rows = {r.id: r for r in S.fuse(lex, vec, ask(spark, ("q", "t", "hybrid"))).collect()}
    assert math.isclose(rows["b"].score, 1 / 62 + 1 / 61)
    assert math.isclose(rows["a"].score, 1 / 61) and rows["a"].vec_rank is None
    assert math.isclose(rows["c"].score, 1 / 63) and rows["c"].lex_rank is None


def test_names_scopes_and_filters(spark):
    rows = [("a", True), ("a.b-c_1.2", True), ("A", False), ("a..b", False), ("a\n", False), ("1a", False), ("a" * 129, False)]
    got = spark.createDataFrame(rows, "n string, ok boolean").select(R.valid_name(F.col("n")).alias("v"), "ok").collect()
    assert all(r.v == r.ok for r in got)
    items = corpus(spark)
    got = X.match_filter(items, {"none": {"types": []}, "sub": {"namespaces": [{"value": "note", "subtree": True}]}, "eq": {"namespaces": [{"value": "notes"}]}}).groupBy("filter_id").count().collect()
    assert {r.filter_id: r["count"] for r in got} == {"eq": 6}


def test_empty_grants_see_nothing_and_malformed_fail_closed(spark):
    callers = spark.createDataFrame([("none", []), ("bad", [("global", "x")]), ("good", [("team", "b"), ("team", "b")])], "caller_id string, grants array<struct<kind:string,key:string>>")
    assert [tuple(r) for r in X.authorized(corpus(spark), callers).collect()] == [("good", "d3")]


def test_bad_rows_do_not_sink_their_batch(spark):
    def embed(texts):
        if any("sea" in t for t in texts):
            e = RuntimeError("native message with text")
            e.code = "OUT_OF_MEMORY"
            raise e
        return X.lcg_vectors(np.arange(len(texts)), 8)

    items = corpus(spark).withColumns({"vector_state": F.lit("pending"), "failure_stage": F.lit(None).cast("string"), "failure_code": F.lit(None).cast("string"), "indexed_at": F.lit(1).cast("bigint")})
    empty = spark.createDataFrame([], "id string, revision string, fingerprint string, vector array<float>")
    tables, report = X.drain(items, X.build_lexical(items.filter("lexical_state = 'ready'")), empty, embed, "fp", 8, 9)
    assert tuple(report.first()) == (6, 5, 1)
    states = {r.id: (r.lexical_state, r.vector_state, r.failure_code) for r in tables["items"].collect()}
    assert states["d3"] == ("ready", "failed", "OUT_OF_MEMORY") and states["d4"] == ("ready", "ready", None)


def test_late_vectors_are_discarded(spark):
    items = corpus(spark).withColumns({"failure_stage": F.lit(None).cast("string"), "failure_code": F.lit(None).cast("string"), "indexed_at": F.lit(1).cast("bigint")})
    empty = spark.createDataFrame([], "id string, revision string, fingerprint string, vector array<float>")
    new = spark.createDataFrame([("d1", "r0", [1.0]), ("d2", "r1", [1.0])], "id string, revision string, vector array<float>")
    _, vec = X.index_vectors(items, empty, new, "fp", 5)
    assert [r.id for r in vec.collect()] == ["d2"]


def vector_table(spark, *rows):
    return spark.createDataFrame([(i, "r1", "fp", v) for i, v in rows], "id string, revision string, fingerprint string, vector array<float>")


def with_vectors(q, v=(1.0, 0.0)):
    return q.withColumn("query_vector", F.array(*map(F.lit, v)).cast("array<float>"))


def test_batches_of_one_kind(spark):
    items, vectors = corpus(spark), vector_table(spark, ("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]))
    lexical = X.build_lexical(items)
    for rows in ([("q1", "river", "lexical")], [("q1", "river", "vector")], [("q1", " ", "hybrid")], []):
        q = ask(spark, *rows) if rows else ask(spark, ("q1", "river", "lexical")).limit(0)
        results, _, planned = S.search(with_vectors(q), items, lexical, vectors, "fp", 2)
        assert len({r.id for r in results.collect()}) == (2 if rows and rows[0][1].strip() else 0)
        assert planned.count() == len(rows)


def test_unusable_vector_degrades_only_who_sees_it(spark):
    items = corpus(spark)
    vectors = vector_table(spark, ("d1", [1.0, 0.0]), ("d3", [0.0, 0.0]), ("d6", [float("nan"), 1.0]))
    grants = F.array(F.struct(F.lit("team").alias("kind"), F.when(F.col("query_id").startswith("b"), "b").otherwise("c").alias("key")))
    q = spark.createDataFrame([("b1", "sea", "hybrid", True), ("b2", "sea", "vector", True), ("b3", "sea", "lexical", True), ("b4", "sea", "hybrid", False), ("c1", "sea", "hybrid", True)], "query_id string, text string, mode string, allow_degraded boolean")
    ok, _ = S.validate_queries(q.withColumn("grants", grants))
    results, _, planned = S.search(with_vectors(ok), items, X.build_lexical(items), vectors, "fp", 2)
    got = {r.query_id: (r.actual_mode, r.degraded_reason, r.error_code) for r in planned.collect()}
    assert got == {
        "b1": ("lexical", "vector_unavailable", None), "b2": (None, None, "vector_unavailable"), "b3": ("lexical", None, None),
        "b4": (None, None, "vector_unavailable"), "c1": ("hybrid", None, None),
    }
    assert {r.query_id for r in results.collect()} == {"b1", "b3"}


def test_repeated_query_ids_are_rejected(spark):
    q = spark.createDataFrame([("q", "a", "lexical"), ("q", "b", "lexical"), (None, "c", "lexical"), ("r", "d", "lexical")], "query_id string, text string, mode string")
    ok, bad = S.validate_queries(q.withColumn("grants", F.array(F.struct(F.lit("team").alias("kind"), F.lit("a").alias("key")))))
    assert [r.query_id for r in ok.collect()] == ["r"]
    assert {r.reject_code for r in bad.collect()} == {"invalid_query_id"} and bad.count() == 3


def test_every_phrase_counts(spark):
    q = ask(spark, ("q1", " ".join(f"word{i}" for i in range(100)), "lexical"))
    assert S.parse_queries(q).count() == 100


def test_gate_compares_runs_of_any_size(spark):
    from tracetally.operators import evaluate as V

    rng = np.random.default_rng(1)
    rows = []
    for run in ("apart", "close", "same"):
        vs = rng.normal(size=(300, 16))
        if run == "close":
            vs[211] = vs[17] * 3 + 1e-4
        if run == "same":
            vs[299] = vs[0]
        rows += [(run, i, v.tolist(), v.tolist(), 5, 5) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id string, position long, baseline array<double>, batch array<double>, baseline_tokens int, batch_tokens int")
    got = {r.run_id: (r.documents, r.outcome) for r in V.correctness_gate(df).collect()}
    assert got == {"apart": (300, "passed"), "close": (300, "BATCH_CORRECTNESS"), "same": (300, "BATCH_CORRECTNESS")}


def test_drain_takes_the_oldest_rows_that_pass(spark):
    items = corpus(spark).withColumns({"vector_state": F.lit("stale"), "failure_stage": F.lit(None).cast("string"), "failure_code": F.lit(None).cast("string"), "indexed_at": -F.substring("id", 2, 1).cast("bigint")})
    lexical = X.build_lexical(items.filter("lexical_state = 'ready'"))
    empty = spark.createDataFrame([], "id string, revision string, fingerprint string, vector array<float>")
    only = F.from_json(F.lit('{"scopes":[{"kind":"team","key":"a"}]}'), R.FILTER)
    tables, report = X.drain_some(items, lexical, empty, X.checksum_embedder(8), "fp", 8, 9, 3, only)
    assert tuple(report.first()) == (3, 3, 0, 0)
    assert sorted(r.id for r in tables["items"].filter("vector_state = 'ready'").collect()) == ["d4", "d5", "d6"]
    assert sorted(r.id for r in tables["vectors"].collect()) == ["d4", "d5", "d6"] and tables["items"].columns == items.columns
    tables, report = X.drain_some(items, lexical, empty, None, "fp", 8, 9, 2)
    assert tuple(report.first()) == (0, 0, 0, 2) and tables["vectors"].count() == 0
    assert {r.lexical_state for r in tables["items"].filter("id = 'd4'").collect()} == {"pending"}  # d6 and d5 came first
    for bad in (0, 1_001):
        try:
            X.drain_some(items, lexical, empty, None, "fp", 8, 9, bad)
            raise AssertionError("accepted")
        except ValueError as e:
            assert str(e) == "invalid_limit"
