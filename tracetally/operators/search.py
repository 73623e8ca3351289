"""Bulk lexical, vector and hybrid search under access grants and filters.

A table of queries is answered at once. The corpus is scanned one time per
chunk of queries; only matches and per-partition top-k rows are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.sizing import chunks_for, cut
from ..functions.text import phrases
from . import inverted
from .vector_index import HIT, SCORE_SLACK, Asks, VectorIndex, scan_blocks, unclustered

PHRASES = 200_000  # phrases per scan on average: a hash deals them over the scans
QUERY_CHUNK = 4_000  # lexical queries per scan: their text (<= 8 KB), grants and filter (<= 60 KB) are broadcast
VECTOR_CHUNK = 8_192  # query vectors per scan held by each task, fewer where these are reached:
VECTOR_BYTES = 64 << 20  # bytes of query vectors, and of filters
KEPT = 400_000  # candidates that a task keeps
MAX_CANDIDATES = 500
K1, B = 1.2, 0.75  # BM25 constants
SCALE = 1e12  # scores are summed as scaled integers: exact, so equal documents tie exactly
DEFAULTS = {"limit": 10, "rrf_k": 60.0, "weight_lexical": 1.0, "weight_vector": 1.0}


def validate_queries(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok with defaults filled in, rejects). Columns: query_id, text, mode, grants, filter,
    limit, candidate_limit, rrf_k, weight_lexical, weight_vector; absent ones take the default."""
    missing = {"limit": "bigint", "candidate_limit": "bigint", "rrf_k": "double", "weight_lexical": "double", "weight_vector": "double", "filter": R.FILTER}
    q = q.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in q.columns})
    q = q.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    q = q.withColumn("candidate_limit", F.coalesce("candidate_limit", F.greatest(F.lit(50), F.col("limit"))))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    wl, wv, k = F.col("weight_lexical"), F.col("weight_vector"), F.col("rrf_k")
    text_ok = F.col("mode").isin("lexical", "vector", "hybrid") & R.within(F.col("text"), 8192)
    limit_ok = F.col("limit").between(1, 100) & (F.col("candidate_limit") >= F.col("limit")) & (F.col("candidate_limit") <= MAX_CANDIDATES)
    rrf_ok = finite(k) & k.between(1, 10_000) & finite(wl) & finite(wv) & (wl >= 0) & (wv >= 0) & (wl + wv > 0)
    twice = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1
    code = (
        F.when(F.col("query_id").isNull() | twice, "invalid_query_id")
        .when(~R.valid_grants(F.col("grants")), "invalid_access")
        .when(~R.valid_filter(F.col("filter")), "invalid_filter")
        .when(R.no(text_ok), "invalid_query")
        .when(R.no(limit_ok), "invalid_limit")
        .when(R.no(rrf_ok), "invalid_rrf")
    )
    q = q.withColumn("reject_code", code)
    return q.filter(F.col("reject_code").isNull()).drop("reject_code"), q.filter(F.col("reject_code").isNotNull())


def parse_queries(q: DataFrame) -> DataFrame:
    """(query_id, phrase_no, words): the OR-ed phrases of every query."""
    return q.select("query_id", F.posexplode(phrases(F.col("text"))).alias("phrase_no", "words"))


def in_chunks(q: DataFrame, per_chunk: int) -> list[DataFrame]:
    """Split a query table by id hash so that every part is proven to fit ``per_chunk`` rows. Ids must be unique."""
    rows = q.count()
    n = chunks_for(rows, per_chunk)
    if n == 1:
        return [q]
    while n <= 2 * rows:
        part = F.pmod(F.xxhash64("query_id"), F.lit(n))
        if q.groupBy(part.alias("p")).count().agg(F.max("count")).first()[0] <= per_chunk:
            return [q.filter(part == i) for i in range(n)]
        n += max(1, n // 4)
    raise ValueError("query_id must be unique; validate_queries rejects repeated ids")


# ---- access and filters --------------------------------------------------

def _policy_key() -> Column:
    return F.to_json(F.struct(F.array_sort(F.array_distinct("grants")).alias("g"), F.col("filter").alias("f")))


def policies(q: DataFrame) -> DataFrame:
    """Numbered distinct (grants, filter) pairs of one chunk of query vectors."""
    distinct = q.groupBy(_policy_key().alias("policy_key")).agg(F.any_value("grants").alias("grants"), F.any_value("filter").alias("filter"))
    return distinct.withColumn("policy", F.row_number().over(Window.orderBy("policy_key")) - 1)


def visible(items: DataFrame, pol: DataFrame) -> DataFrame:
    """(id, revision, policies): for each item the numbers of the policies that may see it.

    Policies are packed per granted scope, so the equi-join on the scope returns
    at most one row per item; the filters are then tested inside the row.
    """
    by_scope = (
        pol.select("policy", "filter", F.explode(F.array_distinct("grants")).alias("g"))
        .groupBy(F.col("g.kind").alias("g_kind"), F.col("g.key").alias("g_key"))
        .agg(F.collect_list(F.struct("policy", "filter")).alias("may"))
    )
    seen = items.filter(R.valid_scope(F.col("scope_kind"), F.col("scope_key")))
    seen = seen.join(F.broadcast(by_scope), (F.col("scope_kind") == F.col("g_kind")) & (F.col("scope_key") == F.col("g_key")))
    allowed = F.transform(F.filter("may", lambda p: R.matches(p["filter"])), lambda p: p["policy"])
    return seen.select("id", "revision", allowed.alias("policies")).filter(F.size("policies") > 0)


# ---- lexical -------------------------------------------------------------


def phrase_tf(lexical: DataFrame, ph: DataFrame) -> DataFrame:
    """(id, n_tokens, phrase, tf): how often each distinct phrase starts in each document.

    ``ph`` holds (phrase, words). Documents are scanned once for each bounded chunk of phrases,
    a bounded number of documents at a time; nothing is shuffled.
    """
    ph = cut(ph)
    n = chunks_for(ph.count(), PHRASES)
    parts = []
    for i in range(n):
        tf, numbers = inverted.scan_phrases(lexical, ph.filter(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i))
        names = ph.sparkSession.createDataFrame([(k, p) for p, k in numbers.items()], "phrase int, name string")
        parts.append(tf.join(F.broadcast(names), "phrase").select("id", "n_tokens", F.col("name").alias("phrase"), "tf"))
    return reduce(DataFrame.unionByName, parts)


def distinct_phrases(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrases by query with multiplicity, distinct phrases)."""
    parsed = parse_queries(q).withColumn("phrase", F.array_join("words", " "))
    per_query = parsed.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("times"))
    return per_query, parsed.groupBy("phrase").agg(F.min("words").alias("words"))


SCORE_KIND = {"bm25": "fts5_negative_bm25", "tfidf": "fts4_tf_idf", "cosine": "cosine"}


def widest(q: DataFrame) -> int:
    """The largest candidate limit that a query of the chunk asks for."""
    return q.agg(F.max("candidate_limit")).first()[0] or 1


def _top(scored: DataFrame, limit: int) -> DataFrame:
    """Rank per query by (score desc, id) and keep each query's candidate_limit.

    ``limit`` is the largest of them: a constant, so Spark cuts every partition to its own top rows before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.filter(F.col("rank") <= F.col("candidate_limit")).drop("candidate_limit")


def search_lexical(q: DataFrame, items: DataFrame, lexical: DataFrame, method: str = "bm25") -> DataFrame:
    """(query_id, id, revision, score, rank, score_kind) for validated queries.

    Phrase statistics cover the whole index; readiness, access and filter apply
    before the candidate limit.
    """
    parts = [_lexical_chunk(c, items, lexical, method) for c in in_chunks(q, QUERY_CHUNK)]
    return reduce(DataFrame.unionByName, parts)


def _lexical_chunk(q: DataFrame, items: DataFrame, lexical: DataFrame, method: str) -> DataFrame:
    """Scores from the inverted index or a scan: phrase statistics first, then every shard's best candidates."""
    q = cut(q)
    per_query, ph = distinct_phrases(q)
    if inverted.is_inverted(lexical):
        n, length, shards = inverted.totals(lexical)
        hits, numbers = inverted.phrase_hits(lexical, cut(ph))
    else:
        n, length = (int(x or 0) for x in lexical.agg(F.count(F.lit(1)), F.sum("n_tokens")).first())
        shards = inverted.shards_for(n, q.sparkSession)
        hits, numbers = inverted.scan_hits(lexical, cut(ph), shards)
    hits = cut(hits)
    df = np.ones(max(1, len(numbers)))
    for r in hits.groupBy("phrase").agg(F.sum(F.size("ids")).alias("df")).collect():  # the chunk's phrases
        df[r["phrase"]] = r["df"]
    pol = cut(policies(q))
    asked = q.withColumn("policy_key", _policy_key()).join(pol.select("policy_key", "policy"), "policy_key").select("query_id", "policy", "candidate_limit")
    said = per_query.groupBy("query_id").agg(F.collect_list(F.struct("phrase", "times")).alias("said"))
    queries = []
    for r in asked.join(said, "query_id").collect():  # at most QUERY_CHUNK rows
        phrases_of = sorted((numbers[s["phrase"]], s["times"]) for s in r["said"])
        queries.append({"query_id": r["query_id"], "policy": r["policy"], "candidate_limit": r["candidate_limit"], "phrases": tuple(np.array(x) for x in zip(*phrases_of))})

    def weigh(phrase: np.ndarray, tf: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        d, tf = df[phrase], tf.astype(np.float64)
        if method == "tfidf":
            w = (1 + np.log(tf)) * np.log(1 + n / np.maximum(1.0, d))
        else:
            idf = np.log((n - d + 0.5) / (d + 0.5))
            w = np.where(idf <= 0, 1e-6, idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * n_tokens / (length / n)))
        return np.floor(w * SCALE + 0.5).astype(np.int64)

    ready = visible(items.filter(F.col("lexical_state") == "ready"), pol)
    dealt = [x.repartition(shards, "shard") for x in (hits, inverted.shards_of(ready, shards))]  # no partition grows with the documents
    best = inverted.best_of_shards(*dealt, queries, weigh, SCALE)
    return _top(best, widest(q)).withColumn("score_kind", F.lit(SCORE_KIND[method]))


# ---- vector --------------------------------------------------------------


def vector_chunk(q: DataFrame, dims: int) -> int:
    """Queries a task may hold: bounded by the bytes of their vectors, by the candidates they keep and by their filters."""
    size = q.agg(F.max("candidate_limit").alias("k"), F.max(F.length(_policy_key())).alias("filter")).first()
    return max(1, min(VECTOR_CHUNK, VECTOR_BYTES // (8 * dims), KEPT // (size["k"] or 1), VECTOR_BYTES // (size["filter"] or 1)))


def search_vector(q: DataFrame, items: DataFrame, vectors: DataFrame | VectorIndex, fingerprint: str, dims: int) -> DataFrame:
    """Exact cosine top-k of query vectors (column ``query_vector``) over the eligible vectors.

    Eligible: same fingerprint and dimensions, finite with a positive norm, current revision,
    state ready, visible to the query. Each task keeps its own top-k per query. In a
    ``VectorIndex`` of that fingerprint whole blocks are skipped; of a plain table every
    vector is compared. ``search`` marks the queries that can see a stored vector which is
    not usable.
    """
    index = as_index(vectors, fingerprint, dims)
    parts = [_vector_chunk(c, items, index) for c in in_chunks(q, vector_chunk(q, dims))]
    found = reduce(DataFrame.unionByName, [hits for hits, _ in parts])
    return _top(found, widest(q)).withColumn("score_kind", F.lit(SCORE_KIND["cosine"]))


def vector_work(q: DataFrame, items: DataFrame, vectors: DataFrame | VectorIndex, fingerprint: str, dims: int) -> DataFrame:
    """One row: (vector, query) pairs there are, pairs the search compares, and the share it skips."""
    index = as_index(vectors, fingerprint, dims)
    work = reduce(DataFrame.unionByName, [w for c in in_chunks(q, vector_chunk(q, dims)) for _, w in [_vector_chunk(c, items, index)]])
    work = work.agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"))
    return work.select("pairs", "compared", (1 - F.try_divide("compared", "pairs")).alias("skipped"))


def as_index(vectors: DataFrame | VectorIndex, fingerprint: str, dims: int) -> VectorIndex:
    return vectors if isinstance(vectors, VectorIndex) else unclustered(vectors, fingerprint, dims)


def blocked_queries(q: DataFrame, items: DataFrame, vectors: DataFrame | VectorIndex, fingerprint: str, dims: int) -> DataFrame:
    """query_id of the queries that may see a current stored vector which is not usable."""
    broken = as_index(vectors, fingerprint, dims).rows.filter(~F.col("usable")).select("id", "revision")
    ready = items.filter(F.col("vector_state") == "ready").join(broken, ["id", "revision"], "left_semi")
    asked = q.filter(F.col("mode") != "lexical")
    parts = []
    for chunk in in_chunks(asked, vector_chunk(asked, dims)):
        pol = policies(chunk)
        seen = visible(ready, pol).select(F.explode("policies").alias("policy")).distinct()
        keyed = chunk.select("query_id", _policy_key().alias("policy_key")).join(pol.select("policy_key", "policy"), "policy_key")
        parts.append(keyed.join(seen, "policy", "left_semi").select("query_id"))
    return reduce(DataFrame.unionByName, parts)


def _vector_chunk(q: DataFrame, items: DataFrame, index: VectorIndex) -> tuple[DataFrame, DataFrame]:
    """(hits of every task, its counts of pairs) for one bounded chunk of queries."""
    pol = policies(q)
    numbered = q.withColumn("policy_key", _policy_key()).join(pol.select("policy_key", "policy"), "policy_key")
    rows = numbered.select("query_id", "query_vector", "policy", "candidate_limit").collect()  # at most a chunk
    if not rows:
        none = q.sparkSession.createDataFrame([], HIT)
        return none.drop("compared", "pairs"), none.select("compared", "pairs")
    asks = Asks(
        [r["query_id"] for r in rows],
        np.array([r["query_vector"] for r in rows], dtype=np.float64).reshape(len(rows), -1),
        np.array([r["candidate_limit"] for r in rows], dtype=np.int64),
        np.array([r["policy"] for r in rows], dtype=np.int64),
    )
    ready = visible(items.filter(F.col("vector_state") == "ready"), pol)
    eligible = index.rows.filter("usable").drop("usable").join(ready, ["id", "revision"])
    parts, homes = [], None
    if len(index.pivots):
        eligible = cut(eligible.repartition("block").sortWithinPartitions("block"))  # scanned twice
        homes = asks.homes(index)
        nearest = cut(scan_blocks(eligible, asks, index.pivots, homes))
        kth = _top(nearest.filter(F.col("query_id").isNotNull()), int(asks.limits.max()))
        kth = kth.groupBy("query_id").agg(F.max("rank").alias("found"), F.min("score").alias("least"))
        of_query = {r["query_id"]: r for r in kth.collect()}  # at most a chunk
        for j, name in enumerate(asks.names):
            if name in of_query and of_query[name]["found"] == asks.limits[j]:
                asks.need[j] = of_query[name]["least"]
        nearest = nearest.withColumn("pairs", F.lit(0).cast("long"))  # counted by the second scan
        homes = ~homes
        met = np.flatnonzero((homes & (asks.by_cluster(index) >= asks.need[:, None] - SCORE_SLACK)).any(axis=0)).tolist()
        skipped = eligible.filter(~F.col("cluster").isin(met)).agg((F.count(F.lit(1)) * len(rows)).alias("pairs"))
        parts = [nearest, skipped.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "pairs" else "pairs" for f in nearest.schema])]
        eligible = eligible.filter(F.col("cluster").isin(met))
    scored = reduce(DataFrame.unionByName, parts, scan_blocks(eligible, asks, index.pivots, homes))
    hits = scored.filter(F.col("query_id").isNotNull()).drop("compared", "pairs")
    return hits, scored.filter(F.col("query_id").isNull()).select("compared", "pairs")


# ---- fusion, guarded results ---------------------------------------------


def fuse(lexical: DataFrame, vector: DataFrame, q: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion per query: weight / (k + rank), summed over the modalities.

    An id counts once per modality (its best rank). A vector candidate of another
    revision than the lexical one is dropped.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        best = df.groupBy("query_id", "id").agg(F.min_by(F.struct("revision", "rank", "score", "score_kind"), "rank").alias("b"))
        return best.select("query_id", "id", *[F.col(f"b.{c}").alias(f"{p}_{c}") for c in ("revision", "rank", "score", "score_kind")])

    both = side(lexical, "lex").join(side(vector, "vec"), ["query_id", "id"], "full_outer")
    keep_vec = F.col("vec_rank").isNotNull() & (F.col("lex_rank").isNull() | (F.col("lex_revision") == F.col("vec_revision")))
    both = both.withColumns({f"vec_{c}": F.when(keep_vec, F.col(f"vec_{c}")) for c in ("rank", "score", "score_kind")})
    cfg = q.select("query_id", "rrf_k", "weight_lexical", "weight_vector")
    out = both.join(cfg, "query_id")
    score = F.coalesce(F.col("weight_lexical") / (F.col("rrf_k") + F.col("lex_rank")), F.lit(0.0)) + F.coalesce(
        F.col("weight_vector") / (F.col("rrf_k") + F.col("vec_rank")), F.lit(0.0)
    )
    return out.select(
        "query_id", "id", F.coalesce("lex_revision", "vec_revision").alias("revision"), score.alias("score"),
        "lex_rank", "lex_score", "lex_score_kind", "vec_rank", "vec_score", "vec_score_kind",
    )


def plan_modes(q: DataFrame) -> DataFrame:
    """actual_mode, degraded_reasons and error_code per query from capability flags.

    Flags: lexical_ok, embedding_loaded, fingerprint_ok, vector_ok; allow_degraded
    lets a hybrid query fall back to the modality that is left. Blank text asks nothing.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in q.columns else F.lit(True)
    lex_bad = ~flag("lexical_ok")
    vec_code = (
        F.when(~flag("embedding_loaded"), "embedding_unavailable")
        .when(~flag("fingerprint_ok"), "fingerprint_changed")
        .when(~flag("vector_ok"), "vector_unavailable")
    )
    allow = F.coalesce(F.col("allow_degraded"), F.lit(False)) if "allow_degraded" in q.columns else F.lit(False)
    mode = F.col("mode")
    hybrid = mode == "hybrid"
    blank = ~F.col("text").rlike(R.NOT_BLANK)
    error = (
        F.when(blank, None)
        .when((mode == "lexical") & lex_bad, "lexical_unavailable")
        .when((mode == "vector") & vec_code.isNotNull(), vec_code)
        .when(hybrid & lex_bad & ~allow, "lexical_unavailable")
        .when(hybrid & vec_code.isNotNull() & (~allow | lex_bad), vec_code)
    )
    actual = F.when(blank | ~hybrid, mode).when(lex_bad, "vector").when(vec_code.isNotNull(), "lexical").otherwise("hybrid")
    reason = F.when(~blank & hybrid, F.when(lex_bad, "lexical_unavailable").otherwise(vec_code))
    return q.withColumns(
        {
            "blank": blank,
            "error_code": error,
            "actual_mode": F.when(error.isNull(), actual),
            "degraded_reason": F.when(error.isNull(), reason),
        }
    )


def search(q: DataFrame, items: DataFrame, lexical: DataFrame, vectors: DataFrame | VectorIndex, fingerprint: str, dims: int, method: str = "bm25"):
    """(results, merged candidates, planned queries) of validated queries of any mode.

    Every candidate is checked once more against access, filter, revision and
    readiness before it becomes a result; ranks are then renumbered and cut.
    """
    blocked = blocked_queries(q, items, vectors, fingerprint, dims).withColumn("_blocked", F.lit(True))
    vector_ok = F.coalesce(F.col("vector_ok"), F.lit(False)) if "vector_ok" in q.columns else F.lit(True)
    q = q.join(blocked, "query_id", "left").withColumn("vector_ok", vector_ok & F.col("_blocked").isNull()).drop("_blocked")
    planned = cut(plan_modes(q))  # read by both searches, the fusion and the last checks
    live = planned.filter(F.col("error_code").isNull() & ~F.col("blank"))
    lex = search_lexical(live.filter(F.col("actual_mode") != "vector"), items, lexical, method)
    vec = search_vector(live.filter(F.col("actual_mode") != "lexical"), items, vectors, fingerprint, dims)
    modes = live.select("query_id", "actual_mode", F.col("limit").alias("result_limit"))
    merged = fuse(lex, vec, live).join(modes, "query_id")
    single = F.col("actual_mode") != "hybrid"
    merged = merged.withColumn("score", F.when(single, F.coalesce("lex_score", "vec_score")).otherwise(F.col("score")))
    state = items.select(
        "id", F.col("revision").alias("item_revision"), "namespace", "type", "source_system", "source_type", "source_id", "created_at",
        "updated_at", "scope_kind", "scope_key", "lexical_state", "vector_state", "fingerprint",
    )
    checked = (
        merged.join(state, "id")
        .join(live.select("query_id", "grants", "filter"), "query_id")
        .filter(F.col("revision") == F.col("item_revision"))
        .filter(R.granted(F.col("grants")) & R.matches(F.col("filter")))
        .filter(F.col("lex_rank").isNull() | (F.col("lexical_state") == "ready"))
        .filter(F.col("vec_rank").isNull() | ((F.col("vector_state") == "ready") & (F.col("fingerprint") == fingerprint)))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    results = (
        checked.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= F.col("result_limit"))
        .select("query_id", "id", "rank", "score", F.col("actual_mode").alias("mode"), "lex_rank", "lex_score", "lex_score_kind", "vec_rank", "vec_score", "vec_score_kind")
    )
    return results, merged, planned


def search_summary(results: DataFrame, merged: DataFrame, planned: DataFrame, fingerprint: str, method: str = "bm25") -> DataFrame:
    """Per query: modes, degradation, candidate counts, backend names, the embedding fingerprint
    where vectors were asked, and the fusion settings of hybrid queries."""
    found = merged.groupBy("query_id").agg(
        F.count("lex_rank").alias("lexical_candidates"), F.count("vec_rank").alias("vector_candidates"), F.count(F.lit(1)).alias("merged")
    )
    final = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("final"))
    out = planned.join(found, "query_id", "left").join(final, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "query_id", F.col("mode").alias("requested_mode"), "actual_mode", "degraded_reason", "error_code",
        zero("lexical_candidates"), zero("vector_candidates"), zero("merged"), zero("final"),
        F.lit("fts5_unicode61" if method == "bm25" else "fts4_unicode61").alias("lexical_backend"), F.lit("exact_flat").alias("vector_backend"),
        F.when(F.col("actual_mode").isin("vector", "hybrid") & ~F.col("blank"), F.lit(fingerprint)).alias("fingerprint"),
        *[F.when(F.col("mode") == "hybrid", F.col(c)).alias(c) for c in ("rrf_k", "weight_lexical", "weight_vector")],
    )
