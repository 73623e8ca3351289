"""Search and evaluation queries, with their reference SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.sizing import cut
from ..functions.vectors import cosine, l2_norm
from ..operators import evaluate as V
from ..operators import index as X
from ..operators import inverted as I
from ..operators import search as S
from ..operators import vector_index as N
from .derived import DEFS, table, with_ctes
from .retrieval import FP, items, vectors

DIMS = 64
DEFS.update(
    {
        "query_forms": """
SELECT 'q'||item_id AS query_id, CASE WHEN item_id % 19 = 18 THEN repeat('long ', 2000) WHEN item_id % 23 = 22 THEN ' ' ELSE text||' "'||regexp_extract(text, '[^ ]+ [^ ]+', 0)||'"' END AS text,
  CASE item_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'vector' ELSE 'hybrid' END AS mode, 't'||(item_id % 5) AS team,
  CASE WHEN item_id % 3 = 1 THEN '{"types":["document"]}' WHEN item_id % 3 = 2 THEN '{"namespaces":[{"value":"docs.en","subtree":true}],"created_from":5000}' END AS filter_json,
  CASE WHEN item_id % 17 = 16 THEN CAST(0 AS BIGINT) WHEN item_id % 5 = 4 THEN CAST(3 AS BIGINT) END AS result_limit, CASE WHEN item_id % 13 = 12 THEN CAST(501 AS BIGINT) WHEN item_id % 7 = 3 THEN CAST(20 AS BIGINT) END AS candidate_limit,
  CASE WHEN item_id % 29 = 28 THEN CAST(0.5 AS DOUBLE) END AS rrf_k, item_id % 11 <> 10 AS lexical_ok, item_id % 9 <> 8 AS embedding_loaded, item_id % 2 = 0 AS allow_degraded, item_id AS seed FROM benchmark""",
    }
)


def forms(s, d):
    q = table(s, d, "query_forms")
    grant = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("key"))
    return q.select(
        "query_id", "text", "mode", F.array(grant("team", F.col("team")), grant("global", F.lit("*"))).alias("grants"),
        F.from_json("filter_json", R.FILTER).alias("filter"), F.col("result_limit").alias("limit"), "candidate_limit", "rrf_k",
        "lexical_ok", "embedding_loaded", "allow_degraded", "seed",
    )


def good(s, d):
    ok, _ = S.validate_queries(forms(s, d))
    return X.synthetic_vectors(ok, "seed", DIMS, "query_vector")


def asking(s, d):
    return good(s, d).filter(F.col("text").rlike(R.NOT_BLANK))


def lexical(s, d):
    """The lexical index is a stored table that searches read several times."""
    return cut(X.build_lexical(items(s, d)))


def inverted_index(s, d):
    """The positional index as the searches read it: partitioned by word bucket."""
    return I.write_inverted(I.build_inverted(X.build_lexical(items(s, d))))


def validate_queries(s, d):
    ok, bad = S.validate_queries(forms(s, d))
    cols = ["query_id", "limit", "candidate_limit", "reject_code"]
    return ok.withColumn("reject_code", F.lit(None).cast("string")).select(*cols).unionByName(bad.select(*cols))


def parse_queries(s, d):
    return S.parse_queries(forms(s, d)).select("query_id", "phrase_no", F.array_join("words", " ").alias("phrase"))


def build_postings(s, d):
    post = X.build_postings(lexical(s, d))
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("id").alias("documents"), F.max("pos").alias("last_pos"))


def phrase_tf(s, d):
    _, ph = S.distinct_phrases(forms(s, d))
    return S.phrase_tf(X.build_lexical(items(s, d)), ph).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))


def _lex(s, d, method):
    out = S.search_lexical(asking(s, d), items(s, d, False), inverted_index(s, d), method)
    return out.select("query_id", "id", "revision", "rank", F.round("score", 6).alias("score"), "score_kind")


def vector_index(s, d):
    """Current vectors in clusters, as the searches read them."""
    return N.build_vector_index(vectors(s, d), FP, DIMS)


def search_vector(s, d):
    out = S.search_vector(asking(s, d), items(s, d, False), vector_index(s, d), FP, DIMS)
    return out.select("query_id", "id", "revision", "rank", F.round("score", 9).alias("score"), "score_kind")


def _all(s, d):
    return S.search(good(s, d), items(s, d, False), inverted_index(s, d), vector_index(s, d), FP, DIMS)


def search_hybrid(s, d):
    return _all(s, d)[0].select(
        "query_id", "id", "rank", "mode", F.round("score", 6).alias("score"), "lex_rank", F.round("lex_score", 6).alias("lex_score"), "vec_rank", F.round("vec_score", 6).alias("vec_score")
    )


def search_lexical_only(s, d):
    """A batch without any query that needs vectors."""
    asked = good(s, d).withColumns({"mode": F.lit("lexical"), "lexical_ok": F.lit(True)})
    out = S.search(asked, items(s, d, False), lexical(s, d), vectors(s, d), FP, DIMS)[0]
    return out.select("query_id", "id", "rank", "mode", F.round("score", 6).alias("score"), "lex_rank", "vec_rank")


def search_degraded(s, d):
    """Some stored vectors are zero: only the queries that may see one lose the vector side."""
    asked = good(s, d).withColumns({"lexical_ok": F.lit(True), "embedding_loaded": F.lit(True)})
    broken = F.col("id").substr(F.lit(2), F.length("id")).cast("long") % 97 == 5
    stored = vectors(s, d).withColumn("vector", F.when(broken, F.transform("vector", lambda x: x * F.lit(0.0).cast("float"))).otherwise(F.col("vector")))
    planned = S.search(asked, items(s, d, False), lexical(s, d), N.build_vector_index(stored, FP, DIMS), FP, DIMS)[2]
    return planned.select("query_id", "actual_mode", "degraded_reason", "error_code")


def search_modes(s, d):
    return S.plan_modes(forms(s, d)).select("query_id", "actual_mode", "degraded_reason", "error_code")


def search_summary(s, d):
    return S.search_summary(*_all(s, d), FP)


def materialize(s, d):
    lex = S.search_lexical(asking(s, d), items(s, d, False), lexical(s, d)).select("query_id", "id", "revision")
    moved = X.requeue(items(s, d, False), vectors(s, d), FP, "b9", stale_only=True).drop("requeued")
    return X.materialize(lex, moved, good(s, d)).select("query_id", "id")


def cosine_pairs(s, d):
    e = table(s, d, "retrieval_vectors")
    center = e.groupBy("label").agg(*[F.avg(F.col("vector")[i].cast("double")).alias(f"m{i}") for i in range(DIMS)])
    center = center.select("label", F.array(*[f"m{i}" for i in range(DIMS)]).alias("center"))
    return e.join(F.broadcast(center), "label").select("id", F.round(cosine(F.col("vector"), F.col("center")), 6).alias("cosine"))


def norms(s, d):
    huge = F.transform("embedding", lambda x: x.cast("double") * F.lit(1e200))
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"), F.round(l2_norm(huge) / 1e200, 6).alias("scaled_norm"))


def rank_similarity(s, d):
    e = table(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    pairs = e.join(F.broadcast(first), "label").select(
        F.col("label").cast("string").alias("query_id"), F.col("vec_id").alias("position"), "query_vector", F.col("embedding").alias("vector"), (F.col("vec_id") % 50).alias("tokens")
    )
    return V.rank_similarity(pairs).select("query_id", "position", "tokens", "rank", F.round("cosine", 6).alias("cosine"))


def qrels(s, d):
    """Documents that contain a query's whole passage, found with the phrase matcher."""
    passages = table(s, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit(" ")), F.lit('"')).alias("text"))
    per_query, ph = S.distinct_phrases(passages)
    return S.phrase_tf(X.build_lexical(items(s, d)), ph).join(F.broadcast(per_query), "phrase").select("query_id", "id")


def _evaluated(s, d):
    results, _, planned = _all(s, d)
    return V.evaluate(results, qrels(s, d), planned.select("query_id", "mode", "actual_mode", "error_code"))


def evaluate(s, d):
    rounded = [F.round(c, 9).alias(c) for c in ("recall3", "recall5")]
    return _evaluated(s, d).select("query_id", "mode", "actual_mode", "error_code", "first_relevant_rank", *rounded)


def eval_summary(s, d):
    cols = ["top1", "recall3", "recall5", "mrr"]
    return V.summarize_eval(_evaluated(s, d)).select("mode", "queries", "unavailable", *[F.round(c, 9).alias(c) for c in cols])


def check_stability(s, d):
    e = table(s, d, "embeddings")
    ends = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("related"), F.max_by("embedding", "vec_id").alias("unrelated"))
    noise = F.when(F.col("vec_id") % 3 == 0, 0.001).otherwise(0.00001)
    second = F.transform("embedding", lambda x: x.cast("double") + noise)
    rows = e.join(F.broadcast(ends), "label").select(F.col("vec_id").alias("id"), F.col("embedding").alias("first"), second.alias("second"), "related", "unrelated")
    out = V.check_stability(rows)
    return out.select("id", F.round("repeat_cosine", 6).alias("repeat_cosine"), F.round("max_absolute_difference", 6).alias("max_absolute_difference"), "stable_within_tolerance", "related_ranks_above_unrelated")


def correctness_gate(s, d):
    pos = F.col("vec_id")
    drift = F.when(pos % 90 == 7, 0.01).otherwise(0.0000001)
    rows = table(s, d, "embeddings").select(
        F.concat(F.lit("r"), F.floor(pos / 50).cast("string")).alias("run_id"), pos.alias("position"), F.col("embedding").alias("baseline"),
        F.transform("embedding", lambda x: x.cast("double") + drift).alias("batch"), (pos % 40).alias("baseline_tokens"), F.when(pos % 130 == 3, 1).otherwise(pos % 40).alias("batch_tokens"),
    )
    return V.correctness_gate(rows).select("run_id", "documents", F.round("minimum_cosine", 6).alias("minimum_cosine"), "outcome")


def summarize_vectors(s, d):
    e = table(s, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 300 + 1).alias("token_count"), F.when(F.col("vec_id") % 4 > 0, F.col("vec_id") % 4 - 1).alias("inference_ms")
    )
    out = V.summarize_vectors(e)
    head = F.aggregate("first12", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("id", "dimensions", F.round("norm", 6).alias("norm"), F.round(head, 6).alias("head_sum"), "token_count", F.round("tokens_per_ms", 9).alias("tokens_per_ms"))


QUERIES = {
    f.__name__: f
    for f in [
        validate_queries, parse_queries, build_postings, phrase_tf, search_vector, search_hybrid, search_lexical_only, search_degraded, search_modes, search_summary, materialize,
        cosine_pairs, norms, rank_similarity, evaluate, eval_summary, check_stability, correctness_gate, summarize_vectors,
    ]
}
QUERIES["search_bm25"] = partial(_lex, method="bm25")
QUERIES["search_tfidf"] = partial(_lex, method="tfidf")

# ---- reference SQL -------------------------------------------------------

W = "[\\p{L}\\p{N}]+"
FOLD = "strip_accents(lower({}))"
CHECKED = """chk AS (SELECT *, coalesce(result_limit, 10) AS lim, coalesce(candidate_limit, greatest(50, coalesce(result_limit, 10))) AS cand,
    CASE WHEN length(text) > 8192 THEN 'invalid_query' WHEN coalesce(result_limit, 10) < 1 OR coalesce(candidate_limit, 50) < coalesce(result_limit, 10) OR coalesce(candidate_limit, 50) > 500 THEN 'invalid_limit'
         WHEN coalesce(rrf_k, 60) < 1 THEN 'invalid_rrf' END AS code FROM query_forms)"""
PARSED = f""",
ph AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cn) - 1 AS pno, words FROM (SELECT query_id, cn, regexp_extract_all(chunk, '{W}') AS words
    FROM (SELECT query_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS cn FROM (SELECT query_id, regexp_extract_all({FOLD.format('text')}, '"[^"]*"|[^\\s"]+') AS chunks FROM chk))) WHERE len(words) > 0),
par AS (SELECT *, array_to_string(words, ' ') AS phrase FROM ph)"""
INDEXED = f""",
lex AS (SELECT id, regexp_extract_all({FOLD.format('content')}, '{W}') AS toks FROM retrieval_items),
post AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos, len(toks) AS n FROM lex),
uph AS (SELECT DISTINCT phrase, words FROM par),
pw AS (SELECT phrase, unnest(words) AS tok, generate_subscripts(words, 1) - 1 AS off, len(words) AS k FROM uph),
tf AS (SELECT phrase, id, n, count(*) AS tf FROM (SELECT phrase, id, n, pos - off AS at, any_value(k) AS k FROM post JOIN pw USING (tok) GROUP BY phrase, id, n, pos - off HAVING count(*) = any_value(k)) GROUP BY phrase, id, n),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
st AS (SELECT count(*)::DOUBLE AS nn, sum(len(toks))::DOUBLE / count(*) AS avgl FROM lex)"""
ALLOWED = """((scope_kind = 'team' AND scope_key = team) OR (scope_kind = 'global' AND scope_key = '*'))
   AND CASE CAST(substr(query_id, 2) AS BIGINT) % 3 WHEN 1 THEN type = 'document' WHEN 2 THEN (namespace = 'docs.en' OR namespace LIKE 'docs.en.%') AND created_at >= 5000 ELSE true END"""


def _score(method: str) -> str:
    if method == "tfidf":
        w = "(1 + ln(tf)) * ln(1 + nn / greatest(1, df))"
    else:
        idf = "CASE WHEN ln((nn - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - df + 0.5) / (df + 0.5)) END"
        w = f"({idf}) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / avgl))"
    return f""",
wt AS (SELECT phrase, id, CAST(round(({w}) * 1e12) AS BIGINT) AS w FROM tf JOIN df USING (phrase), st),
lsc AS (SELECT query_id, id, revision, cand, sum(w)::DOUBLE / 1e12 AS score FROM chk JOIN par USING (query_id) JOIN wt USING (phrase) JOIN retrieval_items USING (id)
   WHERE code IS NULL AND lexical_state = 'ready' AND {ALLOWED} GROUP BY ALL),
lexr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lsc) WHERE rank <= cand)"""


VECS = f"""
lcg AS (SELECT item_id, 0 AS pos, (1664525 * (item_id + 1) + 1013904223) % 4294967296 AS st FROM benchmark
   UNION ALL SELECT item_id, pos + 1, (1664525 * st + 1013904223) % 4294967296 FROM lcg WHERE pos < {DIMS - 1}),
qv AS (SELECT 'q'||item_id AS query_id, list(st / 4294967296.0 - 0.5 ORDER BY pos) AS qvec FROM lcg GROUP BY item_id),
vsc AS (SELECT query_id, i.id, i.revision, cand, list_cosine_similarity(qvec, CAST(vector AS DOUBLE[])) AS score FROM chk JOIN qv USING (query_id), retrieval_items i JOIN retrieval_vectors v ON v.id = i.id
   WHERE code IS NULL AND trim(text) <> '' AND v.fingerprint = '{FP}' AND v.revision = i.revision AND vector_state = 'ready' AND {ALLOWED}),
vecr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vsc) WHERE rank <= cand)"""
PLAN = """,
pl AS (SELECT *, trim(text) = '' AS blank, CASE WHEN trim(text) = '' THEN NULL WHEN mode = 'lexical' AND NOT lexical_ok THEN 'lexical_unavailable' WHEN mode = 'vector' AND NOT embedding_loaded THEN 'embedding_unavailable'
     WHEN mode = 'hybrid' AND NOT lexical_ok AND NOT allow_degraded THEN 'lexical_unavailable' WHEN mode = 'hybrid' AND NOT embedding_loaded AND (NOT allow_degraded OR NOT lexical_ok) THEN 'embedding_unavailable' END AS error_code,
   CASE WHEN trim(text) = '' OR mode <> 'hybrid' THEN mode WHEN NOT lexical_ok THEN 'vector' WHEN NOT embedding_loaded THEN 'lexical' ELSE 'hybrid' END AS am,
   CASE WHEN trim(text) <> '' AND mode = 'hybrid' THEN CASE WHEN NOT lexical_ok THEN 'lexical_unavailable' WHEN NOT embedding_loaded THEN 'embedding_unavailable' END END AS why FROM chk),
live AS (SELECT * FROM pl WHERE code IS NULL AND error_code IS NULL AND NOT blank)"""
MERGED = """,
lx AS (SELECT l.* FROM lexr l JOIN live USING (query_id) WHERE am <> 'vector'), vx AS (SELECT v.* FROM vecr v JOIN live USING (query_id) WHERE am <> 'lexical'),
mg AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.rank AS lr, l.score AS ls, v.rank AS vr, v.score AS vs FROM lx l FULL JOIN vx v ON v.query_id = l.query_id AND v.id = l.id),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT m.*, am, lim,
   CASE WHEN am = 'hybrid' THEN coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0) ELSE coalesce(ls, vs) END AS score FROM mg m JOIN live USING (query_id)
   JOIN retrieval_items i ON i.id = m.id WHERE vr IS NULL OR fingerprint = 'fp-new')),
fin AS (SELECT * FROM res WHERE rank <= lim)"""
RELEVANT = f""",
bq AS (SELECT 'q'||item_id AS query_id, ' '||array_to_string(regexp_extract_all({FOLD.format('text')}, '{W}'), ' ')||' ' AS p FROM benchmark),
rel AS (SELECT query_id, id FROM bq JOIN lex ON contains(' '||array_to_string(toks, ' ')||' ', p)),
ev AS (SELECT q.query_id, q.mode, CASE WHEN error_code IS NULL THEN q.am END AS actual_mode, error_code, min(f.rank) AS first_relevant_rank,
   count(CASE WHEN f.rank <= 3 THEN 1 END) / any_value(r.relevant) AS recall3, count(CASE WHEN f.rank <= 5 THEN 1 END) / any_value(r.relevant) AS recall5
  FROM pl q JOIN (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1) r USING (query_id) LEFT JOIN (SELECT fin.* FROM fin SEMI JOIN rel ON rel.query_id = fin.query_id AND rel.id = fin.id) f USING (query_id)
  WHERE q.code IS NULL GROUP BY ALL)"""
RI, RV = ["query_forms", "retrieval_items"], ["query_forms", "retrieval_items", "retrieval_vectors"]
FULL = CHECKED + PARSED + INDEXED + _score("bm25") + ",\n" + VECS + PLAN + MERGED


def _lex_sql(method: str) -> str:
    return with_ctes(
        RI,
        f"SELECT query_id, id, revision, rank, round(score, 6) AS score, '{S.SCORE_KIND[method]}' AS score_kind FROM lexr",
        extra=CHECKED + PARSED + INDEXED + _score(method),
    )


ORACLES = {
    "validate_queries": with_ctes(["query_forms"], "SELECT query_id, lim AS \"limit\", cand AS candidate_limit, code AS reject_code FROM chk", extra=CHECKED),
    "parse_queries": with_ctes(["query_forms"], "SELECT query_id, pno AS phrase_no, phrase FROM par", extra=CHECKED + PARSED),
    "build_postings": with_ctes(
        RI, "SELECT tok AS token, count(*) AS occurrences, count(DISTINCT id) AS documents, max(pos) AS last_pos FROM post GROUP BY tok", extra=CHECKED + PARSED + INDEXED
    ),
    "phrase_tf": with_ctes(
        RI, "SELECT phrase, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS max_tf FROM tf GROUP BY phrase", extra=CHECKED + PARSED + INDEXED
    ),
    "search_bm25": _lex_sql("bm25"),
    "search_tfidf": _lex_sql("tfidf"),
    "search_vector": with_ctes(
        RV, "SELECT query_id, id, revision, rank, round(score, 9) AS score, 'cosine' AS score_kind FROM vecr", recursive=True, extra=CHECKED + ",\n" + VECS
    ),
    "search_hybrid": with_ctes(
        RV, "SELECT query_id, id, rank, am AS mode, round(score, 6) AS score, lr AS lex_rank, round(ls, 6) AS lex_score, vr AS vec_rank, round(vs, 6) AS vec_score FROM fin", recursive=True, extra=FULL
    ),
    "search_lexical_only": with_ctes(
        RI, "SELECT query_id, id, rank, 'lexical' AS mode, round(score, 6) AS score, rank AS lex_rank, CAST(NULL AS INT) AS vec_rank FROM lexr JOIN chk USING (query_id) WHERE rank <= lim AND trim(text) <> ''",
        extra=CHECKED + PARSED + INDEXED + _score("bm25"),
    ),
    "search_degraded": with_ctes(
        RV,
        """SELECT query_id, CASE WHEN error_code IS NULL THEN CASE WHEN lost AND mode = 'hybrid' THEN 'lexical' ELSE mode END END AS actual_mode,
        CASE WHEN error_code IS NULL AND lost AND mode = 'hybrid' THEN 'vector_unavailable' END AS degraded_reason, error_code
        FROM (SELECT *, CASE WHEN lost AND (mode = 'vector' OR mode = 'hybrid' AND NOT allow_degraded) THEN 'vector_unavailable' END AS error_code
          FROM (SELECT *, query_id IN (SELECT query_id FROM blocked) AND trim(text) <> '' AS lost FROM chk WHERE code IS NULL))""",
        extra=CHECKED + f""",
blocked AS (SELECT DISTINCT query_id FROM chk, retrieval_items i JOIN retrieval_vectors v ON v.id = i.id
   WHERE v.fingerprint = '{FP}' AND v.revision = i.revision AND vector_state = 'ready' AND CAST(substr(i.id, 2) AS BIGINT) % 97 = 5 AND {ALLOWED})""",
    ),
    "search_modes": with_ctes(
        ["query_forms"], "SELECT query_id, CASE WHEN error_code IS NULL THEN am END AS actual_mode, CASE WHEN error_code IS NULL THEN why END AS degraded_reason, error_code FROM pl", extra=CHECKED + PLAN
    ),
    "search_summary": with_ctes(
        RV,
        """SELECT p.query_id, mode AS requested_mode, CASE WHEN error_code IS NULL THEN am END AS actual_mode, CASE WHEN error_code IS NULL THEN why END AS degraded_reason, error_code,
        (SELECT count(*) FROM lx WHERE lx.query_id = p.query_id) AS lexical_candidates, (SELECT count(*) FROM vx WHERE vx.query_id = p.query_id) AS vector_candidates,
        (SELECT count(*) FROM mg WHERE mg.query_id = p.query_id) AS merged, (SELECT count(*) FROM fin WHERE fin.query_id = p.query_id) AS final, 'fts5_unicode61' AS lexical_backend, 'exact_flat' AS vector_backend,
        CASE WHEN error_code IS NULL AND am IN ('vector', 'hybrid') AND trim(text) <> '' THEN 'fp-new' END AS fingerprint, CASE WHEN mode = 'hybrid' THEN coalesce(rrf_k, 60.0)::DOUBLE END AS rrf_k,
        CASE WHEN mode = 'hybrid' THEN 1.0::DOUBLE END AS weight_lexical, CASE WHEN mode = 'hybrid' THEN 1.0::DOUBLE END AS weight_vector
        FROM pl p WHERE code IS NULL""",
        recursive=True,
        extra=FULL,
    ),
    "materialize": with_ctes(
        RV,
        """SELECT query_id, l.id FROM lexr l JOIN retrieval_items i ON i.id = l.id LEFT JOIN retrieval_vectors v ON v.id = i.id
        WHERE NOT (i.vector_state = 'stale' OR coalesce(v.fingerprint <> 'fp-new' OR v.revision <> i.revision, false))""",
        extra=CHECKED + PARSED + INDEXED + _score("bm25"),
    ),
    "cosine_pairs": with_ctes(
        ["retrieval_vectors"],
        """SELECT id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), center), 6) AS cosine FROM retrieval_vectors JOIN (SELECT label, list(m ORDER BY pos) AS center FROM
        (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM retrieval_vectors) GROUP BY label, pos) GROUP BY label) USING (label)""",
    ),
    "norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS scaled_norm FROM embeddings",
    "rank_similarity": """SELECT label::VARCHAR AS query_id, vec_id AS position, vec_id % 50 AS tokens, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS rank, round(c, 6) AS cosine
        FROM (SELECT e.*, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label) USING (label))""",
    "evaluate": with_ctes(
        RV, "SELECT query_id, mode, actual_mode, error_code, first_relevant_rank, round(recall3, 9) AS recall3, round(recall5, 9) AS recall5 FROM ev", recursive=True, extra=FULL + RELEVANT
    ),
    "eval_summary": with_ctes(
        RV,
        """SELECT m.mode, count(CASE WHEN ok THEN 1 END) AS queries, count(CASE WHEN NOT ok THEN 1 END) AS unavailable, round(avg(CASE WHEN ok THEN CASE WHEN first_relevant_rank = 1 THEN 1.0 ELSE 0.0 END END), 9) AS top1,
        round(avg(CASE WHEN ok THEN recall3 END), 9) AS recall3, round(avg(CASE WHEN ok THEN recall5 END), 9) AS recall5, round(avg(CASE WHEN ok THEN coalesce(1.0::DOUBLE / first_relevant_rank, 0) END), 9) AS mrr
        FROM (SELECT unnest(['lexical', 'vector', 'hybrid']) AS mode) m LEFT JOIN (SELECT *, error_code IS NULL AND actual_mode = mode AS ok FROM ev) e ON e.mode = m.mode GROUP BY m.mode""",
        recursive=True,
        extra=FULL + RELEVANT,
    ),
    "check_stability": """SELECT vec_id AS id, round(list_cosine_similarity(a, b), 6) AS repeat_cosine, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) AS max_absolute_difference, vec_id % 3 <> 0 AS stable_within_tolerance,
        list_cosine_similarity(a, CAST(lo AS DOUBLE[])) > list_cosine_similarity(a, CAST(hi AS DOUBLE[])) AS related_ranks_above_unrelated
        FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN vec_id % 3 = 0 THEN 0.001 ELSE 0.00001 END) AS b FROM embeddings
        JOIN (SELECT label, arg_min(embedding, vec_id) AS lo, arg_max(embedding, vec_id) AS hi FROM embeddings GROUP BY label) USING (label))""",
    "correctness_gate": """WITH e AS (SELECT vec_id, 'r'||(vec_id // 50) AS run_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN vec_id % 90 = 7 THEN 0.01 ELSE 0.0000001 END) AS b FROM embeddings),
        near AS (SELECT x.run_id, max(list_cosine_similarity(x.a, y.a)) AS closest FROM e x JOIN e y ON x.run_id = y.run_id AND x.vec_id < y.vec_id GROUP BY 1)
        SELECT e.run_id, count(*) AS documents, round(min(list_cosine_similarity(a, b)), 6) AS minimum_cosine,
        CASE WHEN any_value(closest) >= 0.99999 OR min(list_cosine_similarity(a, b)) < 0.99999 OR bool_or(vec_id % 130 = 3 AND vec_id % 40 <> 1) THEN 'BATCH_CORRECTNESS' ELSE 'passed' END AS outcome
        FROM e JOIN near USING (run_id) GROUP BY e.run_id""",
    "summarize_vectors": """SELECT vec_id AS id, len(embedding) AS dimensions, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding[1:12], lambda x: x::DOUBLE)), 6) AS head_sum,
        vec_id % 300 + 1 AS token_count, CASE WHEN vec_id % 4 > 1 THEN round((vec_id % 300 + 1) / (vec_id % 4 - 1), 9) END AS tokens_per_ms FROM embeddings""",
}
