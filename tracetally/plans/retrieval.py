"""Queries over the retrieval index and its states, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import index as X
from .derived import DEFS, table, with_ctes

AT = 5_000_000
DEFS.update(
    {
        "item_candidates": """
SELECT 'd'||doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'Docs.'||lang WHEN doc_id % 43 = 0 THEN 'docs..'||lang ELSE 'docs.'||lang END AS namespace, 'document' AS type, source AS source_system,
  'record' AS source_type, CASE WHEN doc_id % 47 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR(20)) END AS source_id, CASE WHEN doc_id % 37 = 0 THEN '   ' ELSE text END AS content,
  CAST(doc_id * 1000 AS BIGINT) AS created_at, CAST(doc_id * 1000 + doc_id % 50 - 1 AS BIGINT) AS updated_at, CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE 'team' END AS scope_kind,
  CASE WHEN doc_id % 20 = 0 THEN '*' ELSE 't'||(doc_id % 5) END AS scope_key,
  CASE doc_id % 9 WHEN 1 THEN '{"a":{"b":[1,2,{"c":null}]},"s":"}]{"}' WHEN 2 THEN '[1]' WHEN 3 THEN repeat('{"a":', 19)||'1'||repeat('}', 19) WHEN 4 THEN repeat('{"a":', 20)||'1'||repeat('}', 20)
    WHEN 5 THEN '{"a":' WHEN 6 THEN '{}' END AS metadata_json, CASE WHEN doc_id % 53 = 0 THEN CAST(0 AS BIGINT) WHEN doc_id % 2 = 0 THEN CAST(3 AS BIGINT) END AS projection_version FROM documents""",
        "incoming": """
SELECT 'd'||doc_id AS id, 'docs.'||lang AS namespace, 'document' AS type, CASE WHEN doc_id % 41 = 0 THEN 'moved' ELSE source END AS source_system, 'record' AS source_type, CAST(doc_id AS VARCHAR(20)) AS source_id,
  CASE WHEN doc_id % 3 = 0 THEN text||' revised' ELSE text END AS content, CAST(doc_id * 1000 AS BIGINT) AS created_at, CAST(doc_id * 1000 + doc_id % 50 + (doc_id % 7 - 1) AS BIGINT) AS updated_at,
  'team' AS scope_kind, 't'||(doc_id % 5) AS scope_key, CAST(1 AS BIGINT) AS projection_version, doc_id AS seq FROM documents
UNION ALL SELECT 'd'||l.doc_id AS id, 'docs.q'||quality AS namespace, 'document' AS type, CASE WHEN toxic = 1 THEN 'labeller' ELSE d.source END AS source_system, 'record' AS source_type, CAST(l.doc_id AS VARCHAR(20)) AS source_id,
  'quality '||quality AS content, CAST(l.doc_id * 1000 AS BIGINT) AS created_at, CAST(l.doc_id * 1000 + 25 AS BIGINT) AS updated_at, 'team' AS scope_kind, 't8' AS scope_key, CAST(2 AS BIGINT) AS projection_version, 2000000 + l.doc_id AS seq
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
UNION ALL SELECT 'p'||page_id, 'pages', 'page', 'web', 'html', CAST(page_id - page_id % 7 % 2 AS VARCHAR(20)), html, CAST(page_id AS BIGINT), CAST(page_id + 1 AS BIGINT), 'global', '*', CAST(1 AS BIGINT), 3000000 + page_id FROM pages""",
        "reported_failures": """
SELECT 'd'||doc_id AS id, CASE WHEN quality = 1 THEN 'r1' ELSE 'r0' END AS revision, CASE WHEN toxic = 1 THEN 'lexical' ELSE 'vector' END AS stage,
  CASE WHEN doc_id % 3 = 0 THEN 'native error: /private/path' ELSE 'OUT_OF_MEMORY' END AS code FROM labels""",
        "new_vectors": """
SELECT 'd'||vec_id AS id, CASE WHEN label % 3 = 0 THEN 'r0' ELSE 'r1' END AS revision, embedding AS vector FROM embeddings""",
    }
)
FP = "fp-new"


def items(s, d, content: bool = True):
    df = table(s, d, "retrieval_items")
    return df if content else df.drop("content")


def vectors(s, d):
    return table(s, d, "retrieval_vectors").drop("label")


def validate_items(s, d):
    ok, bad = X.validate_items(table(s, d, "item_candidates"))
    return ok.select("id", F.lit(None).cast("string").alias("reject_code")).unionByName(bad.select("id", "reject_code"))


def content_hash(s, d):
    return items(s, d).select("id", X.content_hash(F.col("content")).alias("content_hash"))


def _stored(s, d):
    return items(s, d).withColumn("content_hash", X.content_hash(F.col("content")))


def _staged(s, d):
    return X.stage(_stored(s, d), table(s, d, "incoming"), FP, AT, "b1")


def stage(s, d):
    return _staged(s, d)[0].select(
        "id", "namespace", "source_system", "scope_key", "updated_at", "indexed_at", "content_hash", "projection_version", "revision",
        "lexical_state", "vector_state", "fingerprint", "failure_code",
    )


def stage_rejects(s, d):
    return _staged(s, d)[1]


def callers(s, d):
    two = lambda *g: F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in g])
    n = F.col("r_regionkey")
    team = F.concat(F.lit("t"), n.cast("string"))
    grants = F.when(n == 4, F.expr("cast(array() as array<struct<kind:string,key:string>>)")).when(
        n == 3, two(("team", team), ("global", F.lit("all")))
    ).when(n % 2 == 0, two(("team", team), ("global", F.lit("*")), ("team", team))).otherwise(two(("team", team)))
    return table(s, d, "region").select(F.col("r_name").alias("caller_id"), grants.alias("grants"))


def authorized_items(s, d):
    return X.authorized(items(s, d, False), callers(s, d))


FILTERS = {
    "all": None,
    "exact": {"namespaces": [{"value": "docs.en"}]},
    "subtree": {"namespaces": [{"value": "docs.fr", "subtree": True}, {"value": "docs.e", "subtree": True}], "types": ["note"]},
    "none": {"types": []},
    "source": {"source_system": "src3", "created_from": 100_000, "created_to": 600_000},
    "narrow": {"scopes": [{"kind": "team", "key": "t2"}], "updated_from": 50_007},
    "broken": {"types": ["Bad Name"]},
    "order": {"created_from": 9, "created_to": 3},
}


def validate_filters(s, d):
    names = table(s, d, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    spec = F.element_at(F.array(*[F.lit(x) for x in [
        "null", '{"types":["note"]}', '{"types":["Note"]}', '{"namespaces":[{"value":"docs."}]}', '{"created_from":5,"created_to":4}',
        '{"source_id":""}', '{"scopes":[{"kind":"global","key":"x"}]}', '{"updated_from":-1}', '{"namespaces":[{"value":"a.b","subtree":true}],"updated_from":1,"updated_to":1}',
    ]]), k % 9 + 1)
    q = names.select("n_name", F.from_json(spec, R.FILTER).alias("filter"))
    return X.validate_filters(q).select("n_name", "reject_code")


def match_filter(s, d):
    return X.match_filter(items(s, d, False), FILTERS)


def pending_work(s, d):
    return X.pending_work(items(s, d, False)).select("id", "indexed_at", "lexical_state", "vector_state")


def mark_failed(s, d):
    return X.mark_failed(items(s, d, False), table(s, d, "reported_failures")).select("id", "lexical_state", "vector_state", "failure_stage", "failure_code")


def remove_by_source(s, d):
    sources = items(s, d, False).join(table(s, d, "labels").filter("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("id")), "id").select(*X.SOURCE)
    out = X.remove_by_source({"items": items(s, d, False), "vectors": vectors(s, d)}, sources)
    return out["items"].select("id", F.lit("items").alias("held_in")).unionByName(out["vectors"].select("id", F.lit("vectors").alias("held_in")))


def requeue(s, d):
    out = X.requeue(items(s, d, False), vectors(s, d), FP, "b2", stale_only=True)
    return out.select("id", "requeued", "lexical_state", "vector_state", "failure_code", "revision")


def requeue_ids(s, d):
    ids = table(s, d, "labels").filter("quality = 0").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    out = X.requeue(items(s, d, False), vectors(s, d), FP, "b3", ids=ids, extra=F.col("type") == "note")
    return out.select("id", "requeued", "lexical_state", "vector_state", "failure_code")


def index_stats(s, d):
    return X.index_stats(items(s, d, False), vectors(s, d), FP)


def index_stats_by_namespace(s, d):
    return X.index_stats(items(s, d, False), vectors(s, d), FP, ["namespace"])


def index_lexical(s, d):
    it = items(s, d)
    done, lex = X.index_lexical(it, X.build_lexical(it.filter("lexical_state = 'ready'")))
    return done.join(lex, "id", "left").select("id", "lexical_state", "failure_code", "n_tokens")


def index_vectors(s, d):
    new = table(s, d, "new_vectors")
    it, vec = X.index_vectors(items(s, d, False), vectors(s, d), new, FP, AT)
    v = vec.select("id", F.col("revision").alias("vector_revision"), F.col("fingerprint").alias("vector_fingerprint"))
    return it.join(v, "id", "left").select("id", "vector_state", "fingerprint", "failure_code", "indexed_at", "vector_revision", "vector_fingerprint")


def validate_vectors(s, d):
    v = F.col("embedding")
    pos = F.col("vec_id")
    raw = table(s, d, "embeddings").select(
        "vec_id",
        F.when(pos % 7 == 1, F.transform(v, lambda x: x * F.lit(1.1).cast("float")))
        .when(pos % 11 == 2, F.slice(v, 1, 63))
        .when(pos % 13 == 3, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .otherwise(v)
        .alias("vector"),
    )
    ok, bad = X.validate_vectors(raw, F.lit(64))
    return ok.select("vec_id", F.lit(None).cast("string").alias("reject_code")).unionByName(bad.select("vec_id", "reject_code"))


def fingerprint_keys(s, d):
    f = F.struct(
        F.concat(F.lit('lab/"m"'), F.col("label").cast("string")).alias("model_id"), F.lit("v1").alias("revision"), F.lit("q8").alias("quantization"),
        F.size("embedding").alias("dimensions"), F.lit("unspecified").alias("backend_revision"), F.lit("float32_le_v1").alias("format"),
        F.lit("plain_text_v1").alias("preprocessing"), F.lit(True).alias("normalized"),
    )
    return table(s, d, "embeddings").select(X.fingerprint_key(f).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("vectors"))


def synthetic_vectors(s, d):
    out = X.synthetic_vectors(table(s, d, "benchmark").select("item_id"), "item_id", 16)
    return out.select("item_id", F.posexplode("vector").alias("pos", "x")).select("item_id", "pos", F.round("x", 9).alias("x"))


def drain(s, d):
    it = items(s, d)
    tables, report = X.drain(it, X.build_lexical(it.filter("lexical_state = 'ready'")), vectors(s, d), X.checksum_embedder(64), FP, 64, AT)
    left = X.pending_work(tables["items"]).agg(F.count(F.lit(1)).alias("pending"))
    return report.select("attempted", "ready", "failed", F.lit(1).alias("k")).join(left.withColumn("k", F.lit(1)), "k").drop("k")


def drain_limited(s, d):
    """States after a drain of the 25 oldest documents with work, in one namespace subtree."""
    it = items(s, d)
    only = F.from_json(F.lit('{"types":["document"],"namespaces":[{"value":"docs.en","subtree":true},{"value":"docs.de","subtree":true}]}'), R.FILTER)
    tables, _ = X.drain_some(it, X.build_lexical(it.filter("lexical_state = 'ready'")), vectors(s, d), X.checksum_embedder(64), FP, 64, AT, 25, only)
    return tables["items"].select("id", "lexical_state", "vector_state").join(tables["lexical"].select("id", F.lit(True).alias("searchable")), "id", "left")


def drain_unloaded(s, d):
    """Without a model: lexical rows are repaired, rows that wait for a vector are counted."""
    it = items(s, d)
    tables, report = X.drain_some(it, X.build_lexical(it.filter("lexical_state = 'ready'")), vectors(s, d), None, FP, 64, AT)
    states = tables["items"].groupBy("lexical_state", "vector_state").agg(F.count(F.lit(1)).alias("items"))
    return states.join(F.broadcast(report.select("attempted", "pending")))


def rebuild_index(s, d):
    sources = table(s, d, "incoming").filter("id LIKE 'd%' AND namespace LIKE 'docs.%' AND source_system <> 'moved' AND content NOT LIKE 'quality%'")
    out, _ = X.rebuild_index(_stored(s, d), sources, FP, AT, "b4")
    return out.select("id", "namespace", "updated_at", "lexical_state", "vector_state", "fingerprint")


def isolated_sources(s, d):
    inside, outside = X.isolated(items(s, d, False), "docs", "src3", [("team", "t1"), ("global", "*")], "d")
    return inside.select("id", F.lit(None).cast("string").alias("reject_code")).unionByName(outside.select("id", "reject_code"))


QUERIES = {
    f.__name__: f
    for f in [
        validate_items, content_hash, stage, stage_rejects, authorized_items, validate_filters, match_filter, pending_work, mark_failed,
        remove_by_source, requeue, requeue_ids, index_stats, index_stats_by_namespace, index_lexical, index_vectors, validate_vectors,
        fingerprint_keys, synthetic_vectors, drain, drain_limited, drain_unloaded, rebuild_index, isolated_sources,
    ]
}

NAME = "'^[a-z][a-z0-9_-]*(\\.[a-z0-9_-]+)*$'"
STAGED = """j AS (SELECT n.*, sha256(n.content) AS hash, o.id IS NOT NULL AS had, o.source_system||'/'||o.source_type||'/'||o.source_id AS o_src, o.updated_at AS o_updated, sha256(o.content) AS o_hash,
    n.source_system||'/'||n.source_type||'/'||n.source_id AS src, first_value(n.source_system||'/'||n.source_type||'/'||n.source_id) OVER (PARTITION BY n.id ORDER BY n.seq) AS f_src
  FROM incoming n LEFT JOIN retrieval_items o ON o.id = n.id),
k AS (SELECT *, src <> coalesce(o_src, f_src) AS conflict FROM j),
m AS (SELECT *, max(CASE WHEN NOT conflict THEN updated_at END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
judged AS (SELECT *, CASE WHEN conflict THEN 'identity_conflict' WHEN updated_at < coalesce(greatest(o_updated, before), o_updated, before, -1) THEN 'older_source_version' END AS code FROM m),
fold AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) AS r,
    coalesce(bool_or(hash <> o_hash OR projection_version <> 1) OVER (PARTITION BY id), true) AS changed FROM judged WHERE code IS NULL) WHERE r = 1),
held AS (SELECT id, namespace, type, source_system, source_type, source_id, 1 AS lvl, seq FROM fold UNION ALL
  SELECT id, namespace, type, source_system, source_type, source_id, 0, 0 FROM retrieval_items WHERE id NOT IN (SELECT id FROM fold)),
owned AS (SELECT *, first_value(id) OVER (PARTITION BY namespace, type, source_system, source_type, source_id ORDER BY lvl, seq, id) AS owner FROM held),
clash AS (SELECT id FROM owned WHERE lvl = 1 AND owner <> id),
f AS (SELECT * FROM fold WHERE id NOT IN (SELECT id FROM clash))"""

ORACLES = {
    "validate_items": with_ctes(
        ["item_candidates"],
        f"""SELECT id, CASE WHEN NOT (regexp_matches(namespace, {NAME}) AND length(source_id) > 0 AND length(trim(content)) > 0 AND length(content) <= 100000 AND updated_at >= created_at
          AND (scope_kind <> 'global' OR scope_key = '*') AND coalesce(projection_version, 1) >= 1) THEN 'invalid_item'
        WHEN metadata_json IS NOT NULL AND (CAST(substr(id, 2) AS BIGINT) % 9) IN (2, 4, 5) THEN 'invalid_metadata' END AS reject_code FROM item_candidates""",
    ),
    "content_hash": with_ctes(["retrieval_items"], "SELECT id, sha256(content) AS content_hash FROM retrieval_items"),
    "stage": with_ctes(
        ["retrieval_items", "incoming"],
        f"""SELECT coalesce(f.id, o.id) AS id, coalesce(f.namespace, o.namespace) AS namespace, coalesce(f.source_system, o.source_system) AS source_system, coalesce(f.scope_key, o.scope_key) AS scope_key,
        coalesce(f.updated_at, o.updated_at) AS updated_at, CASE WHEN f.id IS NOT NULL THEN {AT} ELSE o.indexed_at END AS indexed_at, coalesce(f.hash, sha256(o.content)) AS content_hash,
        coalesce(f.projection_version, o.projection_version) AS projection_version, CASE WHEN f.changed THEN sha256(f.id||'|'||f.hash||'|'||f.projection_version||'|b1') ELSE o.revision END AS revision,
        CASE WHEN f.changed THEN 'pending' ELSE o.lexical_state END AS lexical_state,
        CASE WHEN f.changed THEN CASE WHEN o.fingerprint IS NOT NULL THEN 'stale' ELSE 'pending' END WHEN f.id IS NOT NULL AND o.fingerprint <> '{FP}' THEN 'stale' ELSE o.vector_state END AS vector_state,
        o.fingerprint, CASE WHEN NOT coalesce(f.changed, false) THEN o.failure_code END AS failure_code FROM f FULL JOIN retrieval_items o ON o.id = f.id""",
        extra=STAGED,
    ),
    "stage_rejects": with_ctes(
        ["retrieval_items", "incoming"],
        """SELECT id, seq, code AS reject_code FROM judged WHERE code IS NOT NULL UNION ALL SELECT id, seq, 'duplicate_source' FROM judged WHERE code IS NULL AND id IN (SELECT id FROM clash)""",
        extra=STAGED,
    ),
    "authorized_items": with_ctes(
        ["retrieval_items"],
        """SELECT r_name AS caller_id, id FROM region JOIN retrieval_items ON r_regionkey < 3 AND ((scope_kind = 'team' AND scope_key = 't'||r_regionkey) OR (r_regionkey % 2 = 0 AND scope_kind = 'global' AND scope_key = '*'))""",
    ),
    "validate_filters": "SELECT n_name, CASE WHEN n_nationkey % 9 IN (2, 3, 4, 5, 6, 7) THEN 'invalid_filter' END AS reject_code FROM nation",
    "match_filter": with_ctes(
        ["retrieval_items"],
        """SELECT 'all' AS filter_id, id FROM retrieval_items UNION ALL SELECT 'exact', id FROM retrieval_items WHERE namespace = 'docs.en'
        UNION ALL SELECT 'subtree', id FROM retrieval_items WHERE (namespace = 'docs.fr' OR namespace LIKE 'docs.fr.%' OR namespace = 'docs.e') AND type = 'note'
        UNION ALL SELECT 'source', id FROM retrieval_items WHERE source_system = 'src3' AND created_at BETWEEN 100000 AND 600000
        UNION ALL SELECT 'narrow', id FROM retrieval_items WHERE scope_kind = 'team' AND scope_key = 't2' AND updated_at >= 50007""",
    ),
    "pending_work": with_ctes(
        ["retrieval_items"],
        "SELECT id, indexed_at, lexical_state, vector_state FROM retrieval_items WHERE lexical_state = 'pending' OR vector_state IN ('pending', 'stale')",
    ),
    "mark_failed": with_ctes(
        ["retrieval_items", "reported_failures"],
        """SELECT i.id, CASE WHEN r.stage = 'lexical' THEN 'failed' ELSE lexical_state END AS lexical_state, CASE WHEN r.stage = 'vector' THEN 'failed' ELSE vector_state END AS vector_state,
        coalesce(r.stage, failure_stage) AS failure_stage, CASE WHEN r.id IS NOT NULL THEN CASE WHEN regexp_full_match(r.code, '[a-zA-Z0-9_-]{1,64}') THEN r.code ELSE r.stage||'_failed' END ELSE failure_code END AS failure_code
        FROM retrieval_items i LEFT JOIN reported_failures r ON r.id = i.id AND r.revision = i.revision""",
    ),
    "remove_by_source": with_ctes(
        ["retrieval_items", "retrieval_vectors"],
        """SELECT id, 'items' AS held_in FROM retrieval_items WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, 'vectors' FROM retrieval_vectors WHERE id NOT IN (SELECT id FROM gone)""",
        extra="""gone AS (SELECT id FROM retrieval_items WHERE (source_system, source_type, source_id) IN (SELECT (source_system, source_type, source_id) FROM retrieval_items JOIN labels ON id = 'd'||doc_id WHERE toxic = 1))""",
    ),
    "requeue": with_ctes(
        ["retrieval_items", "retrieval_vectors"],
        """SELECT id, h AS requeued, CASE WHEN h AND lexical_state = 'failed' THEN 'pending' ELSE lexical_state END AS lexical_state, CASE WHEN h THEN 'pending' ELSE vector_state END AS vector_state,
        CASE WHEN NOT h THEN failure_code END AS failure_code, CASE WHEN h THEN sha256(id||'|'||revision||'|b2') ELSE revision END AS revision
        FROM (SELECT i.*, vector_state = 'stale' OR coalesce(v.fingerprint <> 'fp-new' OR v.revision <> i.revision, false) AS h FROM retrieval_items i LEFT JOIN retrieval_vectors v ON v.id = i.id)""",
    ),
    "requeue_ids": with_ctes(
        ["retrieval_items"],
        """SELECT id, h AS requeued, CASE WHEN h AND lexical_state = 'failed' THEN 'pending' ELSE lexical_state END AS lexical_state, CASE WHEN h THEN 'pending' ELSE vector_state END AS vector_state,
        CASE WHEN NOT h THEN failure_code END AS failure_code FROM (SELECT *, type = 'note' AND id IN (SELECT 'd'||doc_id FROM labels WHERE quality = 0) AS h FROM retrieval_items)""",
    ),
    "index_lexical": with_ctes(
        ["retrieval_items"],
        """SELECT id, CASE WHEN lexical_state = 'pending' THEN 'ready' ELSE lexical_state END AS lexical_state, CASE WHEN lexical_state = 'pending' AND failure_stage = 'lexical' THEN NULL ELSE failure_code END AS failure_code,
        CASE WHEN lexical_state <> 'failed' THEN len(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+')) END AS n_tokens FROM retrieval_items""",
    ),
    "index_vectors": with_ctes(
        ["retrieval_items", "retrieval_vectors", "new_vectors"],
        f"""SELECT i.id, CASE WHEN n.id IS NOT NULL THEN 'ready' ELSE vector_state END AS vector_state, CASE WHEN n.id IS NOT NULL THEN '{FP}' ELSE i.fingerprint END AS fingerprint,
        CASE WHEN n.id IS NOT NULL AND failure_stage = 'vector' THEN NULL ELSE failure_code END AS failure_code, CASE WHEN n.id IS NOT NULL THEN {AT} ELSE indexed_at END AS indexed_at,
        coalesce(n.revision, v.revision) AS vector_revision, CASE WHEN n.id IS NOT NULL THEN '{FP}' ELSE v.fingerprint END AS vector_fingerprint
        FROM retrieval_items i LEFT JOIN new_vectors n ON n.id = i.id AND n.revision = i.revision LEFT JOIN retrieval_vectors v ON v.id = i.id""",
    ),
    "validate_vectors": "SELECT vec_id, CASE WHEN vec_id % 7 = 1 OR vec_id % 11 = 2 OR vec_id % 13 = 3 THEN 'invalid_vector' END AS reject_code FROM embeddings",
    "fingerprint_keys": """SELECT '["lab/\\"m\\"'||label||'","v1","q8",'||len(embedding)||',"unspecified","float32_le_v1","plain_text_v1",true]' AS key, count(*) AS vectors FROM embeddings GROUP BY 1""",
    "synthetic_vectors": """WITH RECURSIVE lcg AS (SELECT item_id, 0 AS pos, (1664525 * (item_id + 1) + 1013904223) % 4294967296 AS st FROM benchmark
      UNION ALL SELECT item_id, pos + 1, (1664525 * st + 1013904223) % 4294967296 FROM lcg WHERE pos < 15)
    SELECT item_id, pos, round((st / 4294967296.0 - 0.5) / sqrt(sum((st / 4294967296.0 - 0.5) * (st / 4294967296.0 - 0.5)) OVER (PARTITION BY item_id)), 9) AS x FROM lcg""",
    "drain": with_ctes(
        ["retrieval_items"],
        """SELECT count(*) FILTER (WHERE tried) AS attempted, count(*) FILTER (WHERE tried) AS ready, CAST(0 AS BIGINT) AS failed, count(*) FILTER (WHERE vector_state IN ('pending', 'stale') AND NOT tried) AS pending
        FROM (SELECT *, (lexical_state = 'pending' OR vector_state IN ('pending', 'stale')) AND vector_state <> 'ready' AS tried FROM retrieval_items)""",
    ),
    "drain_limited": with_ctes(
        ["retrieval_items"],
        """SELECT i.id, CASE WHEN w.id IS NOT NULL AND lexical_state = 'pending' THEN 'ready' ELSE lexical_state END AS lexical_state, CASE WHEN w.id IS NOT NULL THEN 'ready' ELSE vector_state END AS vector_state,
        CASE WHEN lexical_state = 'ready' OR (w.id IS NOT NULL AND lexical_state = 'pending') THEN true END AS searchable
        FROM retrieval_items i LEFT JOIN (SELECT id FROM retrieval_items WHERE type = 'document' AND (namespace IN ('docs.en', 'docs.de') OR namespace LIKE 'docs.en.%' OR namespace LIKE 'docs.de.%')
          AND (lexical_state = 'pending' OR vector_state IN ('pending', 'stale')) ORDER BY indexed_at, id LIMIT 25) w ON w.id = i.id""",
    ),
    "drain_unloaded": with_ctes(
        ["retrieval_items"],
        """SELECT CASE WHEN lexical_state = 'pending' THEN 'ready' ELSE lexical_state END AS lexical_state, vector_state, count(*) AS items, CAST(0 AS BIGINT) AS attempted,
        (SELECT count(*) FROM retrieval_items WHERE vector_state <> 'ready' AND (lexical_state = 'pending' OR vector_state IN ('pending', 'stale'))) AS pending FROM retrieval_items GROUP BY 1, 2""",
    ),
    "rebuild_index": with_ctes(
        ["retrieval_items", "incoming"],
        """SELECT coalesce(n.id, o.id) AS id, coalesce(n.namespace, o.namespace) AS namespace, coalesce(n.updated_at, o.updated_at) AS updated_at, CASE WHEN n.id IS NOT NULL THEN 'pending' ELSE o.lexical_state END AS lexical_state,
        CASE WHEN n.id IS NOT NULL THEN 'pending' ELSE o.vector_state END AS vector_state, CASE WHEN n.id IS NULL THEN o.fingerprint END AS fingerprint
        FROM retrieval_items o FULL JOIN (SELECT * FROM incoming WHERE id LIKE 'd%' AND namespace LIKE 'docs.%' AND source_system <> 'moved' AND content NOT LIKE 'quality%') n ON n.id = o.id""",
    ),
    "isolated_sources": with_ctes(
        ["retrieval_items"],
        """SELECT id, CASE WHEN NOT (namespace LIKE 'docs.%' AND source_system = 'src3' AND ((scope_kind = 'team' AND scope_key = 't1') OR (scope_kind = 'global' AND scope_key = '*'))) THEN 'lab_boundary' END AS reject_code FROM retrieval_items""",
    ),
}
_STATS = """count(*) AS total, count(*) FILTER (WHERE lexical_state = 'ready') AS lexical, count(v.id) AS vectors,
  count(*) FILTER (WHERE v.fingerprint = 'fp-new' AND v.revision = i.revision AND vector_state = 'ready') AS compatible,
  count(*) FILTER (WHERE vector_state = 'pending' OR lexical_state = 'pending') AS pending,
  count(*) FILTER (WHERE vector_state = 'stale' OR (v.id IS NOT NULL AND (v.fingerprint <> 'fp-new' OR v.revision <> i.revision))) AS stale,
  count(*) FILTER (WHERE vector_state = 'failed' OR lexical_state = 'failed') AS failed, CAST(coalesce(sum(len(v.vector) * 4), 0) AS BIGINT) AS vector_bytes,
  CASE WHEN count(v.id) > 0 THEN sum(len(v.vector) * 4) / count(v.id) ELSE 0 END::DOUBLE AS average_vector_bytes FROM retrieval_items i LEFT JOIN retrieval_vectors v ON v.id = i.id"""
ORACLES["index_stats"] = with_ctes(["retrieval_items", "retrieval_vectors"], f"SELECT {_STATS}")
ORACLES["index_stats_by_namespace"] = with_ctes(["retrieval_items", "retrieval_vectors"], f"SELECT namespace, {_STATS} GROUP BY namespace")
