"""The versioned retrieval index: validation, staging, states, projections, drain."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scan import running_max_before
from ..functions.sizing import cut, fits, maybe_broadcast
from ..functions.text import tokens

SOURCE = ["source_system", "source_type", "source_id"]
NATURAL = ["namespace", "type", *SOURCE]
BLOCK = 100_000  # rows of one id handled by one task while staging


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def validate_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, quarantine with reject_code 'invalid_item' or 'invalid_metadata')."""
    short_id = lambda c: (F.length(c) > 0) & R.within(F.col(c), 512) & ~F.col(c).contains("\0")
    body = F.col("content")
    version = F.col("projection_version")
    item_ok = (
        short_id("id")
        & R.valid_name(F.col("namespace"))
        & R.valid_name(F.col("type"))
        & R.valid_name(F.col("source_system"))
        & R.valid_name(F.col("source_type"))
        & short_id("source_id")
        & body.rlike(R.NOT_BLANK)
        & R.within(body, 100_000)
        & ~body.contains("\0")
        & F.col("created_at").between(0, R.SAFE_MAX)
        & F.col("updated_at").between(0, R.SAFE_MAX)
        & (F.col("created_at") <= F.col("updated_at"))
        & R.valid_scope(F.col("scope_kind"), F.col("scope_key"))
        & (version.isNull() | version.between(1, R.SAFE_MAX))
    )
    meta = F.col("metadata_json")
    doc = F.try_parse_json(meta)
    meta_ok = F.schema_of_variant(doc).startswith("OBJECT") & R.json_depth_ok(meta) & R.within(F.to_json(doc), 65_536)
    code = F.when(R.no(item_ok), "invalid_item").when(meta.isNotNull() & R.no(meta_ok), "invalid_metadata")
    out = df.withColumn("reject_code", code)
    return out.filter(F.col("reject_code").isNull()).drop("reject_code"), out.filter(F.col("reject_code").isNotNull())


def fingerprint_key(f: Column) -> Column:
    """Canonical JSON array text of an embedding fingerprint struct."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    text = lambda n: F.regexp_replace(quoted(f[n]), r"\]$", "")
    parts = [
        text("model_id"), text("revision"), text("quantization"), f["dimensions"].cast("string"), text("backend_revision"),
        text("format"), text("preprocessing"), f["normalized"].cast("string"),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def stage(items: DataFrame, incoming: DataFrame, fingerprint: str, at: int, batch: str) -> tuple[DataFrame, DataFrame]:
    """Versioned upsert of a batch that may hold several versions of an id (ordered by ``seq``).

    Rejects: 'identity_conflict' (the id belongs to another source),
    'older_source_version' (updated_at below the version in force),
    'duplicate_source' (the natural key belongs to another id). A changed text or
    projection version gets a new revision and goes back to pending; an
    unchanged one keeps its revision and states unless the embedding fingerprint
    moved on. Metadata, scope, namespace and times always follow the update.
    """
    src = F.concat_ws("\0", *SOURCE)  # NUL is not allowed in any of the parts
    stored = items.select(
        F.col("id").alias("o_id"), src.alias("o_src"), F.col("updated_at").alias("o_updated"), F.col("content_hash").alias("o_hash"),
        F.col("projection_version").alias("o_version"), F.col("fingerprint").alias("o_fp"),
    )
    rows = incoming.withColumns(
        {"projection_version": F.coalesce("projection_version", F.lit(1)), "content_hash": content_hash(F.col("content"))}
    )
    firsts = rows.groupBy(F.col("id").alias("f_id")).agg(F.min_by(src, "seq").alias("f_src"))
    rows = (
        rows.join(firsts, F.col("id") == F.col("f_id"))
        .join(stored, F.col("id") == F.col("o_id"), "left")
        .withColumn("_conflict", src != F.coalesce("o_src", "f_src"))
        .withColumn("_time", F.when(~F.col("_conflict"), F.col("updated_at")))
        .withColumn("_block", F.floor(F.col("seq") / BLOCK))
    )
    rows = running_max_before(rows, ["id"], "_block", ["seq"], "_time", "_before")
    floor = F.greatest("o_updated", "_before")
    rows = rows.withColumn(
        "reject_code",
        F.when(F.col("_conflict"), "identity_conflict").when(F.col("updated_at") < floor, "older_source_version"),
    )
    helper = ["f_id", "f_src", "_conflict", "_time", "_block", "_before"]
    accepted = rows.filter(F.col("reject_code").isNull())
    differs = (F.col("content_hash") != F.col("o_hash")) | (F.col("projection_version") != F.col("o_version"))
    carried = [c for c in incoming.columns if c not in ("id", "projection_version")] + ["projection_version", "content_hash"]
    folded = accepted.groupBy("id").agg(
        F.max_by(F.struct(*carried), F.struct("updated_at", "seq")).alias("n"),
        F.coalesce(F.max(differs), F.lit(True)).alias("changed"),
        F.first(F.struct("o_id", "o_fp")).alias("o"),
    ).select("id", "n.*", "changed", F.col("o.o_fp").alias("o_fp"))
    # natural key: a stored holder keeps it, otherwise the earliest id of the batch
    # folded apart from the texts: a struct that is aggregated keeps all its members, whoever reads it
    claims = accepted.groupBy("id").agg(F.max_by(F.struct("seq", *NATURAL), F.struct("updated_at", "seq")).alias("n")).select("id", "n.*")
    touched = claims.select("id", *NATURAL, F.struct(F.lit(1), F.col("seq"), "id").alias("claim"))
    kept = items.join(claims.select("id"), "id", "left_anti").select(
        "id", *NATURAL, F.struct(F.lit(0), F.lit(0).cast("long").alias("seq"), "id").alias("claim")
    )
    owners = (
        touched.unionByName(kept).groupBy(*NATURAL).agg(F.min("claim").alias("owner"), F.count(F.lit(1)).alias("claims"))
        .filter("claims > 1")
    )
    clash = touched.join(owners, NATURAL).filter(F.col("owner.id") != F.col("id")).select("id")
    rejects = rows.filter(F.col("reject_code").isNotNull()).select("id", "seq", "reject_code")
    clashing = accepted.join(clash, "id", "left_semi").select("id", "seq", F.lit("duplicate_source").alias("reject_code"))
    folded = folded.join(clash, "id", "left_anti")

    old = items.select(*[F.col(c).alias(f"old_{c}") for c in items.columns])
    merged = folded.join(old, F.col("id") == F.col("old_id"), "full_outer")
    new, changed = F.col("id").isNotNull(), F.coalesce("changed", F.lit(False))
    stale = F.coalesce(F.col("old_fingerprint") != F.lit(fingerprint), F.lit(False))
    revision = F.sha2(F.concat_ws("|", "id", "content_hash", "projection_version", F.lit(batch)), 256)
    state = {
        "id": F.coalesce("id", "old_id"),
        "revision": F.when(changed, revision).otherwise(F.col("old_revision")),
        "lexical_state": F.when(changed, "pending").otherwise(F.col("old_lexical_state")),
        "vector_state": F.when(changed, F.when(F.col("old_fingerprint").isNotNull(), "stale").otherwise("pending"))
        .when(new & stale, "stale")
        .otherwise(F.col("old_vector_state")),
        "fingerprint": F.col("old_fingerprint"),
        "failure_stage": F.when(~changed, F.col("old_failure_stage")),
        "failure_code": F.when(~changed, F.col("old_failure_code")),
        "indexed_at": F.when(new, F.lit(at)).otherwise(F.col("old_indexed_at")),
    }
    given = set(folded.columns)
    cols = [
        (state[c] if c in state else F.when(new, F.col(c)).otherwise(F.col(f"old_{c}")) if c in given else F.col(f"old_{c}")).alias(c)
        for c in items.columns
    ]
    return merged.select(*cols), rejects.unionByName(clashing)


def authorized(items: DataFrame, callers: DataFrame) -> DataFrame:
    """(caller_id, id) of every item a caller may see: one grant equals the item's scope.

    Callers without grants, or with an invalid grant list, see nothing; items
    with a malformed scope are seen by nobody.
    """
    grants = (
        callers.filter(R.valid_grants(F.col("grants")))
        .select("caller_id", F.explode(F.array_distinct("grants")).alias("g"))
        .select("caller_id", F.col("g.kind").alias("scope_kind"), F.col("g.key").alias("scope_key"))
    )
    grants = maybe_broadcast(grants, fits(grants))
    good = items.filter(R.valid_scope(F.col("scope_kind"), F.col("scope_key")))
    return good.join(grants, ["scope_kind", "scope_key"]).select("caller_id", "id")


def validate_filters(queries: DataFrame, column: str = "filter") -> DataFrame:
    return queries.withColumn("reject_code", F.when(~R.valid_filter(F.col(column)), "invalid_filter"))


def filter_literal(spec: dict | None) -> Column:
    """A filter struct column from a plain dict with the fields of ``rules.FILTER``."""
    return F.from_json(F.lit(None if spec is None else json.dumps(spec)), R.FILTER)


def match_filter(items: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """(filter_id, id): items passing each of the given filters, in one pass over the items."""
    tests = F.array(*[F.struct(F.lit(k).alias("filter_id"), filter_literal(v).alias("filter")) for k, v in filters.items()])
    hit = F.filter(tests, lambda t: R.valid_filter(t["filter"]) & R.matches(t["filter"]))
    return items.select("id", F.explode(hit).alias("f")).select(F.col("f.filter_id").alias("filter_id"), "id")


def materialize(candidates: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates whose item still has the same revision and passes access and filter again."""
    return (
        candidates.join(items.withColumnRenamed("revision", "item_revision"), "id")
        .filter(F.col("revision") == F.col("item_revision"))
        .join(queries.select("query_id", "grants", "filter"), "query_id")
        .filter(R.valid_scope(F.col("scope_kind"), F.col("scope_key")))
        .filter(R.granted(F.col("grants")) & R.matches(F.col("filter")))
        .drop("item_revision", "grants", "filter")
    )


def pending_work(items: DataFrame, limit: int | None = None, extra: Column | None = None) -> DataFrame:
    """Rows with lexical or vector work, oldest first."""
    rows = items.filter((F.col("lexical_state") == "pending") | F.col("vector_state").isin("pending", "stale"))
    rows = rows if extra is None else rows.filter(extra)
    rows = rows.orderBy("indexed_at", "id")
    return rows if limit is None else rows.limit(limit)


def mark_failed(items: DataFrame, failures: DataFrame) -> DataFrame:
    """Record failures (id, revision, stage, code) on the rows they still apply to.

    A code that is no short identifier becomes '<stage>_failed'. If both stages
    failed, the vector failure is kept as the text.
    """
    code = F.when(F.col("code").rlike(r"^[a-zA-Z0-9_-]{1,64}\z"), F.col("code")).otherwise(F.concat("stage", F.lit("_failed")))
    per_row = failures.select(F.col("id").alias("f_id"), F.col("revision").alias("f_rev"), "stage", code.alias("code"))
    per_row = per_row.groupBy("f_id", "f_rev").agg(
        F.max(F.struct("stage", "code")).alias("f"),
        F.max(F.col("stage") == "lexical").alias("f_lex"),
        F.max(F.col("stage") == "vector").alias("f_vec"),
    )
    out = items.join(per_row, (F.col("id") == F.col("f_id")) & (F.col("revision") == F.col("f_rev")), "left")
    new = {
        "lexical_state": F.when(F.col("f_lex"), "failed").otherwise(F.col("lexical_state")),
        "vector_state": F.when(F.col("f_vec"), "failed").otherwise(F.col("vector_state")),
        "failure_stage": F.coalesce("f.stage", "failure_stage"),
        "failure_code": F.when(F.col("f").isNotNull(), F.col("f.code")).otherwise(F.col("failure_code")),
    }
    return out.withColumns(new).select(*items.columns)


def remove(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Drop the ids from every table (items, lexical, vectors). Removing twice changes nothing."""
    gone = ids.select("id").distinct()
    return {name: df.join(gone, "id", "left_anti") for name, df in tables.items()}


def remove_by_source(tables: dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    """Drop everything that came from the listed (system, type, id) sources."""
    ids = tables["items"].join(sources.select(*SOURCE).distinct(), SOURCE, "left_semi")
    return remove(tables, ids)


def _vector_keys(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("v_id"), F.col("revision").alias("v_rev"), F.col("fingerprint").alias("v_fp"))


def requeue(
    items: DataFrame, vectors: DataFrame, fingerprint: str, batch: str, ids: DataFrame | None = None,
    extra: Column | None = None, stale_only: bool = False,
) -> DataFrame:
    """Send rows back to the queue under a new revision; ``requeued`` marks them."""
    hit = F.lit(True) if extra is None else F.coalesce(extra, F.lit(False))
    out = items
    if ids is not None:
        out = out.join(ids.select(F.col("id").alias("w_id")).distinct(), F.col("id") == F.col("w_id"), "left")
        hit = hit & F.col("w_id").isNotNull()
    if stale_only:
        out = out.join(_vector_keys(vectors), F.col("id") == F.col("v_id"), "left")
        old = F.col("v_id").isNotNull() & ((F.col("v_fp") != fingerprint) | (F.col("v_rev") != F.col("revision")))
        hit = hit & ((F.col("vector_state") == "stale") | old)
    out = out.withColumn("requeued", hit)
    h = F.col("requeued")
    return out.withColumns(
        {
            "vector_state": F.when(h, "pending").otherwise(F.col("vector_state")),
            "lexical_state": F.when(h & (F.col("lexical_state") == "failed"), "pending").otherwise(F.col("lexical_state")),
            "failure_stage": F.when(~h, F.col("failure_stage")),
            "failure_code": F.when(~h, F.col("failure_code")),
            "revision": F.when(h, F.sha2(F.concat_ws("|", "id", "revision", F.lit(batch)), 256)).otherwise(F.col("revision")),
        }
    ).select(*items.columns, "requeued")


def index_stats(items: DataFrame, vectors: DataFrame, fingerprint: str, by: list[str] | None = None) -> DataFrame:
    """Counts by state; an item may be counted in several of them."""
    dims = F.size("vector")
    keyed = vectors.select(
        F.col("id").alias("v_id"), F.col("revision").alias("v_rev"), F.col("fingerprint").alias("v_fp"), (dims * 4).cast("long").alias("v_bytes")
    )
    j = items.join(keyed, F.col("id") == F.col("v_id"), "left")
    has = F.col("v_id").isNotNull()
    current = (F.col("v_fp") == fingerprint) & (F.col("v_rev") == F.col("revision"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    lex, vec = F.col("lexical_state"), F.col("vector_state")
    out = j.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        count(lex == "ready").alias("lexical"),
        count(has).alias("vectors"),
        count(has & current & (vec == "ready")).alias("compatible"),
        count((vec == "pending") | (lex == "pending")).alias("pending"),
        count((vec == "stale") | (has & ~current)).alias("stale"),
        count((vec == "failed") | (lex == "failed")).alias("failed"),
        F.coalesce(F.sum("v_bytes"), F.lit(0)).alias("vector_bytes"),
    )
    avg = F.when(F.col("vectors") > 0, F.col("vector_bytes") / F.col("vectors")).otherwise(0.0)
    return out.withColumn("average_vector_bytes", avg)


def build_lexical(items: DataFrame) -> DataFrame:
    """Lexical projection: one row per item with its folded words in order."""
    return items.select("id", tokens(F.col("content")).alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("long"))


def build_postings(lexical: DataFrame) -> DataFrame:
    """(id, token, pos): the projection as an inverted-index table."""
    return lexical.select("id", F.posexplode("tokens").alias("pos", "token"))


def index_lexical(items: DataFrame, lexical: DataFrame, chosen: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, lexical) after projecting the pending rows (the chosen ones). Only a lexical failure is cleared."""
    todo = F.col("lexical_state") == "pending"
    todo = todo if chosen is None else todo & chosen
    fresh = build_lexical(items.filter(todo))
    kept = lexical.join(items.filter(todo).select("id"), "id", "left_anti")
    cleared = todo & (F.col("failure_stage") == "lexical")
    done = items.withColumns(
        {
            "failure_code": F.when(R.no(cleared), F.col("failure_code")),
            "failure_stage": F.when(R.no(cleared), F.col("failure_stage")),
            "lexical_state": F.when(todo, "ready").otherwise(F.col("lexical_state")),
        }
    )
    return done, kept.unionByName(fresh)


def validate_vectors(df: DataFrame, dims: Column, normalized: bool = True, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(ok, rejects 'invalid_vector'): dimension, finiteness and norm rules."""
    v = F.col(vector)
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = dims.between(1, 16_384) & (F.size(v) == dims) & finite & (squares > 0) & (squares != float("inf"))
    if normalized:
        ok = ok & (F.abs(squares - 1) <= 0.01)
    out = df.withColumn("reject_code", F.when(R.no(ok), "invalid_vector"))
    return out.filter(F.col("reject_code").isNull()).drop("reject_code"), out.filter(F.col("reject_code").isNotNull())


def index_vectors(items: DataFrame, vectors: DataFrame, embedded: DataFrame, fingerprint: str, at: int) -> tuple[DataFrame, DataFrame]:
    """(items, vectors) after storing embeddings (id, revision, vector).

    A result for an older revision is discarded; it stays visible as the
    difference between embedded and stored rows.
    """
    live = items.select("id", "revision")
    new = embedded.join(live, ["id", "revision"], "left_semi").select("id", "revision", F.lit(fingerprint).alias("fingerprint"), "vector")
    kept = vectors.join(new.select("id"), "id", "left_anti").select("id", "revision", "fingerprint", "vector")
    hit = new.select(F.col("id").alias("n_id"))
    h = F.col("n_id").isNotNull()
    cleared = h & F.coalesce(F.col("failure_stage") == "vector", F.lit(False))
    done = items.join(hit, F.col("id") == F.col("n_id"), "left").withColumns(
        {
            "failure_code": F.when(~cleared, F.col("failure_code")),
            "failure_stage": F.when(~cleared, F.col("failure_stage")),
            "vector_state": F.when(h, "ready").otherwise(F.col("vector_state")),
            "fingerprint": F.when(h, F.lit(fingerprint)).otherwise(F.col("fingerprint")),
            "indexed_at": F.when(h, F.lit(at)).otherwise(F.col("indexed_at")),
        }
    )
    return done.select(*items.columns), kept.unionByName(new)


def lcg_vectors(seeds: np.ndarray, dims: int) -> np.ndarray:
    """Deterministic unit vectors, one row per seed (fixed generator constants)."""
    state = ((seeds.astype(np.int64) + 1) & 0xFFFFFFFF).astype(np.uint64)
    out = np.empty((len(seeds), dims))
    for i in range(dims):
        state = (np.uint64(1664525) * state + np.uint64(1013904223)) & np.uint64(0xFFFFFFFF)
        out[:, i] = state.astype(np.float64) / 4294967296.0 - 0.5
    total = np.zeros(len(seeds))
    for i in range(dims):
        total += out[:, i] * out[:, i]
    return out / np.sqrt(total)[:, None]


def synthetic_vectors(df: DataFrame, seed: str, dims: int, name: str = "vector") -> DataFrame:
    """Add the synthetic unit vector of an integer seed column."""

    @F.pandas_udf("array<double>")
    def make(s: pd.Series) -> pd.Series:
        return pd.Series(list(lcg_vectors(s.to_numpy(), dims)))

    return df.withColumn(name, make(F.col(seed)))


Embedder = Callable[[list[str]], np.ndarray]


def checksum_embedder(dims: int) -> Embedder:
    """Stand-in embedder: the synthetic vector of the text's CRC-32."""

    def embed(texts: list[str]) -> np.ndarray:
        return lcg_vectors(np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in texts]), dims)

    return embed


def embed_rows(work: DataFrame, embedder: Embedder, batch_size: int = 16) -> DataFrame:
    """(id, revision, vector, error_code): embed contents in batches.

    A failing batch is retried row by row, so only the bad rows carry an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch_size):
                part = pdf.iloc[lo : lo + batch_size]
                texts = part["content"].tolist()
                vectors: list = [None] * len(part)
                codes: list = [None] * len(part)
                try:
                    got = embedder(texts)
                    if len(got) != len(part):
                        raise ValueError("batch result count differs")
                    vectors = [np.asarray(v, dtype=np.float32) for v in got]
                except Exception:
                    for i, t in enumerate(texts):
                        try:
                            vectors[i] = np.asarray(embedder([t])[0], dtype=np.float32)
                        except Exception as e:
                            codes[i] = str(getattr(e, "code", "") or "")
                yield pd.DataFrame(
                    {"id": part["id"].values, "revision": part["revision"].values, "vector": vectors, "error_code": codes}
                )

    return work.select("id", "revision", "content").mapInPandas(
        run, "id string, revision string, vector array<float>, error_code string"
    )


def drain(
    items: DataFrame, lexical: DataFrame, vectors: DataFrame, embedder: Embedder, fingerprint: str, dims: int, at: int, batch_size: int = 16,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Repair lexical rows, embed the rows whose vector is not ready, store the results.

    Returns the three tables and a one-row report (attempted, ready, failed).
    """
    tables, report = drain_some(items, lexical, vectors, embedder, fingerprint, dims, at, batch_size=batch_size)
    return tables, report.drop("pending")


def drain_some(
    items: DataFrame, lexical: DataFrame, vectors: DataFrame, embedder: Embedder | None, fingerprint: str, dims: int, at: int,
    limit: int | None = None, filter: Column | None = None, batch_size: int = 16,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """One drain over the ``limit`` oldest rows with work that pass the filter struct.

    Without an embedder the lexical rows are still repaired; rows without a ready
    vector stay as they are and are reported as pending. A limit lies between 1 and
    1,000; without one all work is done, without a sort. The embedding pass is cut
    with a durable checkpoint, because inference must run once per row. Returns the
    three tables and a one-row report (attempted, ready, failed, pending).
    """
    if limit is not None and not 1 <= limit <= 1_000:
        raise ValueError("invalid_limit")
    chosen = (F.col("lexical_state") == "pending") | F.col("vector_state").isin("pending", "stale")
    chosen = F.coalesce(chosen, F.lit(False)) & (F.lit(True) if filter is None else R.matches(filter))
    if limit is None:
        marked = items.withColumn("_chosen", chosen)
    else:
        oldest = cut(pending_work(items, limit, chosen).select(F.col("id").alias("_oldest")))
        marked = items.join(F.broadcast(oldest), F.col("id") == F.col("_oldest"), "left").withColumn("_chosen", F.col("_oldest").isNotNull())
        marked = marked.drop("_oldest")
    to_embed = marked.filter(F.col("_chosen") & (F.col("vector_state") != "ready"))
    items1, lexical1 = index_lexical(marked, lexical, F.col("_chosen"))
    items1 = items1.drop("_chosen")
    none = F.lit(0).cast("long")
    if embedder is None:
        waiting = to_embed.agg(*[none.alias(c) for c in ("attempted", "ready", "failed")], F.count(F.lit(1)).alias("pending"))
        return {"items": items1, "lexical": lexical1, "vectors": vectors}, waiting
    result = cut(embed_rows(to_embed, embedder, batch_size))
    good, bad_vectors = validate_vectors(result.filter(F.col("vector").isNotNull()), F.lit(dims))
    items2, vectors2 = index_vectors(items1, vectors, good, fingerprint, at)
    failures = (
        result.filter(F.col("vector").isNull())
        .select("id", "revision", F.col("error_code").alias("code"))
        .unionByName(bad_vectors.select("id", "revision", F.col("reject_code").alias("code")))
        .withColumn("stage", F.lit("vector"))
    )
    items3 = mark_failed(items2, failures)
    report = result.select(F.lit(1).alias("attempted"), F.lit(0).alias("ready"), F.lit(0).alias("failed"))
    report = report.unionByName(good.select(F.lit(0).alias("attempted"), F.lit(1).alias("ready"), F.lit(0).alias("failed")))
    report = report.unionByName(failures.select(F.lit(0).alias("attempted"), F.lit(0).alias("ready"), F.lit(1).alias("failed")))
    report = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempted", "ready", "failed")], none.alias("pending"))
    return {"items": items3, "lexical": lexical1, "vectors": vectors2}, report


def isolated(items: DataFrame, namespace: str, source_system: str, scopes: list[tuple[str, str]], id_prefix: str) -> tuple[DataFrame, DataFrame]:
    """(inside, outside): rows confined to one namespace subtree, source system and scope list."""
    inside = (
        F.startswith(F.col("id"), F.lit(id_prefix))
        & F.startswith(F.col("namespace"), F.lit(namespace + "."))
        & (F.col("source_system") == source_system)
        & F.struct("scope_kind", "scope_key").isin([F.struct(F.lit(k), F.lit(v)) for k, v in scopes])
    )
    inside = F.coalesce(inside, F.lit(False))
    return items.filter(inside), items.filter(~inside).withColumn("reject_code", F.lit("lab_boundary"))


def rebuild_index(items: DataFrame, sources: DataFrame, fingerprint: str, at: int, batch: str) -> tuple[DataFrame, DataFrame]:
    """Clear the index rows of the given sources and stage them again; sources stay untouched."""
    cleared = items.join(sources.select("id").distinct(), "id", "left_anti")
    return stage(cleared, sources, fingerprint, at, batch)
