"""Price snapshots: validity, as-of resolution, price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import cut, fits, maybe_broadcast

RATES = [
    "input_per_million_micros",
    "cache_read_per_million_micros",
    "cache_write_per_million_micros",
    "output_per_million_micros",
    "reasoning_per_million_micros",
]
SNAPSHOT = ["pricing_snapshot_id", *RATES, "currency", "effective_from", "source"]
LEVELS = 40
BUCKET_MS = 30 * 86_400_000


def valid_at(at: Column) -> Column:
    """Half-open validity: effective_from <= at < effective_to (open when NULL)."""
    return (F.col("effective_from") <= at) & (F.col("effective_to").isNull() | (F.col("effective_to") > at))


def timeline(pricing: DataFrame) -> DataFrame:
    """Disjoint validity segments with the one winning snapshot of each.

    Key: (provider, model, provider_account_id), a NULL account being the generic
    price. Within a key the latest effective_from wins, then the latest
    created_at, then the id; an expired winner gives way to an older price that
    is still valid. Snapshots are spread over the aligned power-of-two ranges of
    interval numbers they cover, so a key with n snapshots costs n log n rows
    and never a pair per snapshot and interval.
    """
    key = ["provider", "model", "provider_account_id"]
    snaps = pricing.select(*key, *SNAPSHOT, "effective_to", "created_at")
    edges = snaps.select(*key, F.explode(F.array_compact(F.array("effective_from", "effective_to"))).alias("t")).distinct()
    by_key = Window.partitionBy(*key).orderBy("t")
    edges = edges.select(
        *key, "t", (F.row_number().over(by_key) - 1).alias("no"), F.lead("t").over(by_key).alias("next_t")
    )

    def same(a: str, b: str) -> Column:
        cond = None
        for k in key:
            eq = F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
            cond = eq if cond is None else cond & eq
        return cond

    lo = edges.alias("lo")
    hi = edges.alias("hi")
    spans = (
        snaps.alias("s")
        .join(lo, same("s", "lo") & (F.col("s.effective_from") == F.col("lo.t")))
        .join(hi, same("s", "hi") & (F.col("s.effective_to") == F.col("hi.t")), "left")
        .filter(F.col("s.effective_to").isNull() | (F.col("s.effective_to") > F.col("s.effective_from")))
        .select("s.*", F.col("lo.no").cast("long").alias("a"), F.coalesce(F.col("hi.no").cast("long"), F.lit(2**LEVELS)).alias("b"))
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    spans = spans.select("*", level).selectExpr(
        "*", "shiftright(a + shiftleft(1L, level) - 1, level) AS l", "shiftright(b, level) AS r"
    )
    cells = spans.filter("l < r").select(
        *key,
        "level",
        F.explode(F.expr("array_compact(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)))")).alias("cell"),
        F.struct("effective_from", "created_at", "pricing_snapshot_id").alias("rank"),
        F.struct(*SNAPSHOT).alias("price"),
    )
    best = cells.groupBy(*key, "level", "cell").agg(F.max(F.struct("rank", "price")).alias("top"))
    probes = edges.select("*", level).selectExpr("*", "shiftright(CAST(no AS BIGINT), level) AS cell")
    found = probes.alias("p").join(
        best.alias("b"), same("p", "b") & (F.col("p.level") == F.col("b.level")) & (F.col("p.cell") == F.col("b.cell"))
    )
    return (
        found.groupBy(*[F.col(f"p.{k}").alias(k) for k in key], F.col("p.t").alias("seg_from"), F.col("p.next_t").alias("seg_to"))
        .agg(F.max("b.top").alias("top"))
        .select(*key, "seg_from", "seg_to", "top.price")
    )


def resolve_price(attempts: DataFrame, pricing: DataFrame, at: str = "started_at") -> DataFrame:
    """Attach the price in force at ``at`` as a nullable struct column ``price``.

    An account-specific price beats a generic one. Segments are disjoint, so each
    side matches at most once and the attempts are neither multiplied nor
    shuffled while the price list is small. A price list beyond the checked size
    is cut into month buckets and joined on (key, bucket), where Spark can split
    a hot provider's partition. The segments are written once, so that the attempts
    see two joins with a stored table and nothing else.
    """
    segs = cut(timeline(pricing))
    small = fits(segs)
    own = segs.filter(F.col("provider_account_id").isNotNull())
    generic = segs.filter(F.col("provider_account_id").isNull())
    out = _probe(attempts, own, ["provider", "model", "provider_account_id"], at, "own_price", small)
    out = _probe(out, generic, ["provider", "model"], at, "generic_price", small)
    return out.withColumn("price", F.coalesce("own_price", "generic_price")).drop("own_price", "generic_price")


def _probe(rows: DataFrame, segs: DataFrame, key: list[str], at: str, name: str, small: bool) -> DataFrame:
    if not small:
        last = rows.agg(F.max(at)).first()[0]
        end = F.least(F.coalesce(F.col("seg_to") - 1, F.lit(last)), F.lit(last))
        first_bucket = F.floor(F.col("seg_from") / BUCKET_MS)
        segs = segs.filter(F.col("seg_from") <= end).withColumn(
            "bucket", F.explode(F.sequence(first_bucket, F.floor(end / BUCKET_MS)))
        )
        rows = rows.withColumn("bucket", F.floor(F.col(at) / BUCKET_MS))
        key = [*key, "bucket"]
    a, b = rows.alias("a"), maybe_broadcast(segs, small).alias("b")
    cond = (F.col(f"a.{at}") >= F.col("b.seg_from")) & (F.col("b.seg_to").isNull() | (F.col(f"a.{at}") < F.col("b.seg_to")))
    for k in key:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    out = a.join(b, cond, "left").select("a.*", F.col("b.price").alias(name))
    return out if small else out.drop("bucket")


def price_list(models: DataFrame, pricing: DataFrame, at: int) -> DataFrame:
    """Effective price per model: a user override in force at ``at`` beats catalog rates.

    ``models``: provider, model, input_usd, output_usd, cache_read_usd, cache_write_usd.
    Catalog rates count only when one of them is positive; cache rates <= 0 mean no price.
    """
    probe = models.withColumn("_at", F.lit(at)).withColumn("provider_account_id", F.lit(""))
    rows = resolve_price(probe, pricing, "_at").drop("_at", "provider_account_id")
    user = F.coalesce(F.col("price.source") == "user_override", F.lit(False))
    catalog_cols = ["input_usd", "output_usd", "cache_read_usd", "cache_write_usd"]
    priced = F.lit(False)
    for c in catalog_cols:
        priced = priced | F.coalesce(F.col(c) > 0, F.lit(False))
    micros = dict(zip(catalog_cols, RATES[:1] + RATES[3:4] + RATES[1:3]))

    def pick(c: str, cache: bool) -> Column:
        mine = F.col(f"price.{micros[c]}") / F.lit(1_000_000)
        theirs = F.col(c)
        if cache:
            mine, theirs = F.when(mine > 0, mine), F.when(theirs > 0, theirs)
            return F.when(user, mine).otherwise(theirs)
        return F.when(user, mine).when(priced, theirs)

    source = F.when(user, "user").when(priced, "catalog").otherwise("none")
    return rows.select(
        "provider",
        "model",
        *[pick(c, c.startswith("cache")).alias(f"out_{c}") for c in catalog_cols],
        source.alias("source"),
    ).withColumnsRenamed({f"out_{c}": c for c in catalog_cols})
