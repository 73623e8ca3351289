"""Ranking evaluation and embedding quality checks."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l2_norm, max_abs_difference

MODES = ["lexical", "vector", "hybrid"]
GATE = 0.99999
PROJECTIONS = 3


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: rank of the first relevant result, recall at 3 and at 5.

    ``results``: query_id, id, rank. ``qrels``: query_id, id. ``queries``: query_id
    plus pass-through columns; a query without results has recall 0.
    """
    labels = qrels.select("query_id", "id").distinct()
    totals = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hit = results.join(labels, ["query_id", "id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("first_relevant_rank"),
        F.count_distinct(F.when(F.col("rank") <= 3, F.col("id"))).alias("in3"),
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("id"))).alias("in5"),
    )
    out = queries.join(totals, "query_id").join(hit, "query_id", "left")
    recall = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("relevant")
    return out.select(*queries.columns, "first_relevant_rank", recall("in3").alias("recall3"), recall("in5").alias("recall5"))


def summarize_eval(rows: DataFrame) -> DataFrame:
    """Per requested mode: valid and unavailable queries, top-1, mean recalls, MRR.

    Only rows without an error whose actual mode is the requested one are valid.
    """
    ok = F.col("error_code").isNull() & F.coalesce(F.col("actual_mode") == F.col("mode"), F.lit(False))
    first = F.col("first_relevant_rank")
    mean = lambda c: F.avg(F.when(ok, c))
    seen = rows.groupBy("mode").agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("queries"),
        F.sum(F.when(ok, 0).otherwise(1)).alias("unavailable"),
        mean(F.when(first == 1, 1.0).otherwise(0.0)).alias("top1"),
        mean(F.col("recall3")).alias("recall3"),
        mean(F.col("recall5")).alias("recall5"),
        mean(F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
    )
    every = rows.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return every.join(seen, "mode", "left").fillna(0, ["queries", "unavailable"])


def rank_similarity(pairs: DataFrame) -> DataFrame:
    """Documents of each query by cosine, ties in input order.

    ``pairs``: query_id, position, query_vector, vector, tokens.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "position")
    scored = pairs.select("query_id", "position", "tokens", cosine(F.col("query_vector"), F.col("vector")).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(w))


def check_stability(pairs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Repeatability of one text: first/second embedding, and whether the related document
    outranks the unrelated one. Columns: id, first, second, related, unrelated."""
    a, b = F.col("first"), F.col("second")
    diff = max_abs_difference(a, b)
    return pairs.select(
        "id",
        cosine(a, b).alias("repeat_cosine"),
        diff.alias("max_absolute_difference"),
        (diff <= tolerance).alias("stable_within_tolerance"),
        (cosine(a, F.col("related")) > cosine(a, F.col("unrelated"))).alias("related_ranks_above_unrelated"),
    )


def close_runs(rows: DataFrame, gate: float) -> DataFrame:
    """run_id of the runs in which two baseline vectors have a cosine of at least ``gate``."""
    unit = rows.select("run_id", "position", F.col("baseline").cast("array<double>").alias("v"))
    alike = unit.groupBy("run_id", "v").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
    same = alike.filter("n > 1").select("run_id")
    # |s.(a - b)| <= |s| |a - b| = sqrt(d) sqrt(2 - 2 cos) for unit a, b and a vector s of signs
    width = F.sqrt(F.size("v")) * math.sqrt(max(2 - 2 * gate, 0.0)) * 1.001 + 1e-9
    norm = l2_norm(F.col("v"))

    def cell(k: int) -> Column:
        signed = F.transform("v", lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(2)) == 0, x).otherwise(-x))
        return F.floor(F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / norm / width)

    cells = alike.filter("n = 1").select("run_id", "position", "v", F.array(*[cell(k) for k in range(PROJECTIONS)]).alias("at"))
    moves = [F.array(*map(F.lit, m)) for m in product((-1, 0, 1), repeat=PROJECTIONS)]
    near = cells.withColumn("move", F.explode(F.array(*moves))).withColumn("at", F.zip_with("at", "move", lambda x, m: x + m)).drop("move")
    a, b = cells.alias("a"), near.alias("b")
    met = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.position") < F.col("b.position"))
    pairs = a.join(b, met & (cosine(F.col("a.v"), F.col("b.v")) >= gate), "left_semi").select("run_id")
    return same.union(pairs).distinct()


def correctness_gate(rows: DataFrame, gate: float = GATE) -> DataFrame:
    """Compare batched with one-by-one embeddings per run.

    ``rows``: run_id, position, baseline, batch, baseline_tokens, batch_tokens. A run
    passes if its baseline vectors are pairwise distinct, every batched vector
    matches its baseline and token counts and dimensions agree. Runs of any size are
    compared: unit vectors whose cosine reaches the gate are close, so their projections
    on a few sign vectors fall into the same or neighbouring grid cells, where they meet.
    """
    sizes = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"))
    match = cosine(F.col("baseline"), F.col("batch"))
    agree = F.col("baseline_tokens").eqNullSafe(F.col("batch_tokens")) & (F.size("baseline") == F.size("batch"))
    per_run = rows.groupBy("run_id").agg(
        F.min(match).alias("minimum_cosine"), F.min(agree & F.coalesce(match >= gate, F.lit(False))).alias("all_match")
    )

    close = close_runs(rows, gate).withColumn("close", F.lit(True))
    out = sizes.join(per_run, "run_id").join(close, "run_id", "left")
    outcome = F.when(F.coalesce("close", F.lit(False)) | ~F.col("all_match"), "BATCH_CORRECTNESS").otherwise("passed")
    return out.select("run_id", "documents", "minimum_cosine", outcome.alias("outcome"))


def summarize_vectors(df: DataFrame) -> DataFrame:
    """Dimensions, norm, first twelve values and tokens per ms (NULL without a positive duration)."""
    ms = F.col("inference_ms")
    return df.select(
        "id",
        F.size("vector").alias("dimensions"),
        l2_norm(F.col("vector")).alias("norm"),
        F.slice("vector", 1, 12).alias("first12"),
        "token_count",
        F.when(ms > 0, F.col("token_count") / ms).alias("tokens_per_ms"),
    )
