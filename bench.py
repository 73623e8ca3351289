"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs in full and is written to the no-op sink, so nothing is
collected on the driver. ``bulk_qps`` are searches per second in bulk: a table
of queries answered by one job against an index built beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tracetally.functions.sizing import cut
from tracetally.operators import index as X
from tracetally.operators import inverted as I
from tracetally.operators import search as S
from tracetally.plans import registry
from tracetally.plans.derived import table
from tracetally.session import local_session

NAMES = [
    "session_summary", "attempt_cost", "call_cost", "attribution", "fallback_chain", "latency_stats", "stage", "index_stats", "authorized_items",
    "derive_energy", "throughput_blocks", "pack_batches", "build_context", "tool_fold", "active_ancestry",
]
FP, DIMS = "fp-new", 64


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    seconds: dict[str, float] = {}
    registry.QUERIES["calls_by_status"](spark, folder).count()  # start the session

    for name in NAMES:
        start = time.perf_counter()
        timed(registry.QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    items = table(spark, folder, "retrieval_items")
    start = time.perf_counter()
    lexical = I.write_inverted(I.build_inverted(cut(X.build_lexical(items))))
    seconds["index_build"] = round(time.perf_counter() - start, 3)
    state = cut(items.drop("content"))
    vectors = cut(table(spark, folder, "retrieval_vectors").drop("label"))
    grant = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("key"))
    asks = table(spark, folder, "chat_queries").select(
        "query_id", "text", F.lit("hybrid").alias("mode"), F.array(grant("team", F.col("team")), grant("global", F.lit("*"))).alias("grants"),
        F.abs(F.hash("query_id")).cast("long").alias("seed"),
    )
    asks, _ = S.validate_queries(asks)
    asks = cut(X.synthetic_vectors(asks, "seed", DIMS, "query_vector"))
    n = asks.count()
    runs = {
        "search_bm25": lambda: S.search_lexical(asks, state, lexical, "bm25"),
        "search_tfidf": lambda: S.search_lexical(asks, state, lexical, "tfidf"),
        "search_vector": lambda: S.search_vector(asks, state, vectors, FP, DIMS),
        "search_hybrid": lambda: S.search(asks, state, lexical, vectors, FP, DIMS)[0],
    }
    qps = {}
    for name, make in runs.items():
        start = time.perf_counter()
        timed(make())
        seconds[name] = round(time.perf_counter() - start, 3)
        qps[name] = round(n / seconds[name], 1)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "search_queries": n, "bulk_qps": qps,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
