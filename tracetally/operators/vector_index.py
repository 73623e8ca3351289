"""Clustered vectors with exact pruning by the triangle inequality.

Vectors are kept in clusters around pivots; a block is a ring of one cluster, so
all its angles to the pivot lie close together. The angle between a query and a
vector is at least the difference of their angles to the same pivot. A block whose
bound is below a score that already fills the query's list is skipped whole. Ties
are kept, so results equal those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import cut

BLOCK = 512  # vectors a block should have
RINGS = 64  # rings a cluster has at most; beyond that its rings are dealt by id
CLUSTERS = 1_024
PIVOT_BYTES = 8 << 20  # pivots travel with the tasks
SAMPLE_BYTES = 64 << 20  # vectors the pivots are fitted on, on the driver
FEWEST = 4  # the first scan looks at clusters with this many times the wanted vectors
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9  # above the rounding of arccos near zero and of a dot product
PRODUCT = 1 << 22  # products held at once
HIT = "query_id string, id string, revision string, score double, candidate_limit bigint, compared bigint, pairs bigint"


def usable_vector(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(F.forall(v, lambda x: x.isNotNull()) & ~F.isnan(squares) & (squares > 0) & (squares != float("inf")), F.lit(False))


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: id, revision, vector, usable, cluster, angle, block of one fingerprint and length.
    ``pivots``: unit vectors by cluster; ``spans``: smallest angle, largest angle and vectors by cluster."""

    rows: DataFrame
    pivots: np.ndarray
    spans: np.ndarray


def unclustered(vectors: DataFrame, fingerprint: str, dims: int) -> VectorIndex:
    """A plain vector table as an index without pivots: nothing can be skipped."""
    rows = vectors.filter((F.col("fingerprint") == fingerprint) & (F.size("vector") == dims))
    rows = rows.select("id", "revision", "vector", usable_vector(F.col("vector")).alias("usable"))
    none = {"cluster": F.lit(-1), "angle": F.lit(0.0), "block": F.lit(0).cast("long")}
    return VectorIndex(rows.withColumns(none), np.zeros((0, dims)), np.zeros((0, 3)))


def _units(vectors) -> np.ndarray:
    """Vectors of length one; NaN where there is no direction."""
    v = np.vstack(list(vectors)).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        v /= np.abs(v).max(axis=1, keepdims=True)  # squares of small numbers do not vanish
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means on the sample; a pivot that loses all its vectors stays where it was."""
    pivots = np.unique(sample[:n], axis=0)
    for _ in range(6):
        home = np.concatenate([(part @ pivots.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 1_000))])
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        pivots = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], pivots)
    return pivots


def build_vector_index(vectors: DataFrame, fingerprint: str, dims: int) -> VectorIndex:
    """Cluster the vectors of one fingerprint; write it once, search it many times.

    Pivots are fitted on the vectors with the smallest id hashes (at most SAMPLE_BYTES);
    every vector is indexed. Vectors that are not usable are kept and marked.
    """
    rows = unclustered(vectors, fingerprint, dims).rows.select("id", "revision", "vector", "usable")
    good = rows.filter("usable")
    n = good.count()
    wanted = max(1, min(CLUSTERS, PIVOT_BYTES // (8 * dims), -(-n // BLOCK)))
    drawn = max(wanted, min(16 * wanted, SAMPLE_BYTES // (8 * dims)))
    picked = good.orderBy(F.xxhash64("id", "revision"), "id", "revision").limit(drawn).select("vector").collect()
    if not picked:
        return unclustered(vectors, fingerprint, dims)
    pivots = _fit_pivots(_units(r[0] for r in picked), wanted)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cluster, angle = np.full(len(pdf), -1), np.zeros(len(pdf))
            ok = np.flatnonzero(pdf["usable"].to_numpy())
            if len(ok):
                near = _units(pdf["vector"].to_numpy()[ok]) @ pivots.T
                cluster[ok] = near.argmax(axis=1)
                angle[ok] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pdf.assign(cluster=cluster.astype(np.int32), angle=angle)

    dealt = cut(rows.mapInPandas(nearest, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
    steps = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    stats = dealt.filter("usable").groupBy("cluster").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", steps).alias("edges")
    )
    stats = cut(stats)
    spans = np.zeros((len(pivots), 3))
    for r in stats.select("cluster", "lo", "hi", "n").collect():  # at most CLUSTERS rows
        spans[r["cluster"]] = r["lo"], r["hi"], r["n"]
    parts = F.ceil(F.col("n") / BLOCK)
    ring = F.floor(F.size(F.filter("edges", lambda e: e < F.col("angle"))) * F.least(parts, F.lit(RINGS)) / RINGS)
    deal = F.pmod(F.xxhash64("id"), F.ceil(parts / RINGS))
    block = F.coalesce((F.col("cluster") * RINGS + ring) * F.lit(1 << 32) + deal, F.lit(-1)).cast("long")
    rows = dealt.join(F.broadcast(stats.select("cluster", "n", "edges")), "cluster", "left").withColumn("block", block)
    rows = rows.select("id", "revision", "vector", "usable", "cluster", "angle", "block")
    return VectorIndex(cut(rows.repartition("block", F.pmod(F.xxhash64("id"), F.when(F.col("usable"), 1).otherwise(64))).sortWithinPartitions("block")), pivots, spans)


@dataclass
class Asks:
    """A bounded block of queries as the tasks hold it."""

    names: list[str]
    matrix: np.ndarray
    limits: np.ndarray
    policy: np.ndarray
    need: np.ndarray = field(init=False)  # a score the k-th best is known to reach
    units: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.need = np.full(len(self.names), -np.inf)
        self.units = _units(self.matrix)

    def bounds(self, angles: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Largest cosine a vector can have whose angle to the pivot lies between lo and hi."""
        gap = np.maximum(lo - angles, angles - hi) - ANGLE_SLACK
        return np.cos(np.maximum(gap, 0.0))

    def by_cluster(self, index: VectorIndex) -> np.ndarray:
        angles = np.arccos(np.clip(self.units @ index.pivots.T, -1, 1))
        return np.where(index.spans[:, 2] > 0, self.bounds(angles, index.spans[:, 0], index.spans[:, 1]), -np.inf)

    def homes(self, index: VectorIndex) -> np.ndarray:
        """queries x clusters: the most promising clusters that hold FEWEST times the wanted vectors."""
        angles = np.arccos(np.clip(self.units @ index.pivots.T, -1, 1))
        order = np.argsort(np.where(index.spans[:, 2] > 0, angles, np.inf), axis=1, kind="stable")
        before = np.cumsum(index.spans[order, 2], axis=1) - index.spans[order, 2]
        homes = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(homes, order, before < FEWEST * self.limits[:, None], axis=1)
        return homes


def scan_blocks(eligible: DataFrame, asks: Asks, pivots: np.ndarray, meets: np.ndarray | None = None) -> DataFrame:
    """Every task's own top-k per query over (id, revision, vector, policies, cluster, angle, block).

    With ``meets`` (queries x clusters) a query meets only the clusters marked there. Each task adds a row without
    query_id: the pairs it compared and all pairs of its vectors and the queries.
    """
    n_policies = int(asks.policy.max()) + 1

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(asks.names)
        best: list[list[tuple[float, str, str]]] = [[] for _ in range(n)]
        floor = asks.need.copy()
        q_sq = np.cumsum(asks.matrix * asks.matrix, axis=1)[:, -1]
        step = max(1, PRODUCT // n)
        compared = pairs = 0
        for pdf in frames:
            if pdf.empty:
                continue
            v = np.vstack(pdf["vector"].to_numpy()).astype(np.float64)
            v_sq = np.cumsum(v * v, axis=1)[:, -1]
            seen = np.zeros((len(pdf), n_policies), dtype=bool)
            for i, ps in enumerate(pdf["policies"]):
                seen[i, ps] = True
            ids, revs = pdf["id"].to_numpy(), pdf["revision"].to_numpy()
            block, cluster, angle = pdf["block"].to_numpy(), pdf["cluster"].to_numpy(), pdf["angle"].to_numpy()
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                for at in range(a, b, step):
                    end = min(at + step, b)
                    pairs += (end - at) * n
                    active = seen[at:end].any(axis=0)[asks.policy]
                    if cluster[at] >= 0:
                        to_pivot = np.arccos(np.clip(asks.units @ pivots[cluster[at]], -1, 1))
                        active &= asks.bounds(to_pivot, angle[at:end].min(), angle[at:end].max()) >= floor - SCORE_SLACK
                        if meets is not None:
                            active &= meets[:, cluster[at]]
                    chosen = np.flatnonzero(active)
                    compared += (end - at) * len(chosen)
                    if not len(chosen):
                        continue
                    # the fast product only preselects; survivors are scored in a fixed order
                    approx = (v[at:end] @ asks.matrix[chosen].T) / np.sqrt(np.outer(v_sq[at:end], q_sq[chosen]))
                    approx[~seen[at:end][:, asks.policy[chosen]]] = -np.inf
                    promising = np.flatnonzero(approx.max(axis=0) >= np.maximum(floor[chosen] - SCORE_SLACK, -2.0))
                    for c in promising:
                        j, col = chosen[c], approx[:, c]
                        k, least = int(asks.limits[j]), floor[j]
                        if len(col) > k:
                            least = max(least, np.partition(col, len(col) - k)[len(col) - k])
                        pick = at + np.flatnonzero((col >= least - SCORE_SLACK) & np.isfinite(col))
                        if not len(pick):
                            continue
                        dot = np.cumsum(v[pick] * asks.matrix[j], axis=1)[:, -1]
                        score = np.clip(dot / np.sqrt(v_sq[pick] * q_sq[j]), -1.0, 1.0)
                        merged = best[j] + [(float(s), ids[i], revs[i]) for s, i in zip(score, pick)]
                        merged.sort(key=lambda t: (-t[0], t[1]))
                        best[j] = merged[:k]
                        if len(best[j]) == k:
                            floor[j] = max(floor[j], best[j][-1][0])
        for first in range(0, n, 256):
            part = range(first, min(first + 256, n))
            out = [(asks.names[j], t[1], t[2], t[0], int(asks.limits[j]), 0, 0) for j in part for t in best[j]]
            yield pd.DataFrame(out, columns=["query_id", "id", "revision", "score", "candidate_limit", "compared", "pairs"])
        yield pd.DataFrame({"query_id": [None], "id": [None], "revision": [None], "score": [0.0], "candidate_limit": [0], "compared": [compared], "pairs": [pairs]})

    return eligible.mapInPandas(scan, HIT)
