"""Pruned vector search against plain arithmetic on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_search import ITEM, ask, item
from tracetally.operators import search as S
from tracetally.operators import vector_index as N

VECTOR = "id string, revision string, fingerprint string, vector array<float>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 6)) * 3
    vecs = (centers[np.arange(900) % 12] + rng.normal(size=(900, 6)) * 0.2).astype(np.float32)
    vecs[300:600] = vecs[5]  # a third of all vectors are equal
    vecs[17] = 0
    rows = [(f"v{i:03}", "r1", "fp" if i % 13 else "old", v.tolist()) for i, v in enumerate(vecs)]
    rows[30] = (*rows[30][:3], [float("nan")] * 6)
    rows[31] = (*rows[31][:3], [None] * 6)
    rows.append(("short", "r1", "fp", [1.0, 2.0]))
    rows.append((None, None, None, None))
    vectors = spark.createDataFrame(rows, VECTOR).repartition(5)
    items = [item(f"v{i:03}", "x", scope="a" if i % 3 else "b", rev="r1" if i % 11 else "r2", vec="ready" if i % 7 else "stale") for i in range(900)]
    qs = np.vstack([centers + 0.1, vecs[5], -centers[:2], np.zeros((1, 6)), rng.normal(size=(4, 6))])
    names = [f"q{j}" for j in range(len(qs))]
    q = ask(spark, *[(name, "t", "vector") for name in names])
    q = q.join(spark.createDataFrame(list(zip(names, qs.tolist())), "query_id string, query_vector array<double>"), "query_id")
    q = q.withColumn("candidate_limit", F.lit(9).cast("bigint"))
    usable = [i for i in range(900) if i % 3 and i % 11 and i % 7 and i % 13 and i not in (17, 30, 31)]
    want = {}
    for name, ask_vec in zip(names, qs):
        if ask_vec.any():
            got = {i: np.dot(vecs[i].astype(float), ask_vec) / np.linalg.norm(vecs[i].astype(float)) / np.linalg.norm(ask_vec) for i in usable}
            want[name] = [f"v{i:03}" for i in sorted(usable, key=lambda i: (-round(got[i], 12), i))[:9]]
    return spark.createDataFrame(items, ITEM), vectors, q, want


def ranked(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("chunk", [8_192, 7])
def test_pruned_search_equals_brute_force(data, monkeypatch, chunk):
    items, vectors, q, want = data
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(S, "VECTOR_CHUNK", chunk)
    index = N.build_vector_index(vectors, "fp", 6)
    assert len(index.pivots) > 5
    assert ranked(S.search_vector(q, items, index, "fp", 6)) == want
    assert ranked(S.search_vector(q, items, vectors, "fp", 6)) == want


def test_blocks_are_skipped(data, monkeypatch):
    items, vectors, q, _ = data
    monkeypatch.setattr(N, "BLOCK", 40)
    work = S.vector_work(q, items, N.build_vector_index(vectors, "fp", 6), "fp", 6).first()
    plain = S.vector_work(q, items, vectors, "fp", 6).first()
    assert work.pairs == plain.pairs == plain.compared and plain.skipped == 0
    assert work.skipped > 0.5
    monkeypatch.setattr(S, "KEPT", 9 * 5)  # more, smaller chunks
    assert S.vector_work(q, items, vectors, "fp", 6).first().pairs == plain.pairs


def test_every_vector_of_the_fingerprint_is_kept(data, monkeypatch):
    _, vectors, _, _ = data
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "CLUSTERS", 3)
    rows = N.build_vector_index(vectors, "fp", 6).rows
    assert sorted(r.id for r in rows.collect()) == [f"v{i:03}" for i in range(900) if i % 13]
    assert sorted(r.id for r in rows.filter("not usable").collect()) == ["v017", "v030", "v031"]
    assert {r.block for r in rows.filter("not usable").collect()} == {-1}


def test_nothing_to_index(spark, data):
    items, vectors, q, _ = data
    empty = N.build_vector_index(vectors.limit(0), "fp", 6)
    assert S.search_vector(q, items, empty, "fp", 6).count() == 0
    full = N.build_vector_index(vectors, "fp", 6)
    assert S.search_vector(q.limit(0), items, full, "fp", 6).count() == 0
    assert S.search_vector(q, items.limit(0), full, "fp", 6).count() == 0
