"""Whitening against exact fractions and a floating-point eigenvalue solver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tracetally.llm import whitening
from tracetally.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def table_of(out):
    rows = sorted(out.collect(), key=lambda r: (r["vec_id"], r["component"]))
    ids = list(dict.fromkeys(r["vec_id"] for r in rows))
    return rows, np.array([r["whitened"] for r in rows]).reshape(len(ids), -1), ids


def check(vectors, out, wanted=32):
    """vectors: id -> list of floats, without rows that are left out."""
    rows, white, ids = table_of(out)
    assert ids == sorted(vectors)
    dims = max(map(len, vectors.values()))
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for i, v in vectors.items()}
    n, sums = len(x), [sum(v[k] for v in x.values()) for k in range(dims)]
    cov = np.array([[float(Fraction(n * sum(v[a] * v[b] for v in x.values()) - sums[a] * sums[b], n * n)) for b in range(dims)] for a in range(dims)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:wanted], vecs[:, ::-1][:, :wanted]
    assert white.shape[1] == min(wanted, int((values > 1e-9 * values[0]).sum()))
    for r in rows:
        assert (r["n"], int(r["deviation"])) == (n, sum((n * v - s) ** 2 for v, s in zip(x[r["vec_id"]], sums)))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x[i], sums)] for i in ids])
    want = centred @ vecs[:, : white.shape[1]] / np.sqrt(values[: white.shape[1]])
    assert np.abs(white.T @ white / n - np.eye(white.shape[1])).max() < 1e-9
    gaps = np.abs(np.diff(values[: white.shape[1]])).min(initial=values[0])
    if gaps > 1e-6 * values[0]:  # single eigenvalues: the components are those of the solver but for their sign
        sign = np.sign((want * white).sum(0))
        assert np.abs(want * sign - white).max() < 1e-6


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return {i: [float(np.float32(v)) for v in rng.normal(size=dims)] for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check(rows, QUERIES["op12_whitening"](spark, folder))


def test_odd_rows(spark):
    good = vectors(40, 5)
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    short = {200: [1.5, -2.25], 201: []}
    check({**good, **short}, whitening.whiten(frame(spark, [*good.items(), *odd, *short.items()])))


def test_fewer_vectors_than_dimensions(spark):
    rows = vectors(4, 9)
    check(rows, whitening.whiten(frame(spark, rows.items())))


def test_equal_eigenvalues_share_a_basis(spark):
    rows = {}
    for k in range(6):
        for sign in (1.0, -1.0):
            rows[len(rows)] = [sign * (3.0 if j == k else 0.0) for j in range(6)]
    out = whitening.whiten(frame(spark, rows.items()))
    check(rows, out)
    assert {round(r["explained"], 12) for r in out.collect()} == {round(1 / 6, 12)}


def test_repeated_null_and_text_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [2.0, 1.0]), ("7", [0.0, 0.5]), ("7", [0.0, 0.5])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert len(out) == 8 and {r["n"] for r in out} == {4}


def test_nothing_to_scale(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.columns == whitening.COLUMNS and out.count() == 0


def test_extra_columns_and_large_entries(spark):
    rows = [(k, [v, w], 1, "x") for k, (v, w) in enumerate([(1e30, 1.0), (-1e30, 2.0), (1e12, 3.0), (0.0, 4.0)])]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA + ", n int, whitened string"))
    got = table_of(out)[0]
    x = [[max(-(2**56), min(2**56, math.floor(64 * float(np.float32(c))))) for c in v] for _, v, _, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    assert [int(r["deviation"]) for r in got if r["component"] == 1] == [sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


def test_characteristic_polynomial(spark):
    rng = random.Random(3)
    for d in (1, 2, 5, 8):
        b = np.array([[rng.randrange(-50, 50) for _ in range(d)] for _ in range(d)], object)
        m = b.T @ b
        poly = whitening.characteristic(spark, m)
        one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        coefficients, acc = [], one  # Faddeev-LeVerrier in whole numbers
        for k in range(1, d + 1):
            product = m @ acc
            coefficients.append(-sum(product.diagonal()) // k)
            acc = product + coefficients[-1] * one
        assert poly == [int(c) for c in [*coefficients[::-1], 1]]


def test_roots_are_counted_and_found():
    poly = [1]
    for r in (2, 3, 3, 10, 1000):  # (x - 2)(x - 3)^2(x - 10)(x - 1000)
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [whitening.roots_above(poly, k, 0) for k in (0, 2, 3, 9, 10, 1000)] == [5, 4, 2, 2, 1, 0]
    found = [whitening.root(poly, k, 1018) for k in range(1, 6)]
    assert [round(k / (1 << bits), 9) for k, bits, _, _ in found] == [1000, 10, 3, 3, 2]
    assert [(first, copies) for _, _, first, copies in found] == [(1, 1), (2, 1), (3, 2), (3, 2), (5, 1)]
