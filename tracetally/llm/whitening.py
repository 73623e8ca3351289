"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Every entry c becomes the whole number floor(64 c) + 1000000. Tasks add up whole-number sums and
products, so the scatter n * sum(x x') - S S' (n^2 times the covariance) is exact. Its characteristic
polynomial is found modulo many primes, one prime at a time per task (reduction to Hessenberg form),
and put together by Chinese remaindering. All its roots are real, so Descartes' rule counts the roots
above a point exactly: each component's task bisects to its root, and solves (scatter - root) v = b
repeatedly in fixed-point numbers of ``BITS`` bits, which leaves the unit eigenvector.

What the driver holds depends on the number of dimensions only. Roots closer than 2^-ROOT_BITS of the
trace count as equal; they share one orthonormal basis.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; shorter
vectors (empty ones too) are filled up with zeros to the longest length; entries beyond +-2^56 count as
+-2^56. Repeated rows count as often as they occur. Components whose eigenvalue is zero can't be scaled
to variance one and are left out, so fewer vectors than components, equal vectors only, or an empty
table give fewer components or no rows. ``deviation`` is exact whatever its size (decimal). Only the id
and the vector are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 64, 1_000_000  # x = floor(64 c) + 1000000; the shift cancels in every result
LARGEST = 2**56
LIMB = 60
BITS, ROOT_BITS = 320, 220


# ---- whole-number vectors and their sums ----------------------------------------------------


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def whole_numbers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) of a batch of vectors as longs, filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), dims))
    with np.errstate(over="ignore"):
        out[np.arange(dims) < lengths[:, None]] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST)
    return out.astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y in Python's whole numbers: by floating point in slices too small to round."""
    top = int(np.abs(y).max(initial=0))
    if top >= 2**26:
        big = y.astype(object)
        return big.T @ big
    rows = max(1, 2**53 // max(1, top * top))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(0, len(y), rows):
        part = y[a : a + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as signed digits of 60 bits, so that sums stay exact."""
    sign, value, k = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while value or k == 0:
        yield k, sign * (value & (2**LIMB - 1))
        value, k = value >> LIMB, k + 1


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension and scatter matrix, exact (of floor(64 c))."""
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = whole_numbers(batch.column(0), dims)
            n += len(y)
            sums += y.astype(object).sum(0) if len(y) else 0
            products += exact_products(y)
        rows = [(pos, k, part) for pos, v in enumerate([n, *sums, *products[upper]]) for k, part in limbs(int(v))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["pos", "limb", "part"])

    parts = vectors.mapInArrow(partial, "pos long, limb long, part long")
    total: dict[int, int] = {}
    for r in parts.groupBy("pos", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():
        total[r["pos"]] = total.get(r["pos"], 0) + (int(r["s"]) << (LIMB * r["limb"]))
    n, sums = total.get(0, 0), [total.get(1 + k, 0) for k in range(dims)]
    m = np.zeros((dims, dims), object)
    for at, (i, j) in enumerate(zip(*upper)):
        m[i, j] = m[j, i] = n * total.get(1 + dims + at, 0) - sums[i] * sums[j]
    return n, sums, m


# ---- characteristic polynomial ---------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.4e14."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bits: float) -> list[int]:
    """Primes below 2^31, from the top, whose product has more than so many bits."""
    found, p = [], 2**31 - 1
    while sum(map(math.log2, found)) <= bits:
        if is_prime(p):
            found.append(p)
        p -= 2
    return found


def characteristic_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo a prime below 2^31, constant first."""
    d = len(m)
    a = (m % p).astype(np.int64)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        a[[k, r]] = a[[r, k]]
        a[:, [k, r]] = a[:, [r, k]]
        f = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - f[:, None] * a[k]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * f % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k part
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k - 1, :-1]
        weights, chain = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # the chain is the product of subdiagonal entries passed
            weights[i] = int(a[i, k - 1]) * chain % p
            chain = chain * int(a[i, i - 1]) % p if i else chain
        polys[k] = (row - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(x - m) for a positive semi-definite whole-number matrix, constant first."""
    d, trace = len(m), int(sum(m.diagonal()))
    primes = primes_beyond(d * math.log2(1 + -(-trace // d)) + 2)  # elementary symmetric sums are at most (1 + trace / d) ^ d

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([characteristic_mod(m, p)], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = tasks.mapInArrow(one, "p long, residues array<long>").collect()
    modulus = math.prod(r["p"] for r in found)
    out = [0] * (d + 1)
    for r in found:
        rest = modulus // r["p"]
        weight = rest * pow(rest, -1, r["p"])
        for k, value in enumerate(r["residues"]):
            out[k] += value * weight
    out = [c % modulus for c in out]
    return [c - modulus if 2 * c > modulus else c for c in out]


# ---- roots and components ----------------------------------------------------------------------


def roots_above(poly: list[int], k: int, bits: int) -> int:
    """Number of roots, with multiplicity, above k / 2^bits: the sign changes of the shifted polynomial (all roots are real)."""
    top = len(poly) - 1
    c = [v << (bits * (top - i)) for i, v in enumerate(poly)]
    for start in range(top):
        for i in range(top - 1, start - 1, -1):
            c[i] += k * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], k: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * k + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def root(poly: list[int], number: int, trace: int) -> tuple[int, int, int, int]:
    """The root of that number from the top (from 1): (k, bits, number of its first copy, copies), the root being k / 2^bits."""
    bits, low, high = 0, 0, trace + 1  # roots above: at low at least ``number``, at high fewer
    above_low, above_high = roots_above(poly, 0, 0), 0
    finest = max(8, ROOT_BITS - trace.bit_length())
    while above_low - above_high > 1 and (bits < finest or high - low > 1):
        if high - low == 1:
            bits, low, high = bits + 1, 2 * low, 2 * high
        mid = (low + high) // 2
        above = roots_above(poly, mid, bits)
        low, high, above_low, above_high = (mid, high, above, above_high) if above >= number else (low, mid, above_low, above)
    side = sign_at(poly, high, bits)
    while above_low - above_high == 1 and side and (bits < finest or high - low > 1):
        if high - low == 1:
            bits, low, high = bits + 1, 2 * low, 2 * high
        mid = (low + high) // 2
        here = sign_at(poly, mid, bits)
        low, high = (mid, mid) if here == 0 else (low, mid) if here == side else (mid, high)
        if low == high:
            break
    return high, bits, above_high + 1, above_low - above_high


def eigenvectors(m: np.ndarray, k: int, bits: int, copies: int) -> np.ndarray:
    """Orthonormal vectors of the eigenvalue k / 2^bits by inverse iteration in fixed-point numbers."""
    d = len(m)
    a = np.array([[int(v) << BITS for v in row] for row in m], object)
    for i in range(d):
        a[i, i] -= (k << BITS) >> bits
    order = list(range(d))
    for c in range(d):  # triangular factors, in place, with row exchanges
        best = max(range(c, d), key=lambda r: abs(a[r, c]))
        a[[c, best]] = a[[best, c]]
        order[c], order[best] = order[best], order[c]
        if a[c, c] == 0:
            a[c, c] = 1
        if c + 1 < d:
            factors = (a[c + 1 :, c] << BITS) // a[c, c]
            a[c + 1 :, c + 1 :] -= (factors[:, None] * a[c, c + 1 :]) >> BITS
            a[c + 1 :, c] = factors
    x = np.array([[(((i * 7919 + j * 104729) * 2654435761 >> 7) % 2003 - 1001 or 1) << BITS for j in range(copies)] for i in range(d)], object)
    for _ in range(3):
        b = x[order]
        for c in range(d):
            b[c + 1 :] -= (a[c + 1 :, c][:, None] * b[c]) >> BITS
        for c in range(d - 1, -1, -1):
            b[c] = ((b[c] - ((a[c, c + 1 :][:, None] * b[c + 1 :]) >> BITS).sum(0)) << BITS) // a[c, c]
        x = b
        for j in range(copies):  # unit length, at right angles to the vectors before
            v = x[:, j]
            v = (v << (2 * BITS)) // max(1, *map(abs, v))
            for before in range(j):
                v = v - ((x[:, before] * ((x[:, before] * v).sum() >> BITS)) >> BITS)
            x[:, j] = (v << BITS) // max(1, math.isqrt(int((v * v).sum())))
    return np.array([[int(v) / (1 << BITS) for v in row] for row in x])


def components(spark: SparkSession, m: np.ndarray, wanted: int) -> list[tuple[float, float, list[float]]]:
    """Share of the trace, square root of the eigenvalue and unit vector of the largest components with an eigenvalue above zero."""
    if not len(m) or not any(m.diagonal()):
        return []
    poly, trace = characteristic(spark, m), int(sum(m.diagonal()))
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    count = min(wanted, len(poly) - 1)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                k, bits, first, copies = root(poly, number, trace)
                v = eigenvectors(m, k, bits, copies)[:, number - first]
                size = math.isqrt(k << (2 * BITS + bits)) / (1 << (BITS + bits))
                yield pa.RecordBatch.from_pylist([{"number": number, "share": k / (trace << bits), "size": size, "vector": v.tolist()}])

    tasks = spark.range(1, count + 1, 1, min(count, 4 * spark.sparkContext.defaultParallelism))
    found = tasks.mapInArrow(one, "number long, share double, size double, vector array<double>").collect()
    return [(r["share"], r["size"], list(r["vector"])) for r in sorted(found, key=lambda r: r["number"])]


# ---- whitening ---------------------------------------------------------------------------------


def _identity_error(white: DataFrame, n: int, size: int) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity; centred before multiplying."""

    def totals(fold, width):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(width)
            for batch in batches:
                acc += fold(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(acc)], names=["pos", "part"])

        sums = white.select("whitened").mapInArrow(run, "pos long, part double").groupBy("pos").agg(F.sum("part").alias("s")).collect()
        return np.array([r["s"] for r in sorted(sums, key=lambda r: r["pos"])])

    mean = totals(lambda w: w.sum(0), size) / n
    cov = totals(lambda w: (w - mean).T @ (w - mean), size * size).reshape(size, size) / n
    return float(np.abs(cov - np.eye(size)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = 32) -> DataFrame:
    """vec_id, component, n, deviation (exact), whitened, explained, identity_error: one row per usable vector and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    n, sums, m = scatter(rows.select("vec"), dims)
    found = components(spark, m, wanted)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>"
    if not found:
        empty = spark.createDataFrame([], schema + ", component int, explained double, identity_error double")
        return empty.withColumn("whitened", F.element_at("whitened", 1)).select(*COLUMNS)
    basis = np.array([v for _, _, v in found]).T
    sizes = np.array([s for _, s, _ in found])
    centre = np.array(sums, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(batch.column(1), dims)
            top = n * max(int(np.abs(y).max(initial=0)), 1) + max(map(abs, sums))
            if top < 2**53 and dims * top * top < 2**63:
                moved = n * y - centre.astype(np.int64)
                deviation, moved = (moved * moved).sum(1).tolist(), moved.astype(np.float64)
            else:
                moved = n * y.astype(object) - centre
                deviation, moved = (moved * moved).sum(1).tolist(), moved.astype(np.float64)
            white = moved @ basis / sizes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n] * len(y), pa.int64()),
                    pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(0, white.size + 1, len(sizes), dtype=np.int32), white.reshape(-1)),
                ],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    white = stored(rows.mapInArrow(project, schema))
    error = _identity_error(white, n, len(sizes))
    shares = F.array(*[F.lit(s) for s, _, _ in found])
    out = white.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
