"""Exact deduplication by composable polynomial fingerprints.

A text is reduced by deleting ASCII white space and read as UTF-8 bytes. Its fingerprint is
``sum((byte + 1) * base^(bytes after it))`` modulo a prime, for two bases, with the length.
Fingerprints of neighbouring chunks combine by length-shifted arithmetic
(``H(ab) = H(a) * base^len(b) + H(b)``), so the chunks of huge documents are hashed by different
tasks and each adds its shifted share to a sum. Documents with equal fingerprints are then
compared chunk by chunk with one representative; those that differ go to the next round.

Defined results: null text counts as empty; empty and blank texts form one group. Of equal texts
the row with the most code points, then the smallest id stays (a null id is larger than any).
Rows that repeat an id are separate members; of rows alike in id and code points one stays.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import fits, maybe_broadcast
from .common import per_row, stored, texts

SPACE = bytes([0x20, *range(0x09, 0x0E)])
PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
CHUNK = 1 << 16  # bytes hashed at once
HUGE = 1 << 23  # texts over so many bytes are hashed by several tasks
SHARE = 64  # members of a group that meet one copy of the representative's chunks
KEY = ["fp", "n_bytes"]

_powers: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0 modulo PRIME."""
    if base not in _powers:
        out, v = [], 1
        for _ in range(CHUNK):
            out.append(v)
            v = v * base % PRIME
        _powers[base] = np.array(out[::-1], dtype=np.uint64)
    return _powers[base]


def chunk_hash(data: bytes, base: int) -> int:
    """Polynomial hash of at most CHUNK bytes; the sum stays below 2^56."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.dot(b, powers(base)[CHUNK - len(b) :])) % PRIME if len(b) else 0


def combine(left: int, right: int, right_len: int, base: int) -> int:
    return (left * pow(base, right_len, PRIME) + right) % PRIME


def text_hash(data: bytes, base: int) -> int:
    h = 0
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        h = combine(h, chunk_hash(part, base), len(part), base)
    return h


def packed(h: list[int], mask: int) -> int:
    return ((h[0] << 31) | h[1]) & mask


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


def fingerprints(docs: DataFrame, huge: int = HUGE, mask: int = (1 << 62) - 1) -> DataFrame:
    """doc_id, fp, n_bytes, n_points, text_sha256 of every row. ``mask`` weakens the fingerprint in tests."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def whole():
        def one(doc_id, text):
            data = normalised(text)
            return [(doc_id, packed([text_hash(data, b) for b in BASES], mask), len(data), len(text), hashlib.sha256(data).hexdigest())]

        return one

    def cut():
        def one(row, doc_id, text):
            data = normalised(text)
            head = (row, doc_id, len(data), len(text), hashlib.sha256(data).hexdigest())
            return [(*head, len(data) - min(i + CHUNK, len(data)), data[i : i + CHUNK]) for i in range(0, max(1, len(data)), CHUNK)]

        return one

    def share():
        def one(row, doc_id, n_bytes, n_points, sha, after, part):
            return [(row, doc_id, n_bytes, n_points, sha, *[chunk_hash(part, b) * pow(b, after, PRIME) % PRIME for b in BASES])]

        return one

    large = F.octet_length("text") > huge
    small = per_row(docs.filter(~large), whole, f"doc_id {kind}, fp long, n_bytes long, n_points long, text_sha256 string")
    head = f"row long, doc_id {kind}, n_bytes long, n_points long, text_sha256 string"
    parts = per_row(docs.filter(large).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), cut, f"{head}, after long, part binary")
    shares = per_row(parts.repartition("row", "after"), share, f"{head}, h1 long, h2 long")
    whole_sum = lambda c: F.sum(c) % PRIME
    summed = shares.groupBy("row", "doc_id", "n_bytes", "n_points", "text_sha256").agg(whole_sum("h1").alias("h1"), whole_sum("h2").alias("h2"))
    fp = F.shiftleft("h1", 31).bitwiseOR(F.col("h2")).bitwiseAND(F.lit(mask))
    return small.unionByName(summed.select("doc_id", fp.alias("fp"), "n_bytes", "n_points", "text_sha256"))


def chunks_of(docs: DataFrame, mask: int) -> DataFrame:
    """fp, n_bytes, doc_id, text_sha256, chunk_no and chunk of every row; at least one chunk each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(doc_id, text):
            data = normalised(text)
            head = (packed([text_hash(data, b) for b in BASES], mask), len(data), doc_id, hashlib.sha256(data).hexdigest())
            return [(*head, i // CHUNK, data[i : i + CHUNK]) for i in range(0, max(1, len(data)), CHUNK)]

        return one

    return per_row(docs, make, f"fp long, n_bytes long, doc_id {kind}, text_sha256 string, chunk_no long, chunk binary")


def compare_round(docs: DataFrame, members: DataFrame, mask: int) -> DataFrame:
    """Compare the members of every group with its first one, chunk by chunk: KEY, doc_id, text_sha256, same.

    Members are spread over SHARE-sized parts and only the representative's chunks are repeated per part.
    """
    groups = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "text_sha256")).alias("rep"))
    groups = stored(groups.filter("size > 1"))
    in_group = stored(members.join(groups.select(*KEY), KEY, "left_semi").select(*KEY, "doc_id", "text_sha256").distinct())
    ids = in_group.select(F.col("doc_id").alias("id")).distinct()
    wanted = docs.join(maybe_broadcast(ids, fits(ids)), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    row = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*KEY, "text_sha256"]] + [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))]
    chunks = chunks_of(wanted, mask).alias("a").join(in_group.alias("b"), row, "left_semi").dropDuplicates([*KEY, "doc_id", "text_sha256", "chunk_no"])
    chunks = stored(chunks.join(groups, KEY))
    parts = F.ceil(F.col("size") / SHARE).cast("long")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_sha256") == F.col("rep.text_sha256"))
    reps = chunks.filter(is_rep).select(*KEY, "chunk_no", F.col("chunk").alias("rep_chunk"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    spread = chunks.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_sha256"), parts))
    met = spread.join(reps, [*KEY, "chunk_no", "part"], "left")
    return met.groupBy(*KEY, "doc_id", "text_sha256").agg(F.min(F.coalesce(F.col("chunk") == F.col("rep_chunk"), F.lit(False))).alias("same"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, mask: int = (1 << 62) - 1) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    docs = texts(docs, id_col, text_col)
    rows = stored(fingerprints(docs, huge, mask))
    left, classes, number = rows.select(*KEY, "doc_id", "text_sha256"), None, 0
    while True:  # one round, unless different texts share a fingerprint
        result = stored(compare_round(docs, left, mask))
        found = result.filter("same").select(*KEY, "doc_id", "text_sha256", F.lit(number).alias("class"))
        classes = found if classes is None else classes.unionByName(found)
        other = result.filter("NOT same")
        if other.isEmpty():
            break
        number, left = number + 1, other.select(*KEY, "doc_id", "text_sha256")
    c = classes.select(*[F.col(k).alias(f"c_{k}") for k in [*KEY, "doc_id", "text_sha256"]], "class")
    on = [F.col(f"c_{k}") == F.col(k) for k in [*KEY, "text_sha256"]] + [F.col("c_doc_id").eqNullSafe(F.col("doc_id"))]
    # a row that no other shares its fingerprint with, or the last one left of a collision, is a class of its own
    own = F.concat_ws("/", F.col("text_sha256"), F.coalesce(F.col("class"), F.lit(-1)))
    rows = rows.join(c, on, "left").select(*rows.columns, own.alias("class"))
    key = [*KEY, "class"]
    best = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("late"), "doc_id")).alias("top"),
    )
    best = best.select(*[F.col(k).alias(f"b_{k}") for k in key], "group_size", (-F.col("top.short")).alias("keep_points"), F.col("top.doc_id").alias("keep_id"))
    rows = rows.join(best, [F.col(k) == F.col(f"b_{k}") for k in key])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    # rows alike in class, id and code points are repeats of one row: number them so that one stays
    repeats = rows.filter(first).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "doc_id").orderBy("text_sha256")))
    out = repeats.unionByName(rows.filter(~first).withColumn("nth", F.lit(0)))
    return out.select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "text_sha256")
