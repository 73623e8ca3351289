"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint has 64 bits, each 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Cut into BLOCKS blocks, two fingerprints that differ in at most ``bits``
bits agree in at least BLOCKS - bits of them, so they meet under one of the keys made of that many
blocks. Equal fingerprints are one node from the start. Inside a bucket only the links that join
parts not yet connected are kept, so a dense group of m copies gives m - 1 links, not m * m.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; rows that repeat an id share a node;
the component is the smallest id reachable (null ids are ignored unless there is no other). An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, free_name, per_row, stored, texts
from .components import components

BLOCKS = 6
RUN = 1 << 15  # shingles hashed at a time
BUCKET = 20_000  # fingerprints of a bucket held in memory; larger buckets are compared part by part


def simhash(text: str, words: int) -> int:
    data = text.encode("utf-8", "surrogatepass").lower()  # on bytes: A-Z only
    tokens = data.split()  # on bytes: \x20 and \x09-\x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, RUN):
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(first[i : i + RUN], last[i : i + RUN])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_row(docs, lambda: lambda doc_id, text: [(doc_id, signed(simhash(text, words)))], f"doc_id {kind}, fp long")


def block_masks(bits: int, blocks: int = BLOCKS) -> list[int]:
    """One mask per choice of blocks that must agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - bits)]


def spanning_links(f: np.ndarray, bits: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of at most ``bits`` differing bits that connect what all such links connect.

    With ``other``: only links between the two arrays.
    """
    both = f if other is None else np.concatenate([f, other])
    group = np.arange(len(both))
    out = []
    for i in range(len(f)):
        far = np.nonzero(group != group[i])[0]
        far = far[far > i] if other is None else far[far >= len(f)]
        if not len(far):
            if other is None and (group == group[0]).all():
                break
            continue
        near = far[np.bitwise_count(both[far] ^ both[i]) <= bits]
        for j in near:
            if group[j] != group[i]:
                out.append((int(both[i]), int(both[j])))
                group[group == group[j]] = group[i]
    return out


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(rows, dtype=np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def near_links(prints: DataFrame, bits: int = 3, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; their components are those of all close pairs."""
    masks = block_masks(bits, blocks)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("one"), F.max("fp").alias("two"))
    sizes = stored(sizes.filter("size > 1"))
    # buckets of two need no further pass
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    pairs = sizes.filter("size = 2").filter(close("one", "two")).select(F.col("one").alias("a"), F.col("two").alias("b")).distinct()
    more = keyed.join(sizes.filter("size > 2").select("choice", "key", "size"), ["choice", "key"])
    parts = F.ceil(F.col("size") / bucket).cast("int")
    more = more.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # every pair of parts of a large bucket meets once; a bucket of one part meets itself
    met = more.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("choice", "key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "fp")
    ordered = met.repartition("choice", "key", "p", "q").sortWithinPartitions("choice", "key", "p", "q", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("choice", "key", "p", "q")
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, part, fp = np.stack(cols[:4]), cols[4], cols[5].view(np.uint64)
            edges = np.concatenate(([0], np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1, [len(fp)]))
            out = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if e - s < 2:
                    continue
                if key[2, s] == key[3, s]:
                    out += spanning_links(fp[s:e], bits)
                else:
                    left = part[s:e] == key[2, s]
                    out += spanning_links(fp[s:e][left], bits, fp[s:e][~left])
            if out:
                yield _links(sorted(set(out)))

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (*names, "part", "fp")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.stack([c[-1] for c in cols[:4]])
            whole = int(np.nonzero((np.stack(cols[:4]) != last[:, None]).any(axis=0))[0].max(initial=-1)) + 1
            held = [c[whole:] for c in cols]
            if whole:
                yield from solve([c[:whole] for c in cols])
        if held is not None:
            yield from solve(held)

    return pairs.union(ordered.mapInArrow(run, "a long, b long")).distinct()


def component_ids(marks: DataFrame, least, bits: int, blocks: int, bucket: int) -> DataFrame:
    """(fp, least) for every fingerprint: the smallest ``least`` over its component."""
    prints = stored(marks.groupBy("fp").agg(F.min(least).alias("own")))
    linked = stored(components(near_links(prints.select("fp"), bits, blocks, bucket)))
    nodes = prints.join(linked.withColumnRenamed("node", "fp"), "fp")
    groups = nodes.groupBy("component").agg(F.min("own").alias("least"))
    moved = nodes.join(groups, "component").select("fp", "least")
    return prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "own").alias("least"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row."""
    marks = stored(fingerprints(texts(docs, id_col, text_col), words))
    ids = component_ids(marks, F.col("doc_id"), bits, blocks, bucket)
    return marks.join(ids, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """One row, with all columns, of every component: the one with the smallest id (null ids last), then fingerprint, then text."""
    marks = stored(fingerprints(texts(docs, id_col, text_col), words))
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp")
    fp, nth, keep_id, keep_fp = (free_name(docs, c) for c in ("__fp", "__nth", "__keep_id", "__keep_fp"))
    stays = component_ids(marks, first, bits, blocks, bucket).select("least.doc_id", "least.fp").distinct().toDF(keep_id, keep_fp)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                prints = [signed(simhash(t or "", words)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.int64())], names=[*part.schema.names, fp])

    rows = docs.mapInArrow(run, docs.withColumn(fp, F.lit(0).cast("long")).schema)
    kept = rows.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col(keep_id)) & (F.col(fp) == F.col(keep_fp)), "left_semi")
    one = Window.partitionBy(F.col(f"`{id_col}`"), fp).orderBy(F.col(f"`{text_col}`"))  # more than one row only where ids repeat
    return kept.withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
