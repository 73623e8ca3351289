"""Near copies by SimHash with verified links: one document stays of every group of similar texts.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Such
texts differ in about ten of the 64 bits of a whole-text fingerprint, too many for blocks of its bits.
So the blocks are content-defined stretches of some dozen words, each with a fingerprint of its own:
the edits that a similar pair can have leave most stretches untouched, and the pair shares them. Texts
of few shingles take their shingles themselves as blocks. Of a text's blocks only the rarest join: the
prefix rule says that two texts which share a given part of their blocks share one of these. Blocks of
a passage that many texts hold are thus left to the texts that have little else.

Whole-text fingerprints are joined too, by the pigeonhole rule on their own six blocks: all texts that differ
in at most three bits meet, whatever stretches they share.

Texts that meet are compared by length and by the Hamming distance of their whole-text fingerprints,
and what passes is verified on the shingle sets. A bucket first names only the links that connect its
texts. Texts still in different components then name their nearest others, eight times as many in each
round, until none is left unnamed; nothing is capped.

Defined results: null text counts as empty; texts that have the same words (A-Z lower-cased) are one
node, texts without words too; the row with the smallest id stays (null ids last), then the smallest
hash of id and text; of repeated rows one stays. An empty table gives an empty result; other columns stay
as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, free_name, fresh_worker, per_row, stored, texts
from .components import components
from .simhash import BUCKET, RUN, block_masks, signed

WORDS = 5
SIMILAR = 0.8
REACH = 6  # a stretch ends at a word whose hash is the least of this many words on both sides
SHARED = 0.5  # part of the stretches that a similar pair shares
FEW = 60  # up to this many shingles, the shingles are the blocks
RADIUS = 18  # bits; a pair of similarity 0.8 differs in 9.7 on average, with a deviation of 2.9
BITS = 3  # differing bits of whole-text fingerprints that always meet
NAMED = 4
TOGETHER = 256  # texts compared with one copy of their centre's text
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z; \x20 and \x09-\x0D


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; fewer words make one shingle."""
    if not len(hashes):
        return hashes
    width, n = min(words, len(hashes)), max(1, len(hashes) - words + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * BASE + hashes[j : j + n]
    return np.unique(mixed(h))


def stretches(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Hashes of the different stretches between words whose hash is least around them."""
    least = np.ones(len(hashes), bool)
    for d in range(1, min(reach, len(hashes) - 1) + 1):
        least[d:] &= hashes[d:] < hashes[:-d]
        least[:-d] &= hashes[:-d] <= hashes[d:]
    starts = np.union1d(np.nonzero(least)[0], [0])
    ends = np.append(starts[1:], len(hashes))
    powers, backs = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(hashes), x)), dtype=np.uint64) for x in (BASE, BACK))
    sums = np.concatenate((np.zeros(1, np.uint64), (hashes * powers[:-1]).cumsum(dtype=np.uint64)))
    return np.unique(mixed((sums[ends] - sums[starts]) * backs[starts] + (ends - starts).astype(np.uint64)))


def fingerprint(shingles: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), RUN):
        part = np.ascontiguousarray(shingles[i : i + RUN])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def row_digest(doc_id, text: str | None) -> bytes:
    """Digest of the id and the whole text: rows are found again by one column, whatever the type of the id."""
    return xxhash.xxh3_128_digest(f"{doc_id!r}:{text or ''}".encode("utf-8", "surrogatepass"))


def profile(text: str, words: int, similar: float, few: int) -> tuple:
    """Digest of the words, number of shingles, fingerprint, fine blocks and coarse blocks."""
    tokens = words_of(text)
    hashes = word_hashes(tokens)
    shingles = shingle_set(hashes, words)
    as_longs = lambda x: x.view(np.int64).tolist()
    fine = as_longs(shingles) if len(shingles) <= few else []
    # a partner of more than `few` shingles has blocks of stretches alone
    coarse = as_longs(stretches(hashes)) if len(shingles) >= int(similar * few) and len(hashes) else []
    return xxhash.xxh3_128_digest(b" ".join(tokens)), len(shingles), signed(fingerprint(shingles)), fine, coarse


def profiles(docs: DataFrame, words: int, similar: float, few: int) -> DataFrame:
    """One row per different sequence of words: node, the row that stands for it, shingles, fingerprint, blocks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, raw binary, words binary, n int, fp long, fine array<long>, coarse array<long>"
    rows = per_row(docs, lambda: lambda doc_id, text: [(doc_id, row_digest(doc_id, text), *profile(text, words, similar, few))], schema)
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "raw")
    same = rows.groupBy("words").agg(F.min(first).alias("own"), *[F.first(c).alias(c) for c in ("n", "fp", "fine", "coarse")])
    return stored(same.drop("words").withColumn("node", F.monotonically_increasing_id()))


def rare_blocks(nodes: DataFrame, similar: float, shared: float) -> DataFrame:
    """block, node, n, fp: of every text the blocks that the prefix rule asks for, if another text has them too."""
    each = nodes.select("node", F.posexplode(F.array("fine", "coarse")).alias("scale", "blocks"))
    each = each.select("node", "scale", F.size("blocks").alias("all"), F.explode("blocks").alias("block"))
    common = each.groupBy("block").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    of_text = Window.partitionBy("node", "scale")
    ranked = each.join(common, "block").withColumns(
        {"nth": F.row_number().over(of_text.orderBy("held", "block")), "others": F.count(F.lit(1)).over(of_text)}
    )
    share = F.when(F.col("scale") == 0, F.lit(similar)).otherwise(F.lit(shared))
    prefix = F.col("all") - F.ceil(F.col("all") * share - 1e-9) + 1  # blocks that no other text has come first
    kept = ranked.filter(F.col("all") - F.col("others") + F.col("nth") <= prefix).select("node", "block")
    return stored(kept.join(nodes.select("node", "n", "fp"), "node"))


def print_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """block, node, n, fp: every text under the choices of its fingerprint's blocks that another text has too."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(block_masks(bits))])
    each = nodes.select(F.explode(keys).alias("block"), "node", "n", "fp")
    common = each.groupBy("block").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("block")
    return stored(each.join(common, "block").select("block", "node", "n", "fp"))


def connecting(near: Callable, node: np.ndarray, label: np.ndarray, left: int) -> list[tuple[int, int, bool]]:
    """Links that connect what all near pairs connect; with ``left``, only between its rows and the rest."""
    group = label.copy()
    out = []
    for i in range(left or len(node)):
        far = np.nonzero(group != group[i])[0]
        far = far[far >= left] if left else far[far > i]
        if not len(far):
            continue
        for j in far[near(i, far)].tolist():
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j]), False))
                group[group == group[j]] = group[i]
    return out


def nearest(near: Callable, node: np.ndarray, label: np.ndarray, left: int, distance: Callable, named: int) -> list[tuple[int, int, bool]]:
    """Of every row its nearest near rows of other labels, and whether it had more."""
    out = []
    for i in range(left or len(node)):
        far = np.nonzero(label != label[i])[0]
        far = far[far >= left] if left else far
        far = far[near(i, far)]
        cut = len(far) > named
        if cut:
            far = far[np.argsort(distance(i, far), kind="stable")[:named]]
        out += [(min(int(node[i]), j), max(int(node[i]), j), cut) for j in node[far].tolist()]
    return out


def bucket_links(keyed: DataFrame, named: int | None, similar: float, radius: int, bucket: int) -> DataFrame:
    """(a, b, cut): near pairs of different labels that share a block. ``named`` None: only links that connect."""
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("one"), F.max("label").alias("two"))
    open_ = keyed.join(sizes.filter("one <> two").select("block", "size"), "block")
    rows = open_.withColumn("parts", F.ceil(F.col("size") / bucket).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # every pair of parts of a large bucket meets once; a bucket of one part meets itself
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("block", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "node", "label", "n", "fp")
    ordered = met.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q", "part", "node")

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.stack(cols[:3])
        edges = np.concatenate(([0], np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1, [key.shape[1]]))
        out: set[tuple[int, int, bool]] = set()
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            node, label, n, fp = (c[s:e] for c in cols[4:])
            if e - s < 2 or (label == label[0]).all():
                continue
            left = 0 if key[1, s] == key[2, s] else int((cols[3][s:e] == key[1, s]).sum())
            distance = lambda i, j, fp=fp.view(np.uint64): np.bitwise_count(fp[j] ^ fp[i])
            near = lambda i, j, n=n, d=distance: (d(i, j) <= radius) & (np.minimum(n[j], n[i]) >= similar * np.maximum(n[j], n[i]) - 1e-9)
            out.update(connecting(near, node, label, left) if named is None else nearest(near, node, label, left, distance, named))
        if out:
            a, b, cut = zip(*sorted(out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            whole = int(np.nonzero((np.stack(cols[:3]) != np.stack([c[-1] for c in cols[:3]])[:, None]).any(axis=0))[0].max(initial=-1)) + 1
            held = [c[whole:] for c in cols]
            if whole:
                yield from solve([c[:whole] for c in cols])
        if held is not None:
            yield from solve(held)

    found = ordered.mapInArrow(run, "a long, b long, cut boolean")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cut").groupBy("a", "b").agg(F.max("cut").alias("cut"))


def with_digest(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """All columns and the digest of the row's id and text, few texts at a time."""
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                raw = pa.array(map(row_digest, part.column(key).to_pylist(), part.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=[*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(b"").cast("binary")).schema)


def verified(links: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similar: float) -> DataFrame:
    """The links whose shingle sets are similar. The smaller node's set is held while its partners' texts pass by,
    at most about TOGETHER of them in a place."""
    of = nodes.select("node", F.col("own.raw").alias("raw"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = of.join(ends, "node", "left_semi")
    held = with_digest(docs, "doc_id", "text", "raw").select("raw", "text").join(wanted, "raw").select("node", "text")
    places = links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("places"))
    centres = places.select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    centres = centres.join(held.withColumnRenamed("node", "a"), "a").select("a", "place", F.lit(None).cast("long").alias("b"), "text")
    partners = links.join(places, "a").select("a", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), "b")
    partners = partners.join(held.withColumnRenamed("node", "b"), "b").select("a", "place", "b", "text")
    ordered = centres.union(partners).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())

    def make() -> Callable:
        centre: list[np.ndarray] = []

        def apply(a: int, place: int, b: int | None, text: str) -> list[tuple]:
            shingles = shingle_set(word_hashes(words_of(text)), words)
            if b is None:
                centre[:] = [shingles]
                return []
            return [(a, b)] if jaccard(centre[0], shingles) >= similar - 1e-9 else []

        return apply

    return per_row(ordered, make, "a long, b long").distinct()


def similar_groups(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, radius: int = RADIUS, shared: float = SHARED, few: int = FEW, bucket: int = BUCKET, bits: int = BITS) -> DataFrame:
    """own (late, doc_id, raw: the row that stands for a text) and least, the ``own`` that stands for its component."""
    nodes = profiles(docs, words, similar, few)
    joined = [(rare_blocks(nodes, similar, shared), radius), (print_blocks(nodes, bits), bits)]
    labels = checked = links = None
    named: int | None = None
    while True:
        parts = []
        for blocks, within in joined:
            keyed = blocks.withColumn("label", F.col("node"))
            if labels is not None:
                keyed = blocks.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            parts.append(bucket_links(keyed, named, similar, within, bucket))
        found = parts[0].union(parts[1]).groupBy("a", "b").agg(F.max("cut").alias("cut"))
        if checked is not None:
            found = found.join(checked.select("a", "b", F.lit(True).alias("old")), ["a", "b"], "left")
        else:
            found = found.withColumn("old", F.lit(None).cast("boolean"))
        found = stored(found)
        new = found.filter("old IS NULL").select("a", "b")
        any_new, any_cut = found.agg(F.coalesce(F.max(F.col("old").isNull()), F.lit(False)), F.coalesce(F.max("cut"), F.lit(False))).first()
        if any_new:
            good = stored(verified(new, docs, nodes, words, similar))
            links = good if links is None else links.union(good)
            checked = new if checked is None else checked.union(new)
            labels = stored(components(links))
        if named is not None and not any_cut:
            break
        named = NAMED if named is None else named * 8
    if labels is None:
        return nodes.select("own", F.col("own").alias("least"))
    grouped = nodes.select("node", "own").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = grouped.groupBy("label").agg(F.min("own").alias("least"))
    return grouped.join(least, "label").select("own", "least")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row, with all columns, of every group of similar texts."""
    stays = similar_groups(texts(docs, id_col, text_col), **settings).select("least.raw").distinct()
    raw, nth = (free_name(docs, c) for c in ("__raw", "__nth"))
    kept = with_digest(docs, id_col, text_col, raw).join(stays.toDF(raw), raw, "left_semi")
    one = Window.partitionBy(raw).orderBy(F.col(f"`{text_col}`"))  # more than one row only where rows repeat
    return kept.withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])
