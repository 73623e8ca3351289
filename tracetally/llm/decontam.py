"""Benchmark decontamination: seeds of two words find passages, local alignment scores them.

Words of training texts and of test items are compared without case and ASCII punctuation. A seed is
two words of an item that are neighbours or have one word between them. Every alignment that scores
enough has a known number of seeds within a known stretch, so a text is aligned with an item only
where it has as many, and no copy is missed. A bit table of fixed size tells most words that no
seed starts there. The benchmark goes to the tasks in chunks of bounded size. The score of a passage
is its best Smith-Waterman local alignment with the item, over that of the item with itself, so edited and
paraphrased copies score by what is left in order.

Defined results: null text counts as empty; items without words match nothing; items with equal text
are reported each; a document is reported once per item with its best passage (the first of equal
ones), rows that repeat an id together; null ids stay null. Empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, free_name, stored

GRAM = 2  # words of a seed, and how far it goes on at most
LEAST = 0.5
BITS = 1 << 22  # slots of the table of seeds: 4 MB
CHUNK = 100_000  # words of the benchmark that go to the tasks at once
MATCH, MISS, GAP = 2, -1, -1
U = np.uint64
# bytes of a text: ASCII letters and digits and all others stay, ASCII marks separate words
WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").translate(WORDS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, U)
    g = np.zeros(n, U)
    for i in range(gram):
        g = (g ^ h[i : i + n]) * U(0x9E3779B97F4A7C15)
        g ^= g >> U(32)
    return g


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the passage word it ends with."""
    column = np.arange(len(passage)) * -GAP
    before, best, end = np.zeros(len(passage), np.int64), 0, -1
    for w in item:
        diagonal = np.concatenate(([0], before[:-1])) + np.where(passage == w, MATCH, MISS)
        now = np.maximum(np.maximum(diagonal, before + GAP), 0)
        now = np.maximum.accumulate(now + column) - column  # gaps in the item
        top = int(now.argmax())
        if now[top] > best:
            best, end = int(now[top]), top
        before = now
    return best, end


def item_words(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [signed(word_hashes(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(words, pa.list_(pa.int64())), pa.array([len(w) for w in words], pa.int32())], names=["item_id", "words", "n"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words array<long>, n int")


def pair_hashes(h: np.ndarray, apart: int) -> np.ndarray:
    """One hash for every two words that stand so far apart; a single word where ``apart`` is 0."""
    if not apart:
        return mixed(h)
    return gram_hashes(np.stack([h[:-apart], h[apart:]], axis=1).ravel(), 2)[::2] if len(h) > apart else np.zeros(0, U)


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)


class Items:
    """A chunk of the benchmark: seeds with the items that have them, and what an item needs of them.

    An alignment that scores ``least`` matches k words at a cost e with 2 k - e >= 2 n least. At most
    e / 2 of its k - 1 steps from match to match cost more than one, so n least - 1 steps go at most two words on
    in the item and in the text: these are seeds. Items too short to be sure of a step have their words
    as seeds. The alignment covers at most k + e <= n (3 - 2 least) words.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]], least: float, bits: int):
        self.words = [w for _, w in rows]
        n = np.array([len(w) for w in self.words], np.int64)
        steps = np.ceil(n * least - 1 - 1e-9).astype(np.int64)
        self.need, self.span = np.maximum(steps, 1), np.floor(n * (3 - 2 * least) + 1e-9).astype(np.int64) + 1
        self.apart = (0, *range(1, GRAM + 1)) if (steps < 1).any() else tuple(range(1, GRAM + 1))
        g, item = [], []
        for i, w in enumerate(self.words):
            own = np.unique(np.concatenate([pair_hashes(w, d) for d in (range(1, GRAM + 1) if steps[i] >= 1 else (0,))]))
            g.append(own)
            item.append(np.full(len(own), i))
        g, item = np.concatenate(g), np.concatenate(item)
        order = np.argsort(g, kind="stable")
        self.seeds, first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.first, self.item = first.astype(np.int64), item[order]
        self.shift = U(64 - (bits.bit_length() - 1))
        self.bits = bits
        self.table: np.ndarray | None = None

    def mark(self) -> None:
        """The bit table is made where it is used."""
        self.table = np.zeros(self.bits, bool)
        self.table[(self.seeds >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and seed numbers of all seeds in a text."""
        place, seed = [], []
        for d in self.apart:
            g = pair_hashes(h, d)
            at = np.nonzero(self.table[(g >> self.shift).astype(np.int64)])[0]
            k = np.searchsorted(self.seeds, g[at]).clip(max=len(self.seeds) - 1)
            same = self.seeds[k] == g[at]
            place.append(at[same])
            seed.append(k[same])
        return np.concatenate(place), np.concatenate(seed)

    def passages(self, place: np.ndarray, seed: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Item, first and last word of every stretch with enough seeds of the item close together, and these seeds."""
        times = self.count[seed]
        k = np.repeat(np.arange(len(seed)), times)
        item = self.item[np.repeat(self.first[seed], times) + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)]
        key = item * (length + 1) + place[k]
        order = np.argsort(key, kind="stable")
        every, which = key[order], seed[k][order]
        key = every[np.concatenate(([True], every[1:] != every[:-1]))] if len(every) else every  # a place counts once
        item, at = key // (length + 1), key % (length + 1)
        last = np.arange(len(key)) + self.need[item] - 1
        ok = last < len(key)
        ok[ok] = (item[last[ok]] == item[ok]) & (at[last[ok]] - at[ok] < self.span[item[ok]])
        item, at = item[ok], at[ok]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * self.span[item[1:]])
        for s, e in zip(np.nonzero(new)[0], [*np.nonzero(new)[0][1:], len(item)]):
            i = int(item[s])
            a, b = max(0, int(at[s]) - int(self.span[i])), min(length, int(at[e - 1]) + int(self.span[i]) + 1)
            x, y = np.searchsorted(every, [i * (length + 1) + a, i * (length + 1) + b])
            yield i, a, b, np.unique(which[x:y])


def scan(docs: DataFrame, items: Items, least: float) -> DataFrame:
    """doc_id, item (number in the chunk), score, word_end and seeds of every passage that scores enough.

    Rows without an item say in how many texts of the task a seed is.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item", "score", "word_end", "seeds", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items.mark()
        texts_of, kind_of = np.zeros(len(items.seeds), np.int64), pa.null()

        def rows(out):
            types = [kind_of, pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            kind_of = batch.schema.field("doc_id").type
            for s in range(0, batch.num_rows, SLICE_ROWS):
                piece, out = batch.slice(s, SLICE_ROWS), []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    h = word_hashes(text)
                    place, seed = items.hits(h)
                    if not len(seed):
                        continue
                    texts_of[np.unique(seed)] += 1
                    for i, a, b, own in items.passages(place, seed, len(h)):
                        best, end = alignment(items.words[i], h[a:b])
                        score = best / (MATCH * len(items.words[i]))
                        if score >= least:
                            out.append((doc_id, i, score, a + end, own.tolist(), None))
                if out:
                    yield rows(out)
        used = np.nonzero(texts_of)[0]
        for s in range(0, len(used), 10_000):
            yield rows([(None, None, None, None, [k], n) for k, n in zip(used[s : s + 10_000].tolist(), texts_of[used[s : s + 10_000]].tolist())])

    return docs.mapInArrow(run, f"doc_id {kind}, item int, score double, word_end long, seeds array<long>, texts long")


def chunks(items: DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The benchmark in pieces of a bounded number of words (or one item)."""
    held, size = [], 0
    for r in items.toLocalIterator():
        words = np.array(r["words"], np.int64).view(U)
        if held and size + len(words) > CHUNK:
            yield held
            held, size = [], 0
        held.append((r["item_id"], words))
        size += len(words)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, seeds (different ones shared), rarest (texts that have the rarest of them), word_end of every document that holds an item.

    Rows that share an id (or have none) are told apart by their texts.
    """
    found = _leaks(_rows(docs, id_col, text_col), benchmark, least, bits)
    return found.withColumn("doc_id", F.col("doc_id.id"))


def _row(id_col: str, text_col: str) -> Column:
    """What tells rows apart: the id and a hash of the whole text."""
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_row(id_col, text_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def _leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, bits: int = BITS) -> DataFrame:
    spark = docs.sparkSession
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kind}, score double, seeds int, rarest long, word_end long")
    for rows in chunks(stored(item_words(benchmark).filter("n > 0"))):
        found = stored(scan(docs, Items(rows, least, bits), least))
        counts = found.filter("item IS NULL").groupBy(F.col("seeds")[0].alias("seed")).agg(F.sum("texts").alias("texts"))
        best = found.filter("item IS NOT NULL").groupBy("doc_id", "item").agg(F.max(F.struct("score", (-F.col("word_end")).alias("back"), "seeds")).alias("b"))
        rare = best.select("doc_id", "item", F.explode("b.seeds").alias("seed")).join(counts, "seed").groupBy("doc_id", "item").agg(F.min("texts").alias("rarest"))
        rare = rare.select(F.col("doc_id").alias("d"), F.col("item").alias("i"), "rarest")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item int, {kind.rsplit(', ', 1)[1]}")
        whole = best.join(rare, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item") == F.col("i"))).join(names, "item")
        out = out.union(whole.select("doc_id", "item_id", "b.score", F.size("b.seeds").alias("seeds"), "rarest", (-F.col("b.back")).alias("word_end")))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows, with all columns, of documents that hold no item."""
    name = free_name(docs, "__leaked")
    leaked = stored(_leaks(_rows(docs, id_col, text_col), benchmark, **settings).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(leaked, _row(id_col, text_col).eqNullSafe(F.col(name)), "left_anti")
