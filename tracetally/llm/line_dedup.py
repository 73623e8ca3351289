"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-case words. Words are ordered by rarity (counts of all words of the
lines in a fixed number of hash slots), so two sets of Jaccard similarity t share a word of their
first ``n - ceil(t * n) + 1`` ones. Sets meet under these words; length, positional and
bit-parity filters drop what cannot reach t; what is left is verified on the whole sets. A line is
removed if an earlier line (by document id, then line number) is equal to it or similar enough,
whether that one is kept or not.

A dense group of m similar lines must not give m * m pairs: each set first names only its
earliest few candidates per word. Sets that none of those verifies and that had more candidates name
eight times as many in a next round, and so on until no set is left that had more; these rounds carry
more parity bits, so that few pairs but similar ones pass. Words of hot slots are cut into parts that
meet pairwise, each pair of parts in a task of its own.

Every line that is not blank takes part. Sets too small to be similar to any other set (below four
words at 0.8) only meet equal ones, which needs the grouping by set and no words.

Defined results: null text counts as empty; blank lines are never removed, nor are lines with fewer
than ``shortest`` different words where a caller sets that bound; rows that repeat an id hold the same positions, so neither is later than the other;
null ids come after all others. An empty table gives an empty result; other columns are kept as
they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import fits, maybe_broadcast
from .common import SLICE_ROWS, free_name, fresh_worker, stored, texts

SIMILARITY = (4, 5)
SHORTEST = 1  # different words of a line that takes part: every line but blank ones
SLOTS = 1 << 17  # counters of word frequency
PART = 20_000  # occurrences of a slot from which its words are cut into parts
TOGETHER = 100_000  # rows of words that are compared at once
NAMED = 2  # candidates that a set names per word in the first pass
WANTED = 500_000  # documents (id and a few line numbers) that are broadcast; more are joined by shuffle
SET = ["sid", "bits", "n"]
WIDE = ["bits2", "bits3", "bits4"]  # one more sketch of 192 parity bits
WIDE_FROM = 72  # words from which a set carries that sketch in the first pass; 64 bits tell shorter ones apart
FACTOR = 8  # how many times more candidates a set names in the next round
SLICE_BYTES = 1 << 19  # of texts (one at least) whose words are handled at once
SLOT_RANGE = 1024  # counters in a row
BLOCK = 50_000  # rows of words that a block of keys has on average, if a set has a fifth of its words in the prefix
HELD = 200_000  # rows of words that a task holds before it writes them by blocks, WRITTEN rows at a time
WRITTEN = 25_000
LONG_WORD = 256  # bytes from which a word is hashed on its own
U = np.uint64
UP_TO = np.array([(1 << 8 * i) - 1 for i in range(9)], U)  # the first bytes of eight
ANY_RANK = np.zeros(1, U)
TYPES = {"key": "int", "sid": "long", "bits": "long", "n": "int", "place": "int", **{c: "long" for c in WIDE}, "line_no": "int"}
COLUMNS = [*TYPES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def scrambled(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U(shift))) * U(factor)
    return x ^ (x >> U(31))


def word_counts(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Lines that hold a word, summed up by the word's hash slot."""
    return slot_totals(counted_lines(docs, SHORTEST, slots), slots)


def slot_totals(counted: DataFrame, slots: int) -> np.ndarray:
    """The counts of all tasks by slot. A fixed number of slots reaches the driver."""
    out = np.zeros(slots, np.int64)
    each = counted.filter("slot IS NOT NULL").select("slot", F.posexplode("times").alias("nth", "times"))
    for r in each.groupBy((F.col("slot") + F.col("nth")).alias("slot")).agg(F.sum("times").alias("times")).toLocalIterator():
        out[r["slot"]] = r["times"]
    return out


def prefix_length(n: np.ndarray, t: tuple[int, int] = SIMILARITY) -> np.ndarray:
    return n + (-t[0] * n) // t[1] + 1  # n - ceil(t * n) + 1


def joined_texts(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 of the texts one after the other, A-Z lower-cased, and where each of them starts; the end of all is last."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (data[at[0] : at[-1]].to_pybytes().lower() if data is not None else b""), at - at[0]


def words_by_line(data: bytes, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and length of every word of joined texts; and of every line with words its text, its number there and how many words it has."""
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw - np.uint8(9) < 5)  # \x20 and \x09-\x0D
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    heads = at[:-1][at[:-1] < len(raw)]  # no word goes on in the next text
    first[heads] = ~gap[heads]
    last[heads[heads > 0] - 1] = ~gap[heads[heads > 0] - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    breaks = np.flatnonzero(raw == 10) + 1
    bounds = np.concatenate((breaks, at[:-1]))  # a break that ends a text comes before the next text
    order = np.argsort(bounds, kind="stable")
    head = order >= len(breaks)
    row, no = np.cumsum(head) - 1, np.arange(len(order))
    no -= no[head][row]
    held = np.diff(np.append(np.searchsorted(start, bounds[order]), len(start)))
    return start, size, row[held > 0], no[held > 0].astype(np.int32), held[held > 0]


def hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of joined texts, eight bytes of all words at a time; those of very long words one by one."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    h = scrambled(size.astype(U) * U(0x9E3779B97F4A7C15) ^ (eight[start] & UP_TO[np.minimum(size, 8)]))
    rest, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        h[rest] = scrambled(h[rest] ^ (eight[start[rest] + done] & UP_TO[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return h


def ranked(counts: np.ndarray) -> np.ndarray:
    """The place of every slot, the rarest first."""
    rank = np.empty(len(counts), U)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=U)
    return rank


def distinct_words(line: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each line (lines in order), ordered by their slot's rank, then by their other bits.

    One sort by 20 bits of the line and 44 of the hash; where these tell too little, whole numbers are sorted.
    """
    wide = max(len(rank) - 1, 0).bit_length()
    slot = rank[(h & U(len(rank) - 1)).astype(np.int64)]
    other = (h >> U(wide)) & U((1 << (44 - wide)) - 1)
    key = (line.astype(U) << U(44)) | (slot << U(44 - wide)) | other
    order = np.argsort(key)
    key, g = key[order], h[order]
    same = key[1:] == key[:-1]
    if line[-1] >> 20 or (same & (g[1:] != g[:-1])).any():
        g = h[np.lexsort((h, other, slot, line))]
        same = (g[1:] == g[:-1]) & (line[1:] == line[:-1])
    fresh = np.concatenate(([True], ~same))
    return line[fresh], g[fresh]


def slice_sets(line: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different word hashes of each line, rarest slot first, with the line each belongs to, and n, sid, bits per line."""
    line, h = distinct_words(line, h, rank)
    n = np.bincount(line)
    start = np.cumsum(n) - n
    sid = np.add.reduceat(mixed(h), start)
    bits = np.bitwise_xor.reduceat(U(1) << (h >> U(58)), start)
    return line, h, n, sid, bits


def wide_bits(line: np.ndarray, h: np.ndarray, has: np.ndarray) -> list[np.ndarray]:
    """The 192 parity bits of each set as three numbers, zero for sets that carry none."""
    inside = has[line]
    line, h = line[inside], h[inside]
    spot = ((h >> U(40)) % U(64 * len(WIDE))).astype(np.int64)
    out = np.zeros((len(has), len(WIDE)), U)
    if len(line):
        one = U(1) << (spot & 63).astype(U)
        start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        out[line[start]] = np.stack([np.bitwise_xor.reduceat(np.where(spot >> 6 == k, one, U(0)), start) for k in range(len(WIDE))], axis=1)
    return [np.ascontiguousarray(x) for x in out.T]


def sliced_sets(batches: Iterator[pa.RecordBatch], shortest: int, rank: np.ndarray = ANY_RANK):
    """Few texts at a time: the rows, and per line their place in them and numbers of the lines with enough different words, and what ``slice_sets`` says of them."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        s = 0
        while s < batch.num_rows:
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + SLICE_BYTES, side="right")))
            piece, s = batch.slice(s, e - s), e
            data, at = joined_texts(piece.column("text"))
            start, size, row, no, held = words_by_line(data, at)
            if not len(held):
                continue
            line, h, n, sid, bits = slice_sets(np.repeat(np.arange(len(held)), held), hashes(data, start, size), rank)
            if (n < shortest).any():
                keep = n >= shortest
                inside = keep[line]
                line, h = (np.cumsum(keep) - 1)[line[inside]], h[inside]
                row, no, n, sid, bits = (x[keep] for x in (row, no, n, sid, bits))
            if len(n):
                yield piece, row, no, (line, h, n, sid, bits)


def counted_lines(docs: DataFrame, shortest: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, row, line_no, sid, bits, n of every line with enough different words; row tells rows of one id apart.

    Each task adds rows of its own for the words it saw: slot and the times of the slots from it on, the rest null. The texts are taken apart once for both.
    """
    names = ["doc_id", "row", "line_no", *SET, "slot", "times"]
    times = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        total, types = np.zeros(slots, np.int64), []
        for piece, row, no, (_, h, n, sid, bits) in sliced_sets(batches, shortest):
            total += np.bincount((h & U(slots - 1)).astype(np.int64), minlength=slots)
            cols = [piece.column(c).take(pa.array(row)) for c in ("doc_id", "row")] + [*map(pa.array, [no, sid.view(np.int64), bits.view(np.int64), n.astype(np.int32)])]
            types = [c.type for c in cols]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(no), pa.int32()), pa.nulls(len(no), times)], names=names)
        if types:
            edges = np.append(np.arange(0, slots, SLOT_RANGE), slots).astype(np.int32)
            ranges = pa.ListArray.from_arrays(pa.array(edges), pa.array(total))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(ranges), x) for x in types], pa.array(edges[:-1]), ranges], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("row", row_hash("text")).mapInArrow(run, f"doc_id {kind}, row long, line_no int, sid long, bits long, n int, slot int, times array<long>")


def prefix_columns(batches: Iterator[pa.RecordBatch], counts: np.ndarray, shortest: int, t: tuple[int, int], part: int, wide_from: int) -> Iterator[tuple[dict[str, np.ndarray], pa.Array]]:
    """key, SET, place, WIDE and line_no as arrays, and doc_id, of some texts at a time: one row for every prefix word.

    The key is 32 bits of the word's hash: words that share one only make their sets meet once more. A set is written once per task, and again for a smaller id than before.
    """
    seen: dict[tuple[int, int], object] = {}
    for piece, row, no, (line, h, n, sid, bits) in sliced_sets(batches, shortest, ranked(counts)):
        ids = piece.column("doc_id")
        start = np.cumsum(n) - n
        more = wide_bits(line, h, n >= wide_from)
        place = np.arange(len(h)) - start[line]
        fresh, names = np.zeros(len(n), bool), ids.to_pylist()
        meets = (t[1] * n >= t[0] * (n + 1)).tolist()  # sets of n and n + 1 words can reach t
        for i, key in enumerate(zip(sid.tolist(), bits.tolist())):
            if not meets[i]:
                continue
            new = names[row[i]]
            if key not in seen or (new is not None and (seen[key] is None or new < seen[key])):
                if len(seen) > 100_000:
                    seen.clear()
                seen[key], fresh[i] = new, True
        inside = np.flatnonzero(fresh[line] & (place < prefix_length(n, t)[line]))
        line, words, spots = line[inside], h[inside], place[inside]
        cuts = counts[(words & U(len(counts) - 1)).astype(np.int64)] // part + 1
        own = (sid[line] % cuts.astype(U)).astype(np.int64)
        # a word cut into P parts has one key for each pair of its own part with any part
        times = np.repeat(np.arange(len(words)), cuts)
        other = np.arange(len(times)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        line, words, spots, cuts, own = line[times], words[times], spots[times], cuts[times], own[times]
        pair = (np.minimum(own, other) * cuts + np.maximum(own, other) + 1).astype(U)
        key = np.where(cuts > 1, mixed(words + pair), words).astype(np.uint32)
        cols = {"key": key.view(np.int32), "sid": sid[line].view(np.int64), "bits": bits[line].view(np.int64), "n": n[line].astype(np.int32), "place": spots.astype(np.int32)}
        cols |= {c: m[line].view(np.int64) for c, m in zip(WIDE, more)}
        yield cols | {"line_no": no[line]}, ids.take(pa.array(row[line]))


def prefix_words(docs: DataFrame, counts: np.ndarray, shortest: int, t: tuple[int, int] = SIMILARITY, part: int = PART, wide_from: int = WIDE_FROM) -> DataFrame:
    """key, SET, place, WIDE (of sets of at least wide_from words), line_no, doc_id for every prefix word of a set that can be similar to another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, ids in prefix_columns(batches, counts, shortest, t, part, wide_from):
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols.values()), ids], names=[*cols, "doc_id"])

    types = ", ".join(f"{c} {TYPES[c]}" for c in COLUMNS)
    return docs.mapInArrow(run, f"{types}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def prefix_blocks(docs: DataFrame, counts: np.ndarray, shortest: int, t: tuple[int, int] = SIMILARITY, part: int = PART, wide_from: int = WIDE_FROM) -> DataFrame:
    """The rows of ``prefix_words`` as arrays: a row of this table has those of one block of keys from some of a task's texts.

    So few rows are moved, each with many words. WIDE is only held of sets that carry it. blocks: their number.
    """
    blocks = math.ceil(int(counts.sum()) / 5 / BLOCK) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held, waiting = [], 0

        def written():
            cols = {x: np.concatenate([c[x] for c, _ in held]) for x in COLUMNS}
            ids = pa.concat_arrays([x for _, x in held])
            block = block_of(cols["key"], blocks)
            order = np.argsort(block)
            block = block[order]
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            broad = order[cols["n"][order] >= wide_from]
            edges, of_broad = np.append(start, len(order)), np.searchsorted(block[cols["n"][order] >= wide_from], np.append(block[start], blocks))
            lists = [pa.ListArray.from_arrays(pa.array((of_broad if x in WIDE else edges).astype(np.int32)), pa.array(cols[x][broad if x in WIDE else order])) for x in COLUMNS]
            lists.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), ids.take(pa.array(order))))
            whole = pa.RecordBatch.from_arrays([pa.array(block[start]), *lists], names=["block", *COLUMNS, "doc_id"])
            step = max(1, len(start) * WRITTEN // len(order))
            yield from (whole.slice(i, step) for i in range(0, len(start), step))

        for cols, ids in prefix_columns(batches, counts, shortest, t, part, wide_from):
            if not len(ids):
                continue
            held.append((cols, ids))
            waiting += len(ids)
            if waiting >= HELD:
                yield from written()
                held, waiting = [], 0
        if held:
            yield from written()

    types = ", ".join(f"{c} array<{TYPES[c]}>" for c in COLUMNS)
    table = docs.mapInArrow(run, f"block int, {types}, doc_id array<{docs.schema['doc_id'].dataType.simpleString()}>")
    parts = math.ceil(blocks / 4)
    by_default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (table.repartition("block") if parts <= by_default else table.repartition(parts, "block")).sortWithinPartitions("block")


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((key.view(np.uint32).astype(U) * U(blocks)) >> U(32)).astype(np.int32)


def group_candidates(group: np.ndarray, n: np.ndarray, place: np.ndarray, parity: list[np.ndarray], active: np.ndarray, named: int, t: tuple[int, int] = SIMILARITY, wide_from: int = WIDE_FROM):
    """Index pairs (later, earlier) of rows in one group, rows of a group standing together by age; and which rows had more.

    ``parity``: 64 bits, and the numbers of the wide sketch, which counts where both sets carry it. Rows are compared with the oldest of their group, then the next, until they have ``named`` candidates.
    """
    start = np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1)) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((start, [len(group)])))
    base, rank = np.repeat(start, size), np.arange(len(group)) - np.repeat(start, size)
    rows, got, more = np.nonzero(active & (rank > 0))[0], np.zeros(len(group), np.int32), np.zeros(len(group), bool)
    left, right, d = [], [], 0
    while len(rows):
        other = base[rows] + d
        a, b = n[rows], n[other]
        need = -((-t[0] * (a + b)) // (t[0] + t[1]))  # overlap needed: t / (1 + t) of both sizes, rounded up
        ok = (t[1] * np.minimum(a, b) >= t[0] * np.maximum(a, b)) & (1 + np.minimum(a - place[rows], b - place[other]) - 1 >= need)
        apart = a + b - 2 * need  # words that only one of the two may hold: no more parity bits can differ
        ok &= np.bitwise_count(parity[0][rows] ^ parity[0][other]) <= apart
        if len(parity) > 1:
            both = np.nonzero(ok & (np.minimum(a, b) >= wide_from))[0]
            i, j = rows[both], other[both]
            ok[both] = sum(np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64) for bits in parity[1:]) <= apart[both]
        hit, to = rows[ok], other[ok]
        full = got[hit] >= named
        more[hit[full]] = True
        hit, to = hit[~full], to[~full]
        got[hit] += 1
        left.append(hit)
        right.append(to)
        d += 1
        rows = rows[(rank[rows] > d) & ~more[rows]]
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), more


PLACE = ["doc_id", "line_no"]


def side(s: str) -> list[str]:
    return [f"{s}_{c}" for c in [*SET, *PLACE]]


def by_blocks(batches: Iterator[pa.RecordBatch], cols: list[str], wide_from: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block of keys after the other, ordered by key. A block's pieces stand together."""
    held: list[pa.RecordBatch] = []

    def rows():
        out = {}
        for x in [*cols, "doc_id"]:
            out[x] = pa.concat_arrays([b.column(x).flatten() for b in held])
        order = np.argsort(out["key"].to_numpy().view(np.uint32))
        broad = out["n"].to_numpy() >= wide_from
        for x in WIDE:
            full = np.zeros(len(order), np.int64)
            full[broad] = out[x].to_numpy()
            out[x] = pa.array(full)
        at = pa.array(order)
        return pa.RecordBatch.from_arrays([x.take(at) for x in out.values()], names=[*out])

    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])).tolist() if len(block) else [0]
        for s, e in zip(edges[:-1], edges[1:]):
            if held and held[-1].column("block")[0].as_py() != block[s]:
                yield rows()
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield rows()


def by_age(group: np.ndarray, ids: pa.Array, no: np.ndarray, sid: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Order of rows by group, then id (null ids last), line, set. One sort of a number that holds group and age."""
    sorted_ids = pc.sort_indices(ids, null_placement="at_end")
    at, held = sorted_ids.to_numpy(), ids.take(sorted_ids)
    differs = pc.fill_null(pc.not_equal(held[1:], held[:-1]), True).to_numpy(zero_copy_only=False)
    differs &= ~(pc.is_null(held[1:]).to_numpy(zero_copy_only=False) & pc.is_null(held[:-1]).to_numpy(zero_copy_only=False))
    nth = np.empty(len(at), np.int64)
    nth[at] = np.concatenate(([0], np.cumsum(differs)))
    place = (nth << 32) | no.astype(np.int64)
    order = np.argsort(place)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(place[order][1:] != place[order][:-1])))
    both = group * (len(at) + 1) + rank
    order = np.argsort(both)
    tie = both[order][1:] == both[order][:-1]
    if (tie & ((sid[order][1:] != sid[order][:-1]) | (bits[order][1:] != bits[order][:-1]))).any():
        return np.lexsort((bits, sid, both))
    return order


def first_of_sets(group: np.ndarray, sid: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first row of every set in its group, in order."""
    key = scrambled(sid.view(U) ^ scrambled(bits.view(U) + group.astype(U)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if (same & np.any([x[order][1:] != x[order][:-1] for x in (group, sid, bits)], axis=0)).any():
        order = np.lexsort((bits, sid, group))
        same = np.all([x[order][1:] == x[order][:-1] for x in (group, sid, bits)], axis=0)
    return np.sort(np.minimum.reduceat(order, np.concatenate(([0], np.flatnonzero(~same) + 1))))


def candidates(postings: DataFrame, named: int, t: tuple[int, int] = SIMILARITY, wide_from: int = WIDE_FROM, members: bool = False) -> DataFrame:
    """Pairs of sets (l_ later, r_ earlier, each with SET and the place of its first line) that pass the filters.

    Where a set had more candidates, r_n is null and key tells under which word. All lines of a set
    stand under the same words, so the first of them in a group is the first of all.
    postings: key, SET, place, WIDE, doc_id, line_no and active; or the blocks of ``prefix_blocks``.
    ``members``: also every set of the groups in which a set had more, with its place among the set's words in
    ``spot``, which is null in all other rows.
    """
    in_blocks = "block" in postings.columns
    ordered = postings if in_blocks else postings.repartition("key").sortWithinPartitions("key")
    wide = [c for c in WIDE if c in postings.columns]
    cols = ["key", *SET, "place", *(["active"] if "active" in postings.columns else []), "line_no", *wide]
    names = ["key", *side("l"), *side("r"), "spot"]
    kind = postings.schema["doc_id"].dataType
    kind = (kind.elementType if in_blocks else kind).simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held, waiting = [], 0

        def solve(c, ids):
            same = c[0][1:] == c[0][:-1]
            shared = np.flatnonzero(np.append(same, False) | np.append(False, same))  # a word of one set names nobody
            if not len(shared):
                return
            c, ids = {x: v[shared] for x, v in zip(cols, c)}, ids.take(pa.array(shared))
            key = c["key"]
            group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            aged = by_age(group, ids, c["line_no"], c["sid"], c["bits"])
            first = aged[first_of_sets(group[aged], c["sid"][aged], c["bits"][aged])]
            c, group = {x: v[first] for x, v in c.items()}, group[first]
            active = c["active"].astype(bool) if "active" in c else np.ones(len(first), bool)
            parity = [c[x].view(U) for x in ("bits", *wide)]
            i, j, more = group_candidates(group, c["n"].astype(np.int64), c["place"].astype(np.int64), parity, active, named, t, wide_from)
            m = np.flatnonzero(more)
            of = np.flatnonzero(np.bincount(group[m], minlength=group[-1] + 1)[group]) if members else m[:0]
            left, right = np.concatenate([i, m, of]), np.concatenate([j, m, of])
            pair, spot = np.arange(len(left)) < len(i), np.arange(len(left)) >= len(i) + len(m)
            if len(left):
                sets = [[pa.array(c[x][k]) for x in SET] + [ids.take(pa.array(first[k])), pa.array(c["line_no"][k])] for k in (left, right)]
                sets[1][2] = pa.array(c["n"][right], mask=~pair)
                yield pa.RecordBatch.from_arrays([pa.array(c["key"][left], mask=pair), *sets[0], *sets[1], pa.array(c["place"][left], mask=~spot)], names=names)

        def gathered():
            return [np.concatenate(x) for x in zip(*[c for c, _ in held])], pa.concat_arrays([x for _, x in held])

        for batch in by_blocks(batches, cols, wide_from) if in_blocks else batches:
            held.append(([batch.column(x).to_numpy(zero_copy_only=False) for x in cols], batch.column("doc_id")))
            waiting += batch.num_rows
            if waiting < TOGETHER:
                continue
            c, ids = gathered()
            whole = int(np.flatnonzero(c[0] != c[0][-1]).max(initial=-1)) + 1  # the last group may go on
            held, waiting = [([x[whole:] for x in c], ids[whole:])], len(ids) - whole
            if whole:
                yield from solve([x[:whole] for x in c], ids[:whole])
        if waiting:
            yield from solve(*gathered())

    types = {"n": "int", "line_no": "int", "doc_id": kind}
    return ordered.select(*(["block"] if in_blocks else []), *cols, "doc_id").mapInArrow(run, "key int, " + ", ".join(f"{x} {types.get(x[2:], 'long')}" for x in names[1:-1]) + ", spot int")


def wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text and at_lines of the documents that hold the wanted lines (at_doc, at_line)."""
    ids = wanted.groupBy("at_doc").agg(F.collect_set("at_line").alias("at_lines"))
    return docs.join(maybe_broadcast(ids, fits(ids, WANTED)), F.col("doc_id").eqNullSafe(F.col("at_doc"))).select("text", "at_lines")


def picked_sets(batches: Iterator[pa.RecordBatch], shortest: int):
    """What ``slice_sets`` says of the picked lines, some of them at a time."""
    for batch in batches:
        for s in range(0, batch.num_rows, SLICE_ROWS):
            lines = []
            for text, picked in zip(*[batch.column(x).slice(s, SLICE_ROWS).to_pylist() for x in ("text", "at_lines")]):
                every = text.split("\n")
                lines += [every[i] for i in picked if i < len(every)]
            for _, _, _, sets in sliced_sets([pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["text"])], shortest):
                yield sets


def word_arrays(docs: DataFrame, wanted: DataFrame, shortest: int) -> DataFrame:
    """SET and word hashes of the wanted sets, read from the documents that hold their first lines (at_doc, at_line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for _, h, n, sid, bits in picked_sets(batches, shortest):
            words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), pa.array(bits.view(np.int64)), pa.array(n.astype(np.int32)), words], names=[*SET, "words"])

    return wanted_lines(docs, wanted).mapInArrow(run, "sid long, bits long, n int, words array<long>")


def sketches(docs: DataFrame, wanted: DataFrame, shortest: int) -> DataFrame:
    """SET and WIDE of the wanted sets, read from the documents that hold their first lines (at_doc, at_line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for line, h, n, sid, bits in picked_sets(batches, shortest):
            more = wide_bits(line, h, n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), pa.array(bits.view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in more]], names=[*SET, *WIDE])

    return wanted_lines(docs, wanted).mapInArrow(run, "sid long, bits long, n int, " + ", ".join(f"{c} long" for c in WIDE)).dropDuplicates(SET)


def similar_pairs(pairs: DataFrame, words: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The left sets of those pairs whose Jaccard similarity is at least t."""
    for s in "lr":
        pairs = pairs.join(words.select(*[F.col(c).alias(f"{s}_{c}") for c in SET], F.col("words").alias(f"{s}_words")), [f"{s}_{c}" for c in SET])
    shared = F.size(F.array_intersect("l_words", "r_words"))
    same = t[1] * shared >= t[0] * (F.col("l_n") + F.col("r_n") - shared)
    return pairs.filter(same).select(*[F.col(f"l_{c}").alias(c) for c in SET]).distinct()


def verified(named: DataFrame, docs: DataFrame, shortest: int, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The left sets that are similar enough to a right set of theirs.

    Whole sets are moved for one pair of each left set first, the one with most words in common so
    far; the other pairs only follow for left sets that this one did not settle.
    """

    def settle(pairs: DataFrame) -> DataFrame:
        ends = F.array(*[F.struct(F.col(f"{s}_doc_id").alias("at_doc"), F.col(f"{s}_line_no").alias("at_line")) for s in "lr"])
        words = stored(word_arrays(docs, pairs.select(F.explode(ends).alias("e")).select("e.*"), shortest))
        return similar_pairs(pairs.select(*[f"{s}_{c}" for s in "lr" for c in SET]), words, t)

    left = [f"l_{c}" for c in SET]
    pairs = stored(named.groupBy(*side("l"), *side("r")).agg(F.count(F.lit(1)).alias("votes")))
    best = pairs.groupBy(*side("l")).agg(F.max(F.struct("votes", *side("r"))).alias("r")).select(*side("l"), *[F.col(f"r.{c}") for c in side("r")])
    settled = stored(settle(best))
    rest = stored(pairs.drop("votes").join(settled.select(*[F.col(c).alias(f"l_{c}") for c in SET]), left, "left_anti"))
    return settled.union(settle(rest)).distinct()


def removed_lines(docs: DataFrame, shortest: int = SHORTEST, **settings) -> DataFrame:
    """doc_id and line_no (from 0) of all lines that an earlier line makes superfluous."""
    return _removed(docs, shortest, **settings).select("doc_id", "line_no").distinct()


def row_hash(text: Column | str) -> Column:
    return F.xxhash64(text)


def _removed(docs: DataFrame, shortest: int, t: tuple[int, int] = SIMILARITY, part: int = PART, named: int = NAMED, slots: int = SLOTS) -> DataFrame:
    """doc_id, row (a hash of the whole text, which tells rows of one id apart) and line_no of the removed lines."""
    counted = stored(counted_lines(docs, shortest, slots))
    counts, lines = slot_totals(counted, slots), counted.filter("slot IS NULL").drop("slot", "times")
    age = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no")
    postings = prefix_blocks(docs, counts, shortest, t, part)
    named_pairs = stored(candidates(postings, named, t, members=True))
    similar = stored(verified(named_pairs.filter("r_n IS NOT NULL"), docs, shortest, t))
    members, under = named_pairs.filter("spot IS NOT NULL"), None
    while True:
        more = named_pairs.filter("r_n IS NULL AND spot IS NULL").select(*[F.col(f"l_{c}").alias(c) for c in SET], "key")
        more = stored(more.distinct().join(similar, SET, "left_anti").withColumn("open", F.lit(True)))
        if more.isEmpty():
            break
        if under is None:
            keys = more.select("key").distinct()
            under = members.select("key", *[F.col(f"l_{c}").alias(c) for c in [*SET, *PLACE]], F.col("spot").alias("place"))
            under = stored(under.join(maybe_broadcast(keys, fits(keys, WANTED)), "key", "left_semi"))
            wanted = under.select(F.col("doc_id").alias("at_doc"), F.col("line_no").alias("at_line"))
            under = stored(under.join(sketches(docs, wanted, shortest), SET))
        named *= FACTOR
        marked = under.join(more, ["key", *SET], "left").withColumn("active", F.coalesce("open", F.lit(False)))
        named_pairs = stored(candidates(marked, named, t, wide_from=0))
        similar = stored(similar.union(verified(named_pairs.filter("r_n IS NOT NULL"), docs, shortest, t)).distinct())
    sets = lines.groupBy(*SET).agg(F.count(F.lit(1)).alias("lines")).join(similar.withColumn("all", F.lit(True)), SET, "left")
    held = stored(lines.join(sets.withColumn("all", F.coalesce("all", F.lit(False))).filter("all OR lines > 1").select(*SET, "all"), SET))
    equal = held.filter("NOT all")
    firsts = equal.groupBy(*SET).agg(F.min(age).alias("first"))
    later = held.filter("all").drop("all").union(equal.drop("all").join(firsts, SET).filter(age > F.col("first")).drop("first"))
    return later.select("doc_id", "row", "line_no").distinct()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, **settings) -> DataFrame:
    """doc_id, n_lines and the removed line numbers (sorted) of every row."""
    rows = texts(docs, id_col, text_col)
    gone = _removed(rows, shortest, **settings).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line_no")).alias("removed")).toDF("d", "r", "removed")
    slim = rows.select("doc_id", row_hash("text").alias("row"), F.size(F.split("text", "\n")).alias("n_lines"))
    joined = slim.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, **settings) -> DataFrame:
    """All rows and columns, the text without removed lines; a text that loses none is not changed."""
    doc, row, removed = (free_name(docs, c) for c in ("__doc", "__row", "__removed"))
    gone = _removed(texts(docs, id_col, text_col), shortest, **settings)
    gone = stored(gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("removed")).toDF(doc, row, removed))
    own = row_hash(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    joined = docs.join(maybe_broadcast(gone, fits(gone, WANTED)), F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (own == F.col(row)), "left")
    text = without_lines(F.col(f"`{text_col}`"), F.coalesce(F.col(removed), F.array().cast("array<int>")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
