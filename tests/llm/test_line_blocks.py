"""Line dedup takes texts apart in arrays and moves prefix words by blocks of keys."""

import random

import numpy as np
import pyarrow as pa

from tracetally.llm import line_dedup as L

TEXTS = ["A b\x0bc  B\n\n \t\r\nlast Line\n", "", "\n", "no break", "一 二 三 一\x1fa", "x" * 700 + " y\n" + "x" * 700 + " " + "x" * 699, None, " end ", "abcdefgh abcdefghi abcdefgh\x00 abcdefg"]


def plain(texts):
    return [(d, i, set(x.split())) for d, t in enumerate(texts) for i, x in enumerate((t or "").encode().lower().split(b"\n")) if x.split()]


def test_words_of_joined_texts():
    data, at = L.joined_texts(pa.array(["skipped", *TEXTS])[1:])
    start, size, row, no, held = L.words_by_line(data, at)
    words, ends = [data[a : a + n] for a, n in zip(start, size)], np.cumsum(held)
    assert [(d, i, set(words[e - n : e])) for d, i, n, e in zip(row, no, held, ends)] == plain(TEXTS)
    h = L.hashes(data, start, size).tolist()
    assert len(set(zip(words, h))) == len(set(h)) == len(set(words))


def test_sets_of_lines_are_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    for rank in (L.ANY_RANK, L.ranked(np.arange(16)[::-1])):
        got = [(d, i, k) for _, row, no, (_, _, n, _, _) in L.sliced_sets([batch], 1, rank) for d, i, k in zip(row, no, n)]
        assert got == [(d, i, len(x)) for d, i, x in plain(TEXTS)]
    long = [(d, i) for _, row, no, _ in L.sliced_sets([batch], 3) for d, i in zip(row, no)]
    assert long == [(d, i) for d, i, x in plain(TEXTS) if len(x) >= 3]


def test_hashes_that_agree_in_the_sorted_bits_stay_apart():
    h = np.array([5, 5 + (1 << 60), 5, 9, 5 + (1 << 60)], np.uint64)
    line, got = L.distinct_words(np.zeros(5, np.int64), h, L.ANY_RANK)
    assert sorted(got.tolist()) == [5, 9, 5 + (1 << 60)] and line.tolist() == [0, 0, 0]


def test_blocks_hold_the_rows_of_prefix_words(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(" ".join(rnd.choices([f"w{k}" for k in range(400)], k=rnd.randrange(4, 120))) for _ in range(5))) for i in range(200)]
    rows += [(i + 200, t.replace("\n", " more\n")) for i, t in rows[:40]]  # similar lines
    docs = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id long, text string").repartition(3)
    counts = L.word_counts(docs)
    want = {tuple(r) for r in L.prefix_words(docs, counts, 1, part=50).collect()}
    blocks = L.prefix_blocks(docs, counts, 1, part=50)
    plain_rows = [c for c in L.COLUMNS if c not in L.WIDE]
    got = blocks.select(L.F.explode(L.F.arrays_zip(*plain_rows, "doc_id")).alias("x")).select("x.*")
    keep = [L.COLUMNS.index(c) for c in plain_rows] + [len(L.COLUMNS)]
    assert {tuple(r) for r in got.collect()} == {tuple(r[i] for i in keep) for r in want}
    assert blocks.count() * 100 < len(want)  # few rows are moved
    pairs = [{tuple(r) for r in L.candidates(x, 3).collect()} for x in (L.prefix_words(docs, counts, 1, part=50), blocks)]
    assert pairs[0] == pairs[1] and pairs[0]
