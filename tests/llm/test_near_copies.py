"""Groups of similar texts against brute force over all pairs."""

import random

import numpy as np
import pytest

from tracetally.llm import near_copies as N

SCHEMA = "doc_id long, text string, `__raw` string, `__nth` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "own", 7) for i, t in rows], SCHEMA).repartition(3)


def brute_set(text):
    w = N.words_of(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_labels(rows):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def brute_kept(rows):
    groups = {}
    for row, label in zip(rows, brute_labels(rows)):
        rank = (row[0] is None, row[0] or 0, N.row_digest(*row))
        groups[label] = min(groups.get(label, (rank, row)), (rank, row), key=lambda x: x[0])
    return sorted(((r[0], r[1]) for _, r in groups.values()), key=repr)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"new{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed, groups=40, copies=4):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5000}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 8, 20, 45, 62, 75, 150, 400, 900]))]
        if g % 3 == 0:
            base += passage
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 40)))))
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


ODD = [(None, None), (5, ""), (5, " \n"), (1, "one two"), (1, "One  TWO"), (None, "one two"), (2, "three"), (2, "three"), (3, "a b c d e f g h i j"), (4, "a b c d e f g h i j k"), (6, "z " * 40_000), (7, "z " * 39_999 + "y")]


@pytest.mark.parametrize("bucket", [N.BUCKET, 2])
def test_odd_rows(spark, bucket):
    docs = frame(spark, ODD)
    kept = N.keep_one_similar(docs, bucket=bucket)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {(r["__raw"], r["__nth"]) for r in got} == {("own", 7)}
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_kept(ODD)


def test_empty(spark):
    assert N.keep_one_similar(frame(spark, [])).count() == 0


def test_recall_and_no_false_groups(spark):
    """No two groups that brute force parts are joined; nine in ten similar pairs are found in every band."""
    rows = corpus(1, groups=120)
    docs = frame(spark, rows)
    stays = {(r.own.doc_id, bytes(r.own.raw)): (r.least.doc_id, bytes(r.least.raw)) for r in N.similar_groups(docs.select("doc_id", "text")).collect()}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(N.words_of(t).__repr__(), (i, N.row_digest(i, t)))
    label = brute_labels(rows)
    mine = [stays[min((first[repr(N.words_of(t))], (i, N.row_digest(i, t))))] for i, t in rows]
    sets = [brute_set(t) for _, t in rows]
    found, total = np.zeros(4), np.zeros(4)
    for i in range(len(rows)):
        for j in range(i):
            if mine[i] == mine[j]:
                assert label[i] == label[j]
            s = similarity(sets[i], sets[j])
            if 0.8 <= s < 1:
                band = min(3, int((s - 0.8) * 20))
                total[band] += 1
                found[band] += mine[i] == mine[j]
    assert total.sum() > 100 and (total > 5).all()
    assert (found >= 0.9 * total).all(), (found, total)


def test_chain_of_edits(spark):
    """Every text is similar to the next ones only; a large bucket is compared part by part, over several rounds."""
    rng = random.Random(4)
    now = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(now)))
        now = edited(rng, now, 3)
    assert sorted((r.doc_id, r.text) for r in N.keep_one_similar(frame(spark, rows), bucket=10).collect()) == brute_kept(rows)


def test_stretches_survive_edits():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    whole = N.stretches(hashes)
    part = N.stretches(np.concatenate([rng.integers(0, 1 << 63, 10).astype(np.uint64), hashes[200:2800]]))
    assert 150 < len(whole) < 400 and len(np.intersect1d(whole, part)) >= len(part) - 4
