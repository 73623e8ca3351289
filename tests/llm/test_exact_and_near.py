"""Exact groups and SimHash components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tracetally.llm import exact_dedup as X
from tracetally.llm import simhash as S
from tracetally.llm.components import components

SCHEMA = "doc_id long, text string, class string, fp long, `same` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 7, 1) for i, t in rows], SCHEMA).repartition(3)


ODD_ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc"), (6, "abc\x0b "), (7, "x" * 300_000), (8, "x" * 150_000 + "\n" + "x" * 150_000), (9, "é a"), (None, "abc"), (10, "éa"), (10, "éa"), (11, "a b"), (12, "ab")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        left = True
        for i, t in members:
            kept = left and i == best[0] and len(t) == len(best[1])
            left = left and not kept
            out.append((i, best[0], len(members), kept, hashlib.sha256(body.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("mask", [(1 << 62) - 1, 1])
def test_exact_groups(spark, mask):
    """With a fingerprint of one bit nearly all texts of one length collide; comparison alone must tell them apart."""
    rng = random.Random(3)
    rows = ODD_ROWS + [(100 + i, rng.choice(["ab", "cd", "a b", "ef ", "gh", "b a"])) for i in range(60)]
    got = [tuple(r) for r in X.exact_groups(frame(spark, rows), huge=200_000, mask=mask).collect()]
    assert sorted(got, key=key) == sorted(brute_exact(rows), key=key)


def test_exact_empty(spark):
    out = X.exact_groups(frame(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_chunk_hashes_combine():
    data = bytes(random.Random(1).randrange(256) for _ in range(70_000))
    for base in X.BASES:
        whole = 0
        for b in data:
            whole = (whole * base + b + 1) % X.PRIME
        assert X.text_hash(data, base) == whole
        assert X.combine(X.text_hash(data[:999], base), X.text_hash(data[999:], base), len(data) - 999, base) == whole


def brute_print(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, bits=3):
    prints = [brute_print(t, 3) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [(i, f"{p:016x}", least.get(x)) for (i, _), p, x in zip(rows, prints, label)]


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab).upper()
        else:
            words = rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 300]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("bucket", [S.BUCKET, 2])
def test_near_groups(spark, bucket):
    rows = [(1000 + (i or 0) if i is not None else None, t) for i, t in ODD_ROWS] + corpus(random.Random(5), 150)
    near = S.near_groups(frame(spark, rows), bucket=bucket)
    got = [tuple(r) for r in near.select("doc_id", S.hex_fingerprint(), "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_keep_one(spark):
    rows = corpus(random.Random(6), 120) + [(5000, "same row"), (5000, "same row"), (None, "same row"), (None, "alone here today"), (None, "alone here today")]
    docs = frame(spark, rows)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    group = {}
    for (i, _), (_, p, c) in zip(rows, brute_components(rows)):
        group[p] = c
    got = [(r["doc_id"], group[f"{brute_print(r['text'], 3):016x}"]) for r in kept.collect()]
    assert sorted(got, key=key) == sorted(set([(c, c) for c in group.values()]), key=key)


def test_near_empty(spark):
    assert S.near_groups(frame(spark, [])).count() == 0
    assert S.keep_one(frame(spark, [])).count() == 0


def test_spanning_links_connect_what_all_links_connect():
    rng = np.random.default_rng(2)
    f = np.unique(np.concatenate([x ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for x in rng.integers(0, 1 << 62, 5).astype(np.uint64)]))
    links = S.spanning_links(f, 3)
    assert len(links) < len(f)

    def parts(pairs):
        group = {int(x): int(x) for x in f}
        for a, b in pairs:
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
        return {frozenset(k for k in group if group[k] == v) for v in set(group.values())}

    assert parts(links) == parts([(int(a), int(b)) for a in f for b in f if (int(a) ^ int(b)).bit_count() <= 3])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
