"""Line dedup and decontamination against brute force."""

import random
import string

import numpy as np
import pytest

from tracetally.llm import decontam as D
from tracetally.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n int, sid long, age string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], SCHEMA).repartition(3)


def brute_removed(rows, shortest=L.SHORTEST):
    lines = [((i is None, i or 0), no, frozenset(x.lower().split())) for i, t in rows for no, x in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if len(x[2]) >= shortest]
    out = set()
    for i, no, s in lines:
        for j, m, r in lines:
            if (j, m) < (i, no) and 5 * len(s & r) >= 4 * len(s | r):
                out.add((None if i[0] else i[1], no))
    return out


def line_corpus(rng, n):
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 10
    lines, rows = [], []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 5)):
            if lines and rng.random() < 0.5:
                words = rng.choice(lines).split()
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(len(words))] = rng.choice(vocab).title()
                rng.shuffle(words)
            else:
                words = rng.choices(vocab, k=rng.choice([1, 9, 12, 30]))
            text.append(" ".join(words))
            lines.append(text[-1])
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("settings", [{}, {"named": 3}, {"part": 40}, {"slots": 64}])
def test_removed_lines(spark, settings):
    rows = line_corpus(random.Random(len(settings)), 60) + [(500, None), (501, ""), (502, "\n\n"), (None, "a b c d e f g h i"), (None, "a b c d e f g h i\nA b c d e f g h i j"), (7, "a b c d e f g h i"), (503, "x " * 30_000), (504, " ".join(map(str, range(5000)))), (505, " ".join(map(str, range(4900))))]
    got = {tuple(r) for r in L.removed_lines(frame(spark, rows).select("doc_id", L.F.coalesce("text", L.F.lit("")).alias("text")), **settings).collect()}
    assert got == brute_removed(rows)


def test_group_of_similar_lines_stays_linear(spark):
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i in range(400) for k in [i % 40]]
    docs = frame(spark, rows).select("doc_id", "text")
    postings = L.prefix_words(docs, L.word_counts(docs), 8).withColumn("active", L.F.lit(True))
    assert L.candidates(postings, 3).count() <= 4 * postings.count()
    assert L.removed_lines(docs).count() == 399


def test_dropped_lines_and_report(spark):
    one = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(1, f"{one}\nshort line"), (2, f"intro\n{one.upper()}\nshort line"), (3, None), (3, ""), (4, "keep  spacing \n\n as is ")]
    docs = frame(spark, rows)
    assert (2, "intro") in {(r["doc_id"], r["text"]) for r in L.drop_repeated_lines(docs).collect()}  # every line takes part unless a bound is named
    out = L.drop_repeated_lines(docs, shortest=8)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "intro\nshort line"), (3, None), (3, ""), (4, rows[4][1])], key=str)
    report = {(r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in L.line_report(docs, shortest=8).collect()}
    assert report == {(1, 2, ()), (2, 3, (1,)), (3, 1, ()), (4, 3, ())}
    assert L.line_report(frame(spark, [])).count() == 0 and L.drop_repeated_lines(frame(spark, [])).count() == 0


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def plain_words(t):
    return "".join(" " if c in string.punctuation or (ord(c) < 128 and not c.isalnum()) else c for c in (t or "").lower()).split()


def brute_leaks(docs, items):
    out = {}
    for i, t in docs:
        w = plain_words(t)
        grams = {tuple(w[k : k + D.GRAM]) for k in range(len(w) - D.GRAM + 1)}
        for m, x in items:
            v = plain_words(x)
            if any(tuple(v[k : k + D.GRAM]) in grams for k in range(len(v) - D.GRAM + 1)):
                s = plain_alignment(v, w) / (2 * len(v))
                if s >= D.LEAST:
                    out[i, m] = max(out.get((i, m), 0), s)
    return out


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        assert D.alignment(a, b)[0] == plain_alignment(a.tolist(), b.tolist())


@pytest.mark.parametrize("bits", [D.BITS, 128])
def test_leaks(spark, bits):
    """With a table of 128 bits nearly every n-gram passes it; the join must drop them."""
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=20 + i))) for i in range(12)] + [(50, None), (51, "too short"), (52, "one two three four five"), (53, "one two three four five")]
    docs = [(900, None), (901, ""), (902, "One, two; three: four -- FIVE!"), (None, "x one two three four five"), (903, "w " * 50_000)]
    for i in range(60):
        words = rng.choices(vocab, k=rng.choice([10, 80]))
        if i % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(8)):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["edited"], [part[k], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = part[: rng.choice([len(part), len(part) // 2])]
        docs.append((i, " ".join(words)))
    docs.append(docs[-1])
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    leaks = D.find_leaks(frame(spark, docs), bench, bits=bits).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in leaks} == {k: round(v, 9) for k, v in brute_leaks(docs, items).items()}
    assert len(leaks) == len({(r["doc_id"], r["item_id"]) for r in leaks})
    kept = D.without_leaks(frame(spark, docs), bench, bits=bits)
    bad = {r["doc_id"] for r in leaks}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    none = bench.limit(0)
    assert D.find_leaks(frame(spark, docs), none).count() == 0 and D.find_leaks(frame(spark, []), bench).count() == 0
