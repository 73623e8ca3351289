"""Language-model scores: counts and base against plain Python, the model against its own tables, seating against its law."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracetally.llm import pitman_yor
from tracetally.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
SMALL = {"share": 0.004, "chunk": 900, "shard": 700}


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def base_rows(rows):
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    for i, x in rows:
        ts = tokens(x)
        yield i, held(i), len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)


def check(rows, out):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    got = sorted([tuple(r)[:6] for r in out], key=key)
    for a, b in zip(got, sorted(base_rows(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    assert all(r["score"] <= 1e-12 for r in out)


def corpus(n=60, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab[: rng.choice([5, 20, 80])]) for _ in range(rng.randrange(0, 200))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", " odd%d" % i])))
    return rows


def test_counts_and_base(spark):
    rows = [*corpus(), (100, None), (101, ""), (102, " \n"), (None, "W1 w2"), (7, "É é ÀB"), (7, "É é ÀB"), (103, "\x0bA\x0cb\xa0c")]
    check(rows, pitman_yor.scores(spark.createDataFrame(rows, SCHEMA), **SMALL).collect())


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = QUERIES["op11_pitman_yor"](spark, folder).collect()
    check(rows, out)
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def probabilities(model, vocabulary):
    """The model as plain Python: (context word, word) -> probability; an unseen word is ``object()``."""
    dishes = len(model.head) + 1
    rows = model.counts.collect()
    pair = {r["key"]: r["kept"] for r in rows if not r["rare"]}
    rare = {r["key"] % 2**64: r["kept"] for r in rows if r["rare"]}
    code = {w: pitman_yor.END if w is None else hash_of(w) for w in vocabulary}
    dish = {w: int(model.dish(np.array([c], np.uint64))[0]) for w, c in code.items()}

    def p(before, word):
        u, d = dish.get(before, dishes - 1), dish.get(word, dishes - 1)
        out = pair.get(u * dishes + d, 0) / (pitman_yor.THETA + model.customers[u]) + model.shared[u] * model.parent[d]
        if d == dishes - 1:
            out *= rare.get(code.get(word), 0) / (pitman_yor.THETA + model.rare[0]) + model.rare[1]
        return out

    return p


def hash_of(word):
    raw, _, _ = pitman_yor.Words().raw(np.frombuffer(word.encode(), np.uint8))
    return int(pitman_yor.mixed(raw)[0])


def test_probabilities_add_up_and_scores_follow(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pitman_yor.fit(docs, **SMALL)
    known = {t for i, x in rows if not held(i) for t in tokens(x)}
    p = probabilities(model, known)
    assert 5 < len(model.head) < len(known)
    for before in [None, "w1", "w70", "odd1", "never"]:
        assert sum(p(before, w) for w in known) + p(before, object()) == pytest.approx(1, abs=1e-9)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, model, chunk=900).collect()}
    for i, x in rows:
        ts = tokens(x)
        assert got[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *ts], ts)), rel=1e-9)


def test_chunks_and_shards_change_nothing(spark):
    rows = corpus(40, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (
        {r["doc_id"]: r["score"] for r in pitman_yor.scores(docs.repartition(n), share=0.004, chunk=chunk, shard=shard).collect()}
        for n, chunk, shard in ((1, 10**6, 10**6), (7, 150, 90))
    )
    assert a == pytest.approx(b, rel=1e-9)


def test_long_texts_across_segments(spark):
    rng = random.Random(1)
    words = ["x" * rng.choice([1, 5, 700_000]) + str(k % 50) for k in range(40)] + [f"y{k % 300}" for k in range(250_000)]
    rng.shuffle(words)
    rows = [(2, " ".join(words)), (3, "z" * 1_200_000), (4, " " * 1_200_000 + "end"), (5, "a b")]
    check(rows, pitman_yor.scores(spark.createDataFrame(rows, SCHEMA), share=0.001).collect())


def test_no_training_rows_and_empty_table(spark):
    only = [(i, "a b") for i in range(50) if held(i)]
    out = pitman_yor.scores(spark.createDataFrame(only, SCHEMA)).collect()
    check(only, out)
    assert all(r["score"] == 0 for r in out)
    assert pitman_yor.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_columns_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "x y", 1, 2), ("b", "x", 3, 4)], "doc_id string, text string, task int, at int")
    check([("a", "x y"), ("b", "x")], pitman_yor.scores(docs).collect())


def test_seating_follows_its_law():
    """Tables of five customers: frequencies against an exact walk over all seatings of the dish."""
    d, others, base, c = 0.4, 3, 0.2, 5
    weight = {(): 1.0}
    for _ in range(c):  # weights of seatings as sorted table sizes
        new = Counter()
        for sizes, w in weight.items():
            new[tuple(sorted([*sizes, 1]))] += w * (pitman_yor.THETA + d * (others + len(sizes))) * base
            for k in range(len(sizes)):
                new[tuple(sorted([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]))] += w * (sizes[k] - d)
        weight = new
    law = Counter()
    for sizes, w in weight.items():
        law[len(sizes)] += w / sum(weight.values())
    n = 40_000
    drawn = Counter(pitman_yor.seat_again(np.arange(n), np.full(n, c), np.full(n, others), np.full(n, base), d, 1, pitman_yor.stirling_logs(d)).tolist())
    for t in range(1, c + 1):
        assert drawn[t] / n == pytest.approx(law[t], abs=0.01)


def test_seating_of_many_customers():
    """Beyond the exact table the mean number of tables follows one-by-one seating."""
    d, others, base, c, n = 0.5, 50, 0.02, 1500, 400
    got = pitman_yor.seat_again(np.arange(n), np.full(n, c), np.full(n, others), np.full(n, base), d, 2, pitman_yor.stirling_logs(d)).mean()
    start = pitman_yor.seat_again(np.arange(n), np.full(n, pitman_yor.EXACT), np.full(n, others), np.full(n, base), d, 2, pitman_yor.stirling_logs(d))
    rng, tables = np.random.default_rng(0), start.astype(float)
    for i in range(pitman_yor.EXACT, c):
        new = (pitman_yor.THETA + d * (others + tables)) * base
        tables += rng.random(n) < new / (new + i - d * tables)
    assert got == pytest.approx(tables.mean(), rel=0.03)
