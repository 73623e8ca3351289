"""Greedy packing over blocks against the plain fold."""

import random

import pytest

from tracetally.operators import measure as M
from tracetally.operators import packs


def fold(rows, most, budget):
    out, state = [], {}
    for request, position, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0)):
        pack, seqs, used = state.get(request, (0, 0, 0))
        n = tokens or 0
        if seqs >= most or used + n > budget:
            pack, seqs, used = pack + 1, 0, 0
        state[request] = pack, seqs + 1, used + n
        out.append((request, position, n, pack))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None, f"r{k % 40}"]), rng.randrange(n), rng.choice([0, 1, 5, 30, 99, 100])) for k in range(n)]


@pytest.mark.parametrize("most, budget, block", [(4, 100, 7), (1, 100, 5), (50, 100, 8), (3, 10**9, 16), (10**6, 10**9, 6), (16, 400, 16_384)])
def test_blocks_give_the_packs_of_the_fold(spark, most, budget, block):
    rows = made(most + block, 700)
    docs = spark.createDataFrame(rows, "request_id string, position long, tokens long")
    got = sorted((tuple(r) for r in packs.greedy_packs(docs, most, budget, block).collect()), key=str)
    assert got == fold(rows, most, budget)


def test_one_large_request_is_spread_over_tasks(spark):
    docs = spark.range(1_000_000).selectExpr("'r' AS request_id", "id AS position", "100 + (id * 7919) % 401 AS tokens")
    packed = packs.greedy_packs(docs, 16, 2048)
    rows = sorted((r["position"], r["tokens"], r["pack"]) for r in packed.toLocalIterator())
    pack, seqs, used = 0, 0, 0
    for position, tokens, got in rows:
        if seqs >= 16 or used + tokens > 2048:
            pack, seqs, used = pack + 1, 0, 0
        seqs, used = seqs + 1, used + tokens
        assert got == pack
    assert len(rows) == 1_000_000
    assert packed.selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_null_tokens_and_empty_input(spark):
    docs = spark.createDataFrame([("a", 0, None), ("a", 1, 5)], "request_id string, position long, tokens long")
    packed, rejects = M.pack_batches(docs, 2, 100, 50)
    assert sorted(tuple(r) for r in packed.collect()) == [("a", 0, 0, 0), ("a", 1, 5, 0)] and rejects.count() == 0
    assert M.pack_batches(docs.limit(0), 2, 100, 50)[0].count() == 0
