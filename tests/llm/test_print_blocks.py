"""Texts whose whole-text fingerprints differ in three bits or fewer meet through blocks of these, without a stretch in common."""

import random

from pyspark.sql import functions as F

from tracetally.llm import near_copies as N


def test_all_close_fingerprints_meet(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k % 6)) for k, p in enumerate(prints)]
    rows = [(i, 100, N.signed(p)) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long")
    blocks = N.print_blocks(nodes, 3).withColumn("label", F.col("node"))
    got = {(r.a, r.b) for r in N.bucket_links(blocks, 100, 0.8, 3, 20).collect()}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_pair_without_common_stretch_is_grouped(spark, monkeypatch):
    monkeypatch.setattr(N, "rare_blocks", lambda nodes, *_: nodes.select(F.col("node").alias("block"), "node", "n", "fp"))  # no text meets another
    words = [f"w{i}" for i in range(600)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one_similar(docs).collect()) == [1, 3]
