"""Decontamination against alignment without seeds."""

import random

from tests.llm.test_lines_and_leaks import plain_alignment, plain_words
from tracetally.llm import decontam as D


def test_every_copy_that_scores_enough_is_found(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 60)  # several chunks
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([15, 15, 16, 20, 20, 30, 7, 4, 3])] + [(20, "solo"), (21, "two only"), (22, None)]
    docs = [(900, "there is solo here"), (901, "only this"), (902, None), (903, "")]
    for i in range(150):
        part, every = rng.choice(items[:9])[1].split(), rng.randrange(2, 6)
        kind = i % 4
        if kind == 0:
            part = [f"x{k}" if k % every == every - 1 else w for k, w in enumerate(part)]
        elif kind == 1:
            part = [y for w in part for y in (w, "between")]
        elif kind == 2:
            part = [w for k, w in enumerate(part) if k % every != every - 1]
        else:
            for k in rng.sample(range(len(part)), len(part) // 3):
                part[k] = "new"
        docs.append((i, " ".join(rng.choices(vocab, k=rng.randrange(60)) + part + rng.choices(vocab, k=rng.randrange(60)))))
    want = {}
    for i, t in docs:
        for m, x in items:
            if x and (s := plain_alignment(plain_words(x), plain_words(t)) / (2 * len(plain_words(x)))) >= D.LEAST:
                want[i, m] = round(s, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in rows} == want and len(rows) == len(want) > 100
    assert all(r["seeds"] >= 1 and r["rarest"] >= 1 for r in rows)
