"""Packing, quality, revisits and chats."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracetally.llm import chat as C
from tracetally.llm import packing as K
from tracetally.llm import quality as Q
from tracetally.llm import warc as A

NAME = "word_bpe_49k.json"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, rank int").repartition(3)


def per_item_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            f = min(fits)
            free.remove(f)
            free.append(f - n)
        else:
            free.append(size - n)
    return len(free)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([5, 16, 64])
    lengths = [min(size, rng.choice([1, 2, 3, rng.randrange(1, size + 1)])) for _ in range(rng.randrange(1, 200))]
    counts = Counter(lengths)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, items, first, per, offset in K.plan(counts, size):
        for i in range(items):
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
            used[first + i // per].append((offset + i % per * length, length))
    assert {n: set(range(c)) for n, c in counts.items()} == dict(ranks)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) == per_item_best_fit(lengths, size)
    assert K.plan({}, size) == []


def test_words_give_the_tokenizer_s_ids():
    rng, plain = random.Random(1), Tokenizer.from_file(public_tokenizers.path(NAME))
    encode = K.WordEncoder(public_tokenizers.path(NAME))
    odd = ["", " ", "\n", "  ", "É", "é", "́", "don't", "I'LL", "a\x1cb", "\x1c", "\x85", "\xa0", "x y", "<|endoftext|>", "<|endoftext|>b", "naïve", "你好", "123", "½", "a" * 60, "İ", "Σς", "!?", "\t", "\r\n", "ß", "👍🏽", "​"]
    for _ in range(400):
        text = "".join(rng.choice([w, w + " ", w + "\n"]) for w in rng.choices(odd, k=rng.randrange(12)))
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids), repr(text)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 5)
    encode, plain = K.WordEncoder(public_tokenizers.path(NAME)), Tokenizer.from_file(public_tokenizers.path(NAME))
    for i in range(40):
        text = f"word{i % 7} and more{i} words"
        assert encode(text) == b"".join(x.to_bytes(4, "little") for x in plain.encode(text, add_special_tokens=False).ids)


def test_pack(spark):
    rng, plain = random.Random(2), Tokenizer.from_file(public_tokenizers.path(NAME))
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "two words"), (None, "no id"), (4, "long text " * 120)]
    rows += [(10 + i, " ".join(rng.choices(["alpha", "beta", "gamma's", "d."], k=rng.randrange(60)))) for i in range(80)]
    size = 64
    packed = K.pack(frame(spark, rows), NAME, size=size, with_ids=True)
    got = packed.collect()
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), size)):
            part = np.array(ids[a : a + size], "<u4")
            want[i, n, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) == per_item_best_fit([r["length"] for r in got], size)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in K.sequences(packed).collect()}
    assert whole == {s: b"".join(x for _, _, x in sorted(p)) for s, p in by.items()}
    assert K.pack(frame(spark, []), NAME).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        emit, step = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> t & 1 for t in range(n)]
            p = np.exp(sum(e for e, v in zip(emit, y) if v) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(Q.marginals(emit, step), good / total)
        padded = np.zeros((1, 7))
        padded[0, :n] = emit
        live = np.arange(7)[None] < n
        assert np.allclose(Q._expected(padded, live, step, np.ones(1))[0][0, :n], good / total)


def test_quality_holds_out_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = Q.score(docs, Q.fit(docs, labels))
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    score = {r["doc_id"]: r["predicted"] for r in rows if r["held_out"]}
    held = [(score[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in score]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.97
    moved = Q.score(docs, Q.fit(docs, labels.filter(Q.remainder(Q.F.col("doc_id")) != 2)))
    assert {r["doc_id"]: r["score"] for r in moved.collect()} == {r["doc_id"]: r["score"] for r in rows}  # held-out labels have no effect


def test_quality_of_odd_input(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "\n\n"), (3, "x " * 100_000), (4, "plain words here.\n" * 3)]
    docs = frame(spark, rows)
    labels = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int, label string")
    some = labels([(1, 0, 0, "l"), (4, 1, 0, "l"), (None, 1, 0, "l"), (3, None, 0, "l"), (99, 1, 1, "l")])
    for known in (some, labels([]), labels([(4, 1, 0, "l")])):
        field = Q.fit(docs, known)
        got = Q.score(docs, field).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        kept = Q.keep_good(docs, field)
        assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert Q.score(docs.limit(0), field).count() == 0 and Q.keep_good(docs.limit(0), field).count() == 0


URLS = ["http://www.A.com/x/", "https://a.com/x#f", "HTTP://m.a.com:80/x?ref=1", "http://a.com/x?b=2&a=1", "http://a.com/x?a=1&utm_source=q&b=2", "http://b.com", "http://B.com/", None, ""]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select(A.canonical_url(A.F.col("u")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["a.com/x", "a.com/x", "a.com/x", "a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "b.com", "b.com", None, ""]


@pytest.mark.parametrize("block", [1, 7, 10**9])
def test_revisits(spark, block):
    rng = random.Random(4)
    canonical = dict(zip(URLS, ["a.com/x"] * 3 + ["a.com/x?a=1&b=2"] * 2 + ["b.com"] * 2 + [None, ""]))
    rows = []
    for i in range(400):
        head = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "last-modified": rng.choice("mn"), "server": f"s{i}", "date": str(i), "expires": str(i)}
        for k in ("etag", "last-modified", "expires"):
            if rng.random() < 0.3:
                del head[k]
        rows.append((i, rng.choice(URLS), rng.choice([None, *range(40)]), rng.choice([200, 200, 304, 304, 500, None]), None if rng.random() < 0.1 else head))
    rows.append(rows[-1])
    records = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, url string, captured long, status int, headers map<string,string>, block int")
    want = Counter()
    for i, u, at, status, head in rows:
        if status != 304:
            continue
        c, head = canonical[u], head or {}
        old = [(t, j, h or {}) for j, v, t, s, h in rows if s == 200 and c is not None and canonical[v] == c and None not in (t, at) and t < at]
        if not old:
            want[i, c, at, None, "no_response", None] += 1
            continue
        _, j, h = max(old, key=lambda x: x[:2])
        tags = [x["etag"].removeprefix("W/") for x in (head, h) if "etag" in x]
        ok = tags[0] == tags[1] if len(tags) == 2 else "last-modified" in head and head["last-modified"] == h.get("last-modified")
        merged = {**h, **{k: v for k, v in head.items() if k in A.UPDATES}}
        want[i, c, at, j, "resolved" if ok else "validator_mismatch", "\n".join(f"{k}: {v}" for k, v in sorted(merged.items())) if ok else None] += 1
    out = A.resolve(records, block).withColumn("headers", A.header_lines(A.F.col("headers")))
    assert Counter(tuple(r) for r in out.collect()) == want
    assert A.resolve(records.limit(0)).count() == 0


def test_chats(spark):
    rng = random.Random(5)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "x<|im_end|>y", "long " * 50])) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    logged = [b[: rng.randrange(1, len(b) + 1)] for b in base for _ in range(5)] + base[:4]
    rows = [(i, n, role, text) for i, turns in enumerate(logged) for n, (role, text) in enumerate(turns)]
    rows += [(900, None, "user", "a"), (900, 3, "user", "b"), (900, 3, "user", "b"), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    whole = defaultdict(list)
    for c, n, role, text in rows:
        whole[c].append((n is not None, n or 0, role or "", text or ""))
    whole = {c: tuple(x[2:] for x in sorted(t)) for c, t in whole.items()}
    kept = [c for c, t in whole.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in whole.values())]
    want = {}
    for c in kept:
        same = [k for k in kept if whole[k] == whole[c]]
        if c == min(same, key=lambda k: (k is None, k or 0)):
            quiet = lambda x: x.replace("<|im_", "< |im_").replace("|>", "| >")
            want[c] = (len(whole[c]), len(same), "".join(f"<|im_start|>{r}\n{quiet(t)}<|im_end|>\n" for r, t in whole[c]))
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, block int").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in C.format_chats(turns).collect()}
    assert got == want
    assert C.format_chats(turns.limit(0)).count() == 0
    blocks = C.prefixes(turns, block=2).select("conv_id", "pos", "p1", "p2").collect()
    assert sorted(blocks, key=str) == sorted(C.prefixes(turns).select("conv_id", "pos", "p1", "p2").collect(), key=str)
