"""The registered queries and the pipeline, on the smallest tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_exact_and_near import brute_components, brute_print
from tests.llm.test_lines_and_leaks import brute_leaks, brute_removed
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_pack_quality_logs import per_item_best_fit
from tests.llm.test_spans import plain_pii, plain_secrets
from tracetally.llm import pii, quality, secret_scan
from tracetally.llm.common import stored, table
from tracetally.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name, kinds, plain", [("op1_secret_scan", secret_scan.KINDS, plain_secrets), ("op4_pii", pii.KINDS, plain_pii)])
def test_span_queries(spark, docs, name, kinds, plain):
    got = rows(spark, name)
    assert len(got) == len(docs)
    for i, t in docs:
        spans = sorted(plain(t or ""), key=lambda x: (x[1], kinds.index(x[0])))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(got[i]["spans"].split(",")) | {""}
        for k, n in Counter(k for k, _, _ in spans).items():
            assert got[i][f"n_{k}"] == n


def test_simhash_query(spark, docs):
    got = rows(spark, "op3_simhash")
    assert {(i, r["fingerprint"], r["component_id"]) for i, r in got.items()} == set(brute_components(docs))


def test_leak_query(spark, docs, items):
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in QUERIES["op5_decontamination"](spark, FOLDER).collect()}
    assert got == {k: round(v, 6) for k, v in brute_leaks(docs, items).items()}


def test_line_query(spark, docs):
    got = rows(spark, "op6_line_dedup")
    want = defaultdict(list)
    for i, no in sorted(brute_removed(docs)):
        want[i].append(no)
    for i, t in docs:
        assert got[i]["n_lines"] == len(t.split("\n"))
        assert got[i]["removed_lines"] == ",".join(map(str, want[i])) and got[i]["n_removed"] == len(want[i])


def check_packed(packed, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4")
            want[i, n, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:] + [(sum(n for _, n in parts), 0)])) and min(parts)[0] == 0
        assert sum(n for _, n in parts) <= 2048
    assert len(by) == per_item_best_fit([r["length"] for r in packed], 2048)


def test_packing_query(spark, docs):
    check_packed(QUERIES["op2_best_fit_packing"](spark, FOLDER).collect(), docs)


def test_pipeline(spark, items):
    """Every stage against brute force on what its predecessor kept."""
    columns, current, seen = ["doc_id", "text", "lang", "source", "n_chars"], table(spark, FOLDER, "documents"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in current.collect()}
        texts = [(i, r["text"]) for i, r in before.items()]
        current = stored(stage(spark, current, FOLDER))
        after = current.collect()
        seen.append(len(after))
        if name == "best_fit_packing":
            check_packed(after, texts)
            continue
        assert current.columns == columns
        kept = {r["doc_id"]: r for r in after}
        assert len(kept) == len(after) and set(kept) <= set(before)
        if name == "quality_classifier":
            whole = table(spark, FOLDER, "documents")
            good = quality.score(whole, quality.fit(whole, table(spark, FOLDER, "labels"))).filter("predicted = 1").collect()
            assert set(kept) == {r["doc_id"] for r in good}
        if name == "line_dedup":
            gone = brute_removed(texts)
            for i, t in texts:
                assert kept[i]["text"] == "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)
                assert kept[i]["n_chars"] == len(kept[i]["text"])
            assert gone
        if name == "simhash_near_dedup":
            assert set(kept) == {i for i, _ in brute_kept(texts)}
        if name == "decontamination":
            assert set(kept) == set(before) - {i for i, _ in brute_leaks(texts, items)}
        if name != "line_dedup":
            assert all(kept[i] == before[i] for i in kept)
    assert len(set(seen[:4])) > 1
    assert corpus_pipeline.run(spark, FOLDER).count() == seen[-1]


def test_words_of_a_fingerprint_are_split_at_ascii_white_space_only():
    assert brute_print("a b c d", 3) == brute_print("A\x0bb\x0c\tc  d", 3)
    assert re.split(r"[\x20\x09-\x0D]+", "a\xa0b") == ["a\xa0b"]
