"""The positional inverted index: phrases and scores against brute force, and what a search reads."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracetally.operators import index as X
from tracetally.operators import inverted as I
from tracetally.operators import search as S

WORDS = ["ash", "birch", "cedar", "elm", "fir", "oak", "pine", "yew"]
GLOBAL = [("global", "*")]


def texts(n, seed=4):
    rng = random.Random(seed)
    return {f"d{k}": " ".join(rng.choice(WORDS[: rng.choice([2, 5, 8])]) for _ in range(rng.randrange(0, 60))) for k in range(n)}


@pytest.fixture(scope="module")
def docs():
    return texts(300)


@pytest.fixture(scope="module")
def index(spark, docs):
    lexical = X.build_lexical(spark.createDataFrame(list(docs.items()), "id string, content string"))
    return I.write_inverted(I.build_inverted(lexical, shard_docs=40))


def items_of(spark, docs):
    rows = [(i, "r1", "ns", "document", "s", "t", i, 1, 1, "global", "*", "ready" if k % 7 else "pending") for k, i in enumerate(docs)]
    return spark.createDataFrame(
        rows, "id string, revision string, namespace string, type string, source_system string, source_type string, source_id string, created_at long, updated_at long, "
        "scope_kind string, scope_key string, lexical_state string"
    )


def ask(spark, queries, limit=5):
    rows = [(q, t, "lexical", GLOBAL, limit, limit) for q, t in queries]
    ok, _ = S.validate_queries(
        spark.createDataFrame(rows, "query_id string, text string, mode string, grants array<struct<kind:string,key:string>>, limit long, candidate_limit long")
    )
    return ok


def phrases_of(text):
    return [m.strip('"').split() for m in re.findall(r'"[^"]*"|\S+', text)]


def count(words, phrase):
    return sum(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))


def test_index_holds_every_word_once(spark, docs, index):
    want = {(w, i): [k for k, x in enumerate(t.split()) if x == w] for i, t in docs.items() for w in set(t.split())}
    rows = index.filter(F.col("bucket") != I.META).collect()
    got = {(r["token"], i): list(p) for r in rows for i, p in zip(r["ids"], r["positions"])}
    assert got == want and sum(len(r["ids"]) for r in rows) == len(want)
    assert all(list(r["tfs"]) == [len(p) for p in r["positions"]] for r in rows)
    assert I.totals(index) == (len(docs), sum(len(t.split()) for t in docs.values()), 8)


def test_phrases_by_intersection(spark, docs, index):
    said = ["oak", "oak pine", "ash ash", "ash birch ash", "yew yew yew yew", "never", "oak never"]
    ph = spark.createDataFrame([(p, p.split()) for p in said], "phrase string, words array<string>")
    hits, numbers = I.phrase_hits(index, ph)
    names = {k: p for p, k in numbers.items()}
    got = {(names[r["phrase"]], i): n for r in hits.collect() for i, n in zip(r["ids"], r["tfs"])}
    assert got == {(p, i): n for p in said for i, t in docs.items() if (n := count(t.split(), p.split()))}


def brute(docs, ready, text, method, limit):
    split = {i: t.split() for i, t in docs.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    scores = defaultdict(int)
    for phrase, times in Counter(map(tuple, phrases_of(text))).items():
        tf = {i: c for i, w in split.items() if (c := count(w, list(phrase)))}
        for i, c in tf.items():
            if method == "tfidf":
                w = (1 + math.log(c)) * math.log(1 + n / max(1, len(tf)))
            else:
                idf = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5))
                w = (idf if idf > 0 else 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(split[i]) / mean))
            scores[i] += math.floor(w * 1e12 + 0.5) * times
    best = sorted((-s, i) for i, s in scores.items() if i in ready)[:limit]
    return [(i, rank, pytest.approx(-s / 1e12)) for rank, (s, i) in enumerate(best, 1)]


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_search_equals_brute_force(spark, docs, index, method):
    items = items_of(spark, docs)
    ready = {i for k, i in enumerate(docs) if k % 7}
    queries = [("a", "oak"), ("b", 'oak oak "ash birch"'), ("c", "fir elm cedar"), ("d", "never"), ("e", '"yew yew" yew pine')]
    out = defaultdict(list)
    for r in S.search_lexical(ask(spark, queries), items, index, method).orderBy("rank").collect():
        out[r["query_id"]].append((r["id"], r["rank"], r["score"]))
    for q, text in queries:
        assert out[q] == brute(docs, ready, text, method, 5)


def test_inverted_and_scanned_search_agree(spark, docs, index):
    items, lexical = items_of(spark, docs), X.build_lexical(spark.createDataFrame(list(docs.items()), "id string, content string"))
    q = ask(spark, [(f"q{k}", f'{a} "{a} {b}" {b}') for k, (a, b) in enumerate(zip(WORDS, WORDS[1:]))], 50)
    a, b = ({(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in S.search_lexical(q, items, x).collect()} for x in (index, lexical))
    assert a == b and a


def test_only_touched_buckets_are_opened(spark, index):
    words = spark.createDataFrame([("oak",)], "token string")
    buckets = [r[0] for r in words.select(I.bucket_of(F.col("token"))).collect()]
    plan = I.read_words(index, words, buckets)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (?:= |IN)", plan)
    files = I.read_words(index, words, buckets).select(F.input_file_name()).distinct().collect()
    assert all(f"bucket={buckets[0]}/" in f[0] for f in files)


def test_single_words_read_no_positions(spark, index):
    ph = spark.createDataFrame([("oak", ["oak"])], "phrase string, words array<string>")
    plan = I.phrase_hits(index, ph)[0]._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "tfs" in plan


def test_empty_index(spark):
    none = spark.createDataFrame([], "id string, content string")
    index = I.write_inverted(I.build_inverted(X.build_lexical(none)))
    assert I.totals(index) == (0, 0, 1)
    assert S.search_lexical(ask(spark, [("a", "oak")]), items_of(spark, {}), index).collect() == []
