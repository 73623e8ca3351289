"""Lines of few words take part in line dedup, in the query and in the pipeline."""

import random

import corpus_pipeline
import pytest

from tests.llm.test_lines_and_leaks import brute_removed
from tracetally.llm import line_dedup as L
from tracetally.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def short_rows():
    rng = random.Random(4)
    fixed = ["Read more", "这是同一行文字", "}", "a b c d", "a b c d e", "a b c", "", "  "]
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefg", k=rng.randrange(1, 9))) if rng.random() < 0.5 else rng.choice(fixed) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    return [*rows, (90, "read MORE\n这是同一行文字"), (91, "one line alone")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("settings", [{}, {"part": 5}])
def test_short_lines(spark, settings):
    rows = short_rows()
    got = {tuple(r) for r in L.removed_lines(docs_of(spark, rows).select("doc_id", "text"), **settings).collect()}
    assert got == brute_removed(rows, 1) and {(90, 0), (90, 1)} <= got


def test_query_and_stage_remove_short_lines(spark, tmp_path):
    rows = short_rows()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute_removed(rows, 1)
    got = {(r["doc_id"], int(x)) for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect() for x in r["removed_lines"].split(",") if x}
    assert got == gone
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs_of(spark, rows), str(tmp_path)).collect()}
    assert out == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in rows}
