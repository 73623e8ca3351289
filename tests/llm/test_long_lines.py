"""Long lines that share words but are not similar must not be compared as whole sets."""

import random

from tracetally.llm import line_dedup as L


def test_long_lines_of_common_words_name_no_candidates(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    lines = [rnd.sample(words, 150) for _ in range(60)]
    near = lines[3][:145] + ["other1", "other2"]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*lines, near])], "doc_id long, text string")
    postings = L.prefix_words(docs, L.word_counts(docs), 1).withColumn("active", L.F.lit(True))
    pairs = {(r.l_doc_id, r.r_doc_id) for r in L.candidates(postings, 3).filter("r_n IS NOT NULL").collect()}
    assert pairs == {(60, 3)}
    assert [tuple(r) for r in L.removed_lines(docs).collect()] == [(60, 0)]


def test_sets_with_and_without_the_wide_sketch_still_meet(spark):
    words = [f"word{i}" for i in range(L.WIDE_FROM + 4)]
    texts = [" ".join(words), " ".join(words[:-8])]  # one of them carries the sketch, the other is too short
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in L.removed_lines(docs).collect()] == [(1, 0)]
