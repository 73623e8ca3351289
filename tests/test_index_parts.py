"""A task that writes the positional index sorts a part of a shard; documents are read once, their words written only as index rows."""

from tracetally.operators import inverted as I


def test_parts_of_a_shard_are_sorted_apart(spark):
    docs = [(f"d{i}", [f"w{i % 3}", "a", f"w{i % 7}"][: i % 4]) for i in range(400)]
    lexical = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "id string, tokens array<string>, n_tokens int")
    index = I.build_inverted(lexical, shard_docs=50, part_docs=10)
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = index.selectExpr("spark_partition_id() AS p", "bucket", "token", "shard", "ids", "n_docs").collect()
    words = [r for r in rows if r.bucket != I.META]
    assert len({r.shard for r in words}) == 8 and len({r.p for r in words}) > 16
    assert len({(r.shard, r.token, i) for r in words for i in r.ids}) == sum(len(r.ids) for r in words) == sum(len(set(t)) for _, t in docs)
    assert all(r.n_docs == len(r.ids) for r in words)
    assert I.totals(I.write_inverted(index)) == (400, sum(len(t) for _, t in docs), 8)
