"""The positional index is built without a row per occurrence of a word and written without a further exchange."""

from collections import defaultdict

from tracetally.operators import inverted as I


def test_postings_need_one_exchange_and_no_row_per_occurrence(spark):
    docs = [(f"d{i}", [f"w{i % 3}", "a", f"w{i % 7}", "a"][: i % 5], ) for i in range(60)] + [("none", [])]
    rows = [(i, t, len(t)) for i, t in docs]
    index = I.build_inverted(spark.createDataFrame(rows, "id string, tokens array<string>, n_tokens bigint"), shard_docs=5)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan
    got = defaultdict(dict)
    for r in I.write_inverted(index).filter("bucket >= 0").collect():
        assert r.tfs == [len(p) for p in r.positions]
        for one in zip(r.ids, r.lengths, r.positions):
            assert one[0] not in got[r.token]
            got[r.token][one[0]] = one[1:]
    want = defaultdict(dict)
    for i, t in docs:
        for w in set(t):
            want[w][i] = (len(t), [k for k, x in enumerate(t) if x == w])
    assert got == want
