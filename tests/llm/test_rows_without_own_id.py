"""Rows that share an id, or have none, keep what is their own; helper columns never clash."""

from tracetally.llm import decontam, exact_dedup, line_dedup, simhash

COLUMNS = "doc_id long, text string, __fp string, __nth int, __keep_id string, __removed string, __doc int, __row int, __leaked string"
ITEM = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon today"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, "k", "r", 2, 3, "l") for i, t in rows], COLUMNS)


ROWS = [
    (1, "a common opening line of these texts\nfirst own line here"),
    (None, "a common opening line of these texts\nanother thing altogether"),
    (None, "one quite different line without a twin\nsecond of them"),
    (7, "a common opening line of these texts\nseven one"),
    (7, "totally other words in this first line\nseven two"),
    (7, ITEM),
    (None, ITEM),
]


def others(out):
    return {tuple(r)[2:] for r in out.collect()}


def test_lines(spark):
    docs = table_of(spark, ROWS)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and others(kept) == others(docs)
    texts = sorted(r["text"] for r in kept.collect())
    assert "one quite different line without a twin\nsecond of them" in texts
    assert "totally other words in this first line\nseven two" in texts
    assert texts.count("a common opening line of these texts\nfirst own line here") == 1
    assert "another thing altogether" in texts and "seven one" in texts
    report = {(r["doc_id"], r["n_lines"]): r["removed"] for r in line_dedup.line_report(table_of(spark, ROWS[:3])).collect()}
    assert report[1, 2] == []


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = table_of(spark, ROWS)
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in ROWS if t != ITEM)
    found = decontam.find_leaks(docs, bench).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["7", "None"]


def test_near_copies(spark):
    docs = table_of(spark, ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and others(kept) == others(docs)
    assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in ROWS})


def test_exact_copies_with_text_ids_and_the_smallest_number(spark):
    rows = [("b", "x y"), ("a", "xy"), (None, "x y"), ("c", "z")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": ("b", 3, True), "a": ("b", 3, False), None: ("b", 3, False), "c": ("c", 1, True)}
    least = -(2**63)
    got = exact_dedup.exact_groups(spark.createDataFrame([(least, "q"), (5, "q")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(least, least, True), (5, least, False)}


def test_dense_groups_go_through_several_rounds(spark):
    """Lines that share their rare words but are not similar enough, and a late twin that only many candidates reveal."""
    base = [f"rare{k}" for k in range(10)]
    rows = [(i, " ".join(base[:7] + [f"own{i}a{j}" for j in range(3)])) for i in range(60)]
    rows += [(1000 + i, " ".join(base[:7] + [f"own{i}a{j}" for j in range(2)] + [f"odd{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def similar(a, b):
        a, b = set(a.split()), set(b.split())
        return 5 * len(a & b) >= 4 * len(a | b)

    want = {i for i, t in rows if any(j < i and similar(t, u) for j, u in rows)}
    assert {r["doc_id"] for r in line_dedup.removed_lines(docs, named=1).collect()} == want and want
