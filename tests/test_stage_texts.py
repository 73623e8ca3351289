"""Staging folds the texts of a batch once; who holds a natural key is found without them."""

from tracetally.plans import registry


def test_texts_are_folded_once(spark, capsys):
    registry.QUERIES["stage"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out.splitlines()
    assert sum("partial_max_by(" in line and ", content, " in line.split("functions=")[1] for line in plan) == 1
