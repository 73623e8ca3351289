"""The JVM never compiles a method above 8,000 bytes; a session without ``session.SETTINGS`` would interpret it."""

import re

import pytest

from tracetally.plans import registry


def largest_method(spark, capsys, df):
    df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


@pytest.mark.parametrize("name", ["attempt_cost", "call_cost", "session_summary", "recovered_calls", "attribution"])
def test_generated_methods_can_be_compiled(spark, capsys, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert 0 < largest_method(spark, capsys, registry.QUERIES[name](spark, "/root/testdata/sf0.001")) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
