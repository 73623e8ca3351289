"""Join sides that grow with the input are never sent to the driver, however small Spark estimates them."""

import re

from tracetally.operators import cost as C
from tracetally.plans import tables as P
from tracetally.plans.cost import finalized
from tracetally.plans.derived import table

FOLDER = "/root/testdata/sf0.001"


def broadcast_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan))


def test_runs_and_calls_are_joined_by_shuffles(spark):
    keys = {"agent_run_id", "parent_agent_run_id", "call_id", "fallback_from_call_id"}
    assert not keys & broadcast_keys(P.integrity_report(spark, FOLDER))
    detail = C.turn_detail(finalized(spark, FOLDER), table(spark, FOLDER, "agent_runs"), table(spark, FOLDER, "accounts"))
    assert "agent_run_id" not in broadcast_keys(detail)
