"""Usage JSON: every text is parsed once; only values written as numbers count."""

from tracetally.sources import imports as I

ROW = "i int, j string, response_id string, stop_reason string, raw_stop_reason string"


def test_usage_json_is_parsed_once(spark):
    docs = ['{"input":1,"cost":{"input":0.25,"total":"2"}}', '{"input":"1","output":2.5,"cost":3}', "[1]", "x", None, '{"input":3,"reasoning":null,"output":true,"cost":null}']
    out = I.generation_usage(spark.createDataFrame([(i, d, "", "stop", "") for i, d in enumerate(docs)], ROW), "j")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    got = [(r.has_usage, r.input_tokens, r.output_tokens, r.cost_input, r.cost_total) for r in out.orderBy("i").collect()]
    assert got[0] == (True, 1.0, None, 0.25, None)
    assert got[1:5] == [(False, None, None, None, None)] * 4
    assert got[5] == (True, 3.0, None, None, None)
