from __future__ import annotations

from claimweave.operators import evaluation as V


def test_tasks_send_no_more_of_a_stratum_than_its_quota_can_be(spark):
    rows = [(f"u{i}", ("A_numeral_and_esg", "B_numeral_only", "C_other", "unknown")[i % 4]) for i in range(800)]
    found = V.stratified_sample(spark.createDataFrame(rows, "unit_id string, stratum string"), 100)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    counts = {r.stratum: r.n for r in found.groupBy("stratum").count().withColumnRenamed("count", "n").collect()}
    assert counts == {"A_numeral_and_esg": 60, "B_numeral_only": 25, "C_other": 15}
