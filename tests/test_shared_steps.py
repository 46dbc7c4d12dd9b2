"""Steps that several queries share do their work once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimweave.operators import analytics as A
from claimweave.operators import claims as C
from claimweave.operators import evidence as E
from claimweave.plans.analytics import CONFLICTING
from claimweave.plans.claims import enriched
from claimweave.plans.evidence import _both
from claimweave.sources.tables import claims, settled

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_make_statements_once(spark):
    e = settled(enriched(spark, SMALL).select(CONFLICTING))
    assert plan(A.numeric_conflicts(e)).count("regexp_replace") == 0 and A.numeric_conflicts(e).count() > 0


def test_keys_of_claims_are_taken_apart_once(spark):
    e, records = _both(spark, SMALL)
    found = E.find_evidence(e, records)
    # of claims nothing is left to derive; what remains is that of records
    assert plan(found).count("regexp_extract") == 0 and plan(found).count("metric_unit") == plan(records).count("metric_unit")


@pytest.mark.parametrize("few, sizes", [(1, [3, 2]), (32, [0, 0])])
def test_equal_values_of_a_signature_stand_together(spark, monkeypatch, few, sizes):
    """One value and direction in 300 reports is one row of the running sums over all reports, and none within them."""
    rows = [("s", f"r{i}", 5.0, "increase") for i in range(300)] + [("s", "r0", 50.0, "decrease"), ("s", "r1", None, "decrease")]
    c = spark.createDataFrame(rows, "claim_signature string, report_id string, metric_value double, metric_direction string")
    summed, plainly = [], A._within
    monkeypatch.setattr(A, "FEW", few)
    monkeypatch.setattr(A, "_within", lambda df, group: summed.append(df.count()) or plainly(df, group))
    got = {(r.report_id, r.metric_value): (r.turned, r.apart, r.links) for r in A.signature_conflicts(c).collect()}
    assert summed == sizes
    assert got[("r5", 5.0)] == (2, 1, 2) and got[("r0", 50.0)] == (299, 299, 299) and got[("r1", None)] == (299, 0, 299) and got[("r0", 5.0)] == (1, 0, 1)


def test_rules_run_on_classes(spark):
    """Flags count every claim, and rules run once for claims that are alike."""
    e = settled(C.enrich(claims(spark, SMALL)))
    twice = e.unionByName(e.withColumn("claim_id", F.col("claim_id") + 10**9))
    one, two = C.gate_classes(e), C.gate_classes(twice)
    assert one.count() == two.count()
    plainly = {r.flag: 2 * r.n for r in C.gate_stats(C.gate(e), e).collect()}
    assert {r.flag: r.n for r in C.gate_stats(C.gate(two), two).collect()} == plainly and plainly["furniture_dropped"] > 0
