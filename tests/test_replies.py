from __future__ import annotations

import json

from claimweave.operators.extraction import enriched_replies


def claim(**more):
    return {"aspect": "Scope 1 emissions", "action": "reduced"} | more


def test_replies_become_whole_claims(spark):
    replies = {
        1: [claim(metric={"value": "12.5", "unit": "ktco2e", "direction": None}, location={"raw_text": "Mumbai", "specificity": "City"}, time={"start_date": "2021", "end_date": "2022-3-31", "baseline_year": "2019"}, confidence=0.9)],
        2: {"claims": [claim(metric={"value": None, "unit": "kl"}, location="Asia", time={"start_date": "null", "end_date": None}), {"action": "plan"}]},
        3: [claim(metric={"value": "about ten"}), claim(confidence="sure"), claim(confidence=1.7, location={"raw_text": "", "specificity": "city"})],
        4: {"aspect": "water withdrawal", "action": None, "metric": {"value": 7}, "location": {"raw_text": "x", "specificity": "moon"}},
    }
    rows = [(k, json.dumps(v), f"Emissions were reduced by a lot {k}", k * 10) for k, v in replies.items()] + [(5, "no json", "s", 50), (6, None, None, 60), (7, "[]", "s", 70), (8, "```json\n" + json.dumps(replies[1]) + "\n```", "s", 80)]
    got = enriched_replies(spark.createDataFrame(rows, "claim_id long, reply string, sentence string, page_number int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.claim_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 1, 2: 2, 3: 1, 4: 1, 8: 1}
    one = by[1][0]
    assert (one.metric_value, one.normalized_aspect, one.metric_family, one.page_number) == (12.5, "emissions.scope1", "emissions.scope1", 10)
    assert (one.location_text, one.location_scope, one.start_date, one.end_date, one.baseline_year, one.time_bucket) == ("Mumbai", "city", "2021-01-01", "2022-03-31", 2019, "2022")
    assert one.claim_type == "performance" and one.claim_signature == f"{one.metric_key}|2022|city" and one.confidence == 0.9 and one.canonical_unit == "tCO2e" and one.canonical_value == 12500.0
    assert 0 <= one.groundability <= 1 and 0 <= one.vagueness <= 1
    two = {r.aspect: r for r in by[2]}
    assert set(two) == {"Scope 1 emissions", "unknown"}
    assert (two["Scope 1 emissions"].metric_value, two["Scope 1 emissions"].metric_unit, two["Scope 1 emissions"].location_text, two["Scope 1 emissions"].location_scope, two["Scope 1 emissions"].time_bucket) == (None, None, "Asia", "region", "unknown_time")
    assert two["unknown"].normalized_aspect == "uncategorized" and two["unknown"].claim_type == "target"
    assert (by[3][0].confidence, by[3][0].location_scope, by[3][0].location_text) == (1.0, "global", None)
    assert (by[4][0].action, by[4][0].metric_value, by[4][0].metric_unit, by[4][0].location_scope) == ("reported", 7.0, "kL", "global")
    assert enriched_replies(spark.createDataFrame([], "claim_id long, reply string, sentence string")).count() == 0
