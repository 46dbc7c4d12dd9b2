from __future__ import annotations

from claimweave.operators import analytics as A
from claimweave.operators import review as W

CLAIM = "claim_id long, report_id string, claim_type string, vagueness double, groundability double, metric_value double, metric_direction string, time_bucket string, location_scope string, metric_family string, normalized_aspect string, source_sentence string, page_number int"
CONFLICT = "report_id string, claim_a long, claim_b long, conflict string, severity string, members_a long, members_b long"


def claims(spark, vague, clear, extra=()):
    rows = [(i, "r", "narrative", 0.9, 0.9, None, None, "2023", "global", "water", "water", f"sentence {i}", i % 3) for i in range(vague)]
    rows += [(100 + i, "r", "narrative", 0.0, 0.9, None, None, "2023", "global", "water", "water", "x" * 300, None) for i in range(clear)]
    return spark.createDataFrame([*rows, *extra], CLAIM)


def conflicts(spark, rows=()):
    return spark.createDataFrame(list(rows), CONFLICT)


def gone(spark, rows):
    return spark.createDataFrame(rows, "report_id string, subject_id string, flag string")


def test_dismissals_raise_the_score_and_the_raw_one_stays(spark):
    c, none = claims(spark, 45, 5), conflicts(spark)
    base = W.reviewed_scores(c, none, gone(spark, [("x", "y", "z")])).first()
    after = W.reviewed_scores(c, none, gone(spark, [("r", str(i), "VAGUE") for i in range(30)] + [("r", "7777", "VAGUE")])).first()
    assert (base.score, base.reviews_applied) == (base.score_raw, 0)
    assert after.score > base.score == after.score_raw and after.reviews_applied == 30
    flags = {r.flag: r for r in W.reviewed_flags(c, none, gone(spark, [("r", str(i), "VAGUE") for i in range(30)])).collect()}
    assert flags["VAGUE"].n == 15
    assert W.reviewed_flags(c, none, gone(spark, [("r", str(i), "VAGUE") for i in range(45)])).where("flag = 'VAGUE'").count() == 0


def test_the_last_review_counts_and_confirming_changes_nothing(spark):
    reviews = spark.createDataFrame([("r", "1", "VAGUE", "dismissed", 1), ("r", "1", "VAGUE", "confirmed", 2), ("r", "2", "VAGUE", "dismissed", 1)], "report_id string, subject_id string, flag string, verdict string, at int")
    assert [tuple(r) for r in W.dismissed(reviews).collect()] == [("r", "2", "VAGUE")]


def test_conflicts_and_flags_of_reports_can_be_dismissed(spark):
    extra = [(900 + i, "r", "performance", 0.0, 0.9, 1.0, None, "2023", "global", "emissions.total", "emissions.total", "x", 1) for i in range(2)]
    c, found = claims(spark, 0, 20, extra), conflicts(spark, [("r", 900, 901, "Metric", "High", 1, 1), ("r", 900, 902, "Hard", "Critical", 2, 3)])
    items = {(r.kind, r.flag): r for r in W.review_items(c, found).collect()}
    assert set(items) == {("contradiction", "CONTRADICTION"), ("report", "DISCLOSURE_GAP"), ("report", "ASPIRATIONAL_HEAVY")}
    assert items["report", "ASPIRATIONAL_HEAVY"].reason == "91% of claims are targets/narrative vs. 2 performance claims."
    subjects = {r.reason.split()[0]: r.subject_id for r in W.review_items(c, found).where("kind = 'contradiction'").collect()}
    assert len(set(subjects.values())) == 2 and all(len(s) == 12 for s in subjects.values())
    left = {r.flag: r for r in W.reviewed_flags(c, found, gone(spark, [("r", subjects["Hard"], "CONTRADICTION"), ("r", "__report__", "DISCLOSURE_GAP")])).collect()}
    assert set(left) == {"CONTRADICTION", "ASPIRATIONAL_HEAVY"} and left["CONTRADICTION"].n == 1
    none = W.reviewed_scores(c, found, gone(spark, [("r", s, "CONTRADICTION") for s in subjects.values()] + [("r", "__report__", "DISCLOSURE_GAP"), ("r", "__report__", "ASPIRATIONAL_HEAVY")])).first()
    assert (none.score, none.reviews_applied) == (100.0, 4) and none.score_raw < 100


def test_items_and_details_of_claims(spark):
    c = claims(spark, 8, 2)
    items = W.review_items(c, conflicts(spark)).where("kind = 'claim'").orderBy("subject_id").collect()
    assert [i.subject_id for i in items] == [str(i) for i in range(8)] and items[4].page_number == 1 and items[4].source_sentence == "sentence 4"
    detail = W.flag_details(c).first()
    assert (detail.flag, detail.severity, detail.n, detail.pct) == ("VAGUE", "High", 8, 80)
    assert detail.description == "8 claims (80%) are vague with no measurable metric — a primary greenwashing signal."
    assert [e.claim_id for e in detail.evidence] == [0, 1, 2, 3, 4]
    assert A.claim_flags(c).count() == 8 and W.review_items(c.limit(0), conflicts(spark)).count() == 0
