"""Operators on small tables written out here, and against plain loops where SQL has no counterpart."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from claimweave.operators import analytics as A
from claimweave.operators import claims as C
from claimweave.operators import documents as D
from claimweave.operators import evaluation as V
from claimweave.operators import evidence as E
from claimweave.operators import extraction as X
from claimweave.operators import store as T
from claimweave.operators import tables as B
from claimweave.operators import vectors as N
from claimweave.sources.tables import settled

CLAIM = "claim_id long, report_id string, normalized_aspect string, metric_value double, metric_unit string, metric_direction string, time_bucket string, location_scope string, source_sentence string"


def claims_of(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CLAIM)
    return settled(C.enrich(df.selectExpr("*", "1L AS company_id", "2023 AS report_year", "'x' AS aspect", "'performance' AS claim_type", "CAST(NULL AS STRING) AS location_text", "'text' AS source_type")))


def conflict(spark, a, b):
    """Kind of conflict of two claims: (aspect, value, unit, direction, time, scope, sentence)."""
    got = A.numeric_conflicts(claims_of(spark, [("r", *a), ("r", *b)])).collect()
    return got[0].conflict if got else None


S1, KG = "emissions.scope1", "tCO2e"
PAIRS = [
    ((S1, 100.0, KG, None, "2023", "global", "Emissions were 100"), (S1, 120.0, KG, None, "2023", "global", "Emissions were 120"), "Metric"),
    ((S1, 100.0, KG, None, "2023", "global", "Emissions were 100"), (S1, 120.0, KG, None, "2023", "global", "Other emissions of 120"), None),
    ((S1, 100.0, KG, None, "2023", "global", "Emissions were 100"), (S1, 120.0, KG, None, "2022", "global", "Emissions were 120"), None),
    ((S1, 100.0, KG, None, "2023", "city", "Emissions were 100"), (S1, 120.0, KG, None, "2023", "global", "Emissions were 120"), "Scope"),
    ((S1, 100.0, KG, "increase", "2023", "global", "A"), (S1, 100.0, KG, "decrease", "2023", "global", "B"), "Hard"),
    ((S1, 100.0, KG, "increase", "2023", "global", "A"), (S1, 150.0, KG, "decrease", "2023", "global", "B"), None),
    ((S1, 100.0, KG, None, "2023", "global", "A 1"), (S1, 0.1, "ktCO2e", None, "2023", "global", "A 2"), None),
    ((S1, 100.0, KG, None, "2023", "global", ""), (S1, 120.0, KG, None, "2023", "global", "Anything"), "Metric"),
    ((S1, 100.0, KG, None, "unknown_time", "global", "A"), (S1, 120.0, KG, None, "unknown_time", "global", "A"), None),
    ((S1, 0.0, KG, None, "2023", "global", "A"), (S1, 120.0, KG, None, "2023", "global", "A"), None),
    ((S1, 100.0, "km", None, "2023", "global", "A"), (S1, 120.0, "km", None, "2023", "global", "A"), None),
]


@pytest.mark.parametrize(("a", "b", "want"), PAIRS)
def test_conflicts(spark, a, b, want):
    assert conflict(spark, a, b) == want


def test_alike_claims_are_one_class(spark):
    rows = [("r", S1, v, KG, None, "2023", "global", "E were 1") for v in [100.0] * 30 + [200.0] * 20]
    got = A.numeric_conflicts(claims_of(spark, rows)).collect()
    assert [(r.claim_a, r.claim_b, r.members_a, r.members_b) for r in got] == [(0, 30, 30, 20)]


def test_signatures_meet_over_reports_only(spark):
    rows = [("a", S1, 100.0, KG, "increase", "2023", "global", "x"), ("b", S1, 160.0, KG, "decrease", "2023", "global", "x"), ("b", S1, 100.0, KG, "increase", "2023", "global", "x"), ("c", S1, None, KG, "decrease", "2023", "global", "x")]
    got = {(r.report_id, r.metric_value): (r.turned, r.apart, r.links) for r in A.signature_conflicts(claims_of(spark, rows)).collect()}
    assert got == {("a", 100.0): (2, 1, 2), ("b", 160.0): (1, 1, 1), ("b", 100.0): (1, 0, 1), ("c", None): (2, 0, 2)}


def test_verdicts(spark):
    rows = [("r1", S1, 100.0, KG, None, "2023", "global", "x"), ("r1", "water.consumption", 10.0, "kilolitres", None, "2023", "global", "x"), ("r1", "energy.total", 5.0, "MWh", None, "2023", "global", "x"), ("r1", "waste.total", 5.0, "tonnes", None, "2023", "global", "x")]
    record = "company_id long, metric_key string, year string, value double, unit string, quality string"
    facts = spark.createDataFrame([(1, "emissions.scope1.tonnes", "2023", 0.104, "ktCO2e", "verified"), (1, "water.consumption.volume", "2023", 20.0, "kilolitres", "illustrative"), (1, "energy.total.energy", "2023", 5.0, "widgets", "verified"), (2, "waste.total.mass", "2023", 5.0, "tonnes", "verified")], record)
    got = {r.claim_id: (r.verdict, r.confidence, r.evidence_quality) for r in E.fact_check(claims_of(spark, rows), facts).collect()}
    assert got == {0: ("SUPPORTED", 0.7, "verified"), 1: ("CONTRADICTED", 0.97, "illustrative"), 2: ("UNVERIFIED", 0.3, None)}


def test_scores_with_evidence(spark):
    scores = spark.createDataFrame([("a", 10, 80.0), ("b", 10, 80.0), ("c", 10, 99.0), ("d", 10, 80.0)], "report_id string, claims long, score double")
    summary = spark.createDataFrame([("a", 2, 1.0, 1.0, True), ("b", 2, 1.0, 0.1, False), ("c", 0, 1.0, 1.0, False)], "report_id string, contradicted long, coverage double, weighted_credibility double, grave boolean")
    got = {r.report_id: (r.score, r.penalty, r.bonus) for r in E.score_factcheck(scores, summary).collect()}
    assert got == {"a": (80.0, 10.0, 10.0), "b": (74.0, 6.0, 0.0), "c": (100.0, 0.0, 1.0), "d": (80.0, 0.0, 0.0)}


def test_evidence_files_of_both_shapes(spark, tmp_path):
    rows = [{"company_id": "c", "metric_key": "k", "year": 2023, "value": 1.5, "quality": "Verified"}, {"company_id": "_schema"}, {"metric_key": "k"}, {"company_id": "d", "quality": "odd"}]
    for name, body in (("a", rows), ("b", {"_meta": {}, "records": rows[2:] + rows[:1]})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body))
        got = E.load_evidence(spark, str(path)).collect()
        assert sorted((r.company_id, r.quality) for r in got) == [("c", "verified"), ("d", "unverified")]


def test_windows_fill_in_order(spark):
    rng = random.Random(1)
    rows = [(d, 1, b, i, "x" * rng.randint(1, 400), None if rng.random() < 0.3 else rng.choice("AB")) for d in range(3) for b in range(8) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, block_id int, idx int, sentence string, title string")
    got = {(r.doc_id, r.block_id, r.idx): r.window for r in D.windows(df, 700).collect()}
    want, held = {}, {}
    for d, _, b, i, s, _ in rows:
        size, w = held.get(d, (0, 0))
        if size and size + len(s) > 700:
            size, w = 0, w + 1
        held[d], want[d, b, i] = (size + len(s) + 1, w), w
    assert got == want


def test_quotes_find_their_sentence(spark):
    rng = random.Random(2)
    found = [(1, b, i, " ".join(rng.choices("alpha beta gamma delta omega sigma water energy".split(), k=9))) for b in range(4) for i in range(5)]
    quotes = []
    for q, (d, b, i, s) in enumerate(found):
        quotes.append((d, b, q, s[3:30] if q % 3 == 0 else s.replace("a ", "e ", 2) if q % 3 == 1 else "zzzz qqqq"))
    got = {r.quote: r.idx for r in X.match_sentences(spark.createDataFrame(quotes, "doc_id int, block_id int, quote int, source string"), spark.createDataFrame(found, "doc_id int, block_id int, idx int, sentence string")).collect()}
    for _, b, q, text in quotes:
        block = [(i, s) for _, x, i, s in found if x == b]
        held = [i for i, s in block if text in s or s in text]
        ratios = [(SequenceMatcher(None, text, s).ratio(), -i) for i, s in block]
        assert got[q] == (held[0] if held else -max(ratios)[1] if max(ratios)[0] >= 0.5 else None)


def test_sample_is_exact_and_repeatable(spark):
    units = spark.createDataFrame([(f"u{i}", "A_numeral_and_esg" if i % 2 else "C_other") for i in range(500)], "unit_id string, stratum string")
    one, two = (sorted(map(tuple, V.stratified_sample(units.repartition(k), 100).collect())) for k in (1, 7))
    assert one == two and sum(s == "C_other" for _, s, *_ in one) == 15 and sum(s != "C_other" for _, s, *_ in one) == 60


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "claim_id long, report_id string")
    path = str(tmp_path / "claims")
    T.write_reports(old, path)
    T.write_reports(spark.createDataFrame([(9, "a")], "claim_id long, report_id string"), path)
    T.write_reports(old.where("false"), path)
    assert sorted(r.claim_id for r in spark.read.parquet(path).collect()) == [3, 9]
    lines = spark.createDataFrame([('{"unit": "1", "claims": []}',), ('{"unit": "2", "claims": [{"bad": ]}',), ('{"unit": "3',), ("",)], "text string")
    assert [r.unit for r in T.todo(spark.createDataFrame([("1",), ("3",)], "unit string"), lines).collect()] == ["3"]
    runs = T.page_runs(spark.createDataFrame([("d", p) for p in (1, 2, 3, 7, 9, 10, 10)], "doc string, page int")).collect()
    assert sorted((r.first, r.last) for r in runs) == [(1, 3), (7, 7), (9, 10)]


def test_neighbours(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 0.0]), (4, 1, [0.0, 0.0]), (5, 1, [2.0, 0.0]), (6, 1, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = [(r.query_id, r.place, r.id) for r in N.neighbours(v, v.where("id = 0"), 2, 0.5, "label").orderBy("place").collect()]
    assert got == [(0, 1, 5), (0, 2, 6)]


def test_tables_of_odd_markdown(spark):
    md = "x\n| A | B |\n|---|:-:|\n| Water use | 1,000 |\n|| |\n| No | 5 |\n\n| lone | 1 |\nend\n| Q | Subject for review |\n| abc def | 3 |"
    pages = spark.createDataFrame([(1, md), (2, ""), (3, None)], "page_id int, markdown string")
    cells = B.table_cells(B.tables(pages)).collect()
    assert sorted((r.label, r.column, r.value, r.is_form) for r in cells) == [("Water use", "B", 1000.0, False), ("abc def", "Subject for review", 3.0, True)]


def test_sentences_of_years(spark):
    md = "| Metric | FY2021 | FY2022 | FY2023 |\n|---|---|---|---|\n| Water consumption | 100 | 150 | 150 |\n| Scope 1 | 0 | 5 | - |"
    got = B.sentence_of(B.yearly_claims(B.tables(spark.createDataFrame([(1, md)], "page_id int, markdown string")))).orderBy("row", "col").collect()
    assert [r.direction for r in got] == ["absolute", "increased", "stable", "absolute", "increased"]
    assert got[1].sentence == "Water consumption increased from 100 ML in FY2021 to 150 ML in FY2022 (+50.0%)."
    assert got[2].sentence == "Water consumption remained stable at 150 ML in both FY2022 and FY2023."
    assert got[0].sentence == "Water consumption was 100 ML in FY2021." and got[4].pct == 0.0


def test_repair_of_years(spark):
    md = "| M | FY 2023 | FY24 |\n| Use in FY23 | 10 | 12 |\n| Other | 3 | 4 |"
    pages = spark.createDataFrame([(1, md)], "page_id int, markdown string")
    rows = [(1, 1, "Use in FY23", 12.0), (2, 1, "Use in FY23", 10.0), (3, 1, "Use FY23 and FY24", 12.0), (4, 1, "Use", 12.0), (5, 1, "FY 24 use", 10.0), (6, 1, "FY25 use", 10.0)]
    got = {r.claim_id: (r.value, r.fy_column_fixed) for r in B.repair_years(spark.createDataFrame(rows, "claim_id int, page_id int, label string, value double"), pages).collect()}
    assert got == {1: (10.0, True), 2: (10.0, False), 3: (12.0, False), 4: (12.0, False), 5: (12.0, True), 6: (10.0, False)}


def test_sections_and_layout(spark):
    rows = [("h1", 1, 100.0, 16.0, "Energy and water", 1), ("p1", 1, 200.0, 10.0, "Some text here", 1), ("h2", 2, 100.0, 13.0, "Details", 1), ("p2", 2, 200.0, 10.0, "More text. And more", 1), ("top", 2, 10.0, 10.0, "Page 1", 1), ("note", 2, 700.0, 7.0, "small note", 1), ("li", 2, 400.0, 10.0, "1. first item", 1), ("cap", 2, 500.0, 8.0, "Figure 1: x", 1)]
    blocks = spark.createDataFrame([(1, b, p, t, y, y + 20, f, False, n) for b, p, y, f, t, n in rows], "doc_id int, block_id string, page_number int, text string, y0 double, y1 double, font_size double, is_bold boolean, line_count int")
    c = D.classify(blocks)
    kinds = {r.block_id: r.kind for r in c.collect()}
    assert kinds == {"h1": "heading", "p1": "paragraph", "h2": "heading", "p2": "paragraph", "top": "page_header", "note": "footnote", "li": "list", "cap": "caption"}
    heads = D.sections(c)
    assert sorted((r.block_id, r.level, r.title, r.parent) for r in heads.collect()) == [("h1", 1, "Environmental Performance", None), ("h2", 2, "Details", 1)]
    placed = {r.block_id: r.section for r in D.in_sections(c, heads).collect()}
    assert placed["p1"] == 1 and placed["p2"] == 2 and placed["top"] == 1


def test_a_sentence_of_figures_is_not_a_missing_one(spark):
    """Sentences of digits only say the same; a blank one may say anything; words say what they say."""
    rows = [(1, "12 / 13", 10.0), (2, "99", 20.0), (3, "Waste 5", 40.0), (4, "  ", 80.0), (5, None, 160.0)]
    df = spark.createDataFrame([(i, "r", "waste.total.mass", "2023", "global", None, v, v, "t", True, s) for i, s, v in rows], "claim_id long, report_id string, metric_key string, time_bucket string, location_scope string, metric_direction string, metric_value double, canonical_value double, canonical_unit string, value_plausible boolean, source_sentence string")
    got = {(r.claim_a, r.claim_b) for r in A.numeric_conflicts(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (3, 4), (1, 5), (2, 5), (3, 5), (4, 5)}


def test_links_to_reports(spark):
    html = '<a href="esg-report-2023.pdf">Our <b>report</b></a><a href="/code-of-conduct.pdf">Sustainability report policy</a><A class=x HREF=\'https://b.com/brsr.PDF\'>BRSR 2022</A><a href="annual.pdf">Annual</a><a href="net-zero.pdf">net zero plan</a><a href="esg-report.html">ESG report</a>'
    pages = spark.createDataFrame([(1, "https://a.com/ir/x.html", html), (2, "https://a.com", None), (3, None, "<a href='climate report.pdf'>x</a>")], "page_id long, url string, html string")
    got = {r.absolute: r.year for r in T.report_links(T.links(pages.where("url IS NOT NULL")), 2026).collect()}
    assert got == {"https://a.com/ir/esg-report-2023.pdf": "2023", "https://b.com/brsr.PDF": "2022", "https://a.com/ir/net-zero.pdf": "2026"}
