"""Literal cases: what single expressions make of values written out here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.functions import scalars as S
from claimweave.operators import claims as C
from claimweave.operators import extraction as E


def table_of(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {columns}")


def results(df, sql):
    return [r.x for r in df.select("i", F.expr(sql).alias("x")).orderBy("i").collect()]


def check(spark, columns, cases, sql):
    df = table_of(spark, [c[:-1] for c in cases], columns)
    assert results(df, sql) == [c[-1] for c in cases]


def gated(spark, rows):
    """rows: (sentence, node, value, unit, type, source)"""
    columns = "source_sentence string, normalized_aspect string, metric_value double, metric_unit string, claim_type string, source_type string"
    df = table_of(spark, rows, columns)
    df = df.selectExpr("i AS claim_id", "*", "'x' AS aspect", "'2023' AS time_bucket", "'global' AS location_scope", "CAST(NULL AS STRING) AS location_text")
    return {r.claim_id: r for r in C.gate(C.enrich(df)).collect()}


ASPECTS = [
    ("Scope 1 emissions 120 tCO2e", "emissions.total", "emissions.scope1"), ("Scope 1 and 2 emissions 90", "emissions.scope1", "emissions.total"), ("Scope 3 emissions 15", "emissions.total", "emissions.scope3"),
    ("Particulate matter 4 mg", "emissions.total", "emissions.air_pollutants.pm"), ("NOx and SOx emissions 8", "emissions.total", "emissions.air_pollutants"), ("Scope 1 methane emissions 3", "emissions.total", "emissions.scope1"),
    ("Methane emissions 3", "emissions.total", "emissions.methane"), ("Carbon credits of 10 retired", "emissions.total", "emissions.offsets"), ("Female employees 45", "social.workforce.total", "social.diversity.gender.female"),
    ("Male and female workers 99", "social.workforce.total", "social.diversity.gender"), ("LTIFR was 0.4", "social.health_safety", "social.health_safety.ltifr"), ("Net heat rate of 2,300 kcal/kwh", "energy.total", "energy.efficiency"),
    ("Hazardous waste to landfill 15", "waste.total", "waste.landfilled"), ("Permanent workers 120", "social.workforce.total", "social.workforce.permanent"),
]


def test_aspect_cascade(spark):
    got = gated(spark, [(s, a, 5.0, "", "performance", "table") for s, a, _ in ASPECTS])
    assert [got[i].gated_aspect for i in range(len(ASPECTS))] == [w for _, _, w in ASPECTS]


def test_furniture(spark):
    long = "our performance " * 6
    rows = [
        ("Is the policy in place?", None, "text", True), ("", 1.0, "text", True), ("Number of directors", 4.0, "text", True), ("Number of directors", 4.0, "table", False), ("Total revenue", 4.0, "text", True),
        (long, 4.0, "text", False), ("Emissions were 4", 4.0, "text", False),
    ]
    got = gated(spark, [(s, "emissions.total", v, "", "performance", t) for s, v, t, _ in rows])
    assert [i not in got for i in range(len(rows))] == [gone for *_, gone in rows]


def test_types(spark):
    long = "we continue to improve our performance in every part of the company and in all regions where we operate"
    rows = [
        ("Water use 5", 5.0, "narrative", "table", "performance"), ("Water use by 2030: 5", 5.0, "performance", "table", "target"), (long, 5.0, "performance", "text", "narrative"),
        ("Water use was 5", 5.0, "narrative", "text", "performance"), ("Water use was 5", 5.0, "target", "text", "narrative"),
    ]
    got = gated(spark, [(s, "water.consumption", v, "kl", k, t) for s, v, k, t, _ in rows])
    assert [got[i].gated_type for i in range(len(rows))] == [w for *_, w in rows]


def test_flags(spark):
    got = gated(spark, [("Emissions were 3,86,71,851 tonnes", "emissions.total", 38671851.0, "tCO2e", "performance", "text"), ("Emissions were 12", "emissions.total", 13.0, "km", "performance", "text"), ("A fall to -5", "emissions.total", -5.0, "tCO2e", "performance", "text")])
    assert list(got[0].quality_flags) == []
    assert set(got[1].quality_flags) >= {"value_not_in_source", "implausible_unit"}
    assert "value_not_in_source" in got[2].quality_flags


@pytest.mark.parametrize(
    ("unit", "value", "want"),
    [("ktCO2e", 1.5, (1500.0, "tCO2e")), ("MtCO2e", 1.0, (1e6, "tCO2e")), ("mt", 2.0, (2.0, "tonnes")), ("million tonnes CO2e", 1.0, (1e6, "tCO2e")), ("tCO2e per year", 7.0, (7.0, "tCO2e")), ("gCO2e/MJ", 70.0, (70.0, "gCO2e/MJ")), ("GWh", 2.0, (2000.0, "MWh")), ("widgets", 3.0, (3.0, "widgets"))],
)
def test_canonical_units(spark, unit, value, want):
    df = table_of(spark, [(unit, value)], "u string, v double").withColumn("stem", F.expr(X.unit_stem("u")))
    row = df.select(F.expr(f"v * ({X.canonical_factor('u', 'stem')})").alias("v"), F.expr(X.canonical_unit("u", "stem")).alias("u")).first()
    assert (pytest.approx(want[0]), want[1]) == (row.v, row.u)


def test_metric_keys(spark):
    cases = [("emissions.scope1", "km", "emissions.scope1.unspecified"), ("emissions.scope1", "tCO2e/kWh", "emissions.scope1.intensity"), ("emissions.scope1", "tCO2e", "emissions.scope1.co2e"), ("uncategorized", "kg", "uncategorized"), (None, "kg", "uncategorized")]
    df = table_of(spark, [c[:-1] for c in cases], "a string, u string").withColumn("d", F.expr(X.dimension("u")))
    assert results(df, X.metric_key("a", "d")) == [c[-1] for c in cases]


def test_value_shapes(spark):
    check(spark, "k string, v double", [("a.count", 74.445, False), ("a.count", 74.0, True), ("a.percent", 5000.0, False), ("a.percent", 55.0, True), ("a.rate", -1.0, False), ("a.mass", -1.0, True), (None, 1.0, True)], X.value_plausible("k", "v"))
    check(spark, "k string, v double", [("emissions.total.co2e", 0.0, True), ("social.health_safety.fatalities.count", 0.0, False)], X.artefact_zero("k", "v"))


def test_numbers_of_cells(spark):
    cases = [("1,234.5", 1234.5), ("$ 12 kg*", 12.0), ("2021", None), ("-", None), ("n/a", None), (None, None), ("-5.25", -5.25), ("3 m³", 3.0), ("12 or 13", None), ("19999", 19999.0)]
    check(spark, "c string", cases, S.parse_number("c"))


def test_dates_and_texts(spark):
    check(spark, "d string", [("2021", "2021-01-01"), ("2021-3-9", "2021-03-09"), ("2020/12/31", "2020-12-31"), ("2021-13-01", None), ("2021-02-30", None), ("null", None), (None, None), ("March", None)], S.clean_date("d"))
    check(spark, "d string", [(" Pune ", "Pune"), ("N/A", None), ("null", None), ("", None), (None, None)], S.clean_text("d"))
    check(spark, "d string", [("Tata Power & Co.", "tata_power_co"), ("!!", "company")], S.slug("d"))


def test_units_in_words(spark):
    check(spark, "t string", [("forty hectares", 40.0), ("1,234 tonnes", 1234.0), ("nothing", None), ("two million", 2.0)], S.number_named("t"))
    check(spark, "t string", [("40 percent", "%"), ("5 gwh", "GWh"), ("12 kl", "kL"), ("five", None)], S.unit_named("t"))
    check(spark, "t string", [("tonnes / kWh", "rate"), ("tCO2e", "co2e_mass"), ("MW", "power_capacity"), ("MWh", "energy"), ("kl", "volume"), ("%", "percent"), ("", None), (None, None), ("INR crore", "currency"), ("cases", "count"), ("km", "other")], S.unit_base("t"))


def test_places(spark):
    check(spark, "p string", [("Global", False), ("Mumbai plant", True), ("India", False), ("abc", False), (None, False), ("our facilities", False), ("offshore site", False)], S.geocodable("p"))


def test_lenient_json(spark):
    cases = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("none", None), ("{broken", None), (None, None), ('{"a": 1}', '{"a": 1}')]
    check(spark, "r string", cases, E.lenient_json("r"))


def test_scores(spark):
    check(spark, "k string, c string", [("emissions.total.co2e", "x", "lower_better"), ("energy.renewable.energy", "x", "higher_better"), ("social.community.currency", "x", "neutral")], X.polarity("k"))
    check(spark, "v double, t string, p string, k string", [(None, None, None, "narrative", 1.0), (1.0, "2020", "x", "performance", 0.0), (None, "2020", None, "target", 0.8)], X.vagueness("v", "t", "p", "k"))
    check(spark, "s double", [(85.0, "A"), (84.9, "B"), (55.0, "C"), (40.0, "D"), (39.9, "F")], X.grade("s"))
