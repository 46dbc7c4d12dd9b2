"""Queries over single values: cleaning, parsing, keys and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import expressions as E
from claimweave.functions import scalars as S
from claimweave.operators import extraction as X
from claimweave.plans.claims import enriched
from claimweave.plans.dialect import CLAIMS, ENRICH
from claimweave.sources.tables import claims, table

#: Values of many shapes from a claim's number.
CELL = """CASE claim_id % 12 WHEN 0 THEN '-' WHEN 1 THEN '2021' WHEN 2 THEN concat('$ ', CAST(claim_id % 997 AS STRING), ',500.5 kg*') WHEN 3 THEN concat(CAST(claim_id % 50 AS STRING), ' %') WHEN 4 THEN 'N/A' WHEN 5 THEN concat('(', CAST(claim_id % 31 AS STRING), ')')
    WHEN 6 THEN concat('-', CAST(claim_id % 77 AS STRING), '.25') WHEN 7 THEN 'about ten' WHEN 8 THEN '' WHEN 9 THEN '1,2,3' WHEN 10 THEN '3 m³' ELSE concat(' ', CAST(claim_id AS STRING), ' ') END"""
DATE = """CASE claim_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN '2021' WHEN 2 THEN '2021-3-9' WHEN 3 THEN '2020/12/31' WHEN 4 THEN '2021-13-01' WHEN 5 THEN ' 2022-02-28 ' WHEN 6 THEN 'March 2021' WHEN 7 THEN '' ELSE '2021-02-30' END"""
PHRASE = """CASE claim_id % 11 WHEN 0 THEN concat('Reduced by ', CAST(claim_id % 100 AS STRING), ' percent') WHEN 1 THEN 'forty hectares restored' WHEN 2 THEN concat('1,', lpad(CAST(claim_id % 1000 AS STRING), 3, '0'), ' tonnes') WHEN 3 THEN '0.5 % lower' WHEN 4 THEN 'no figure'
    WHEN 5 THEN concat(CAST(claim_id % 13 AS STRING), '.5 GWh generated') WHEN 6 THEN 'saved 12 kl' WHEN 7 THEN '3 gw' WHEN 8 THEN 'grew to 20 employees' WHEN 9 THEN '' ELSE 'cut 7 saplings' END"""
PLACE = """CASE claim_id % 10 WHEN 0 THEN 'Global' WHEN 1 THEN 'Mumbai plant' WHEN 2 THEN 'India' WHEN 3 THEN 'Madrid\\'s Jarama riverbed' WHEN 4 THEN 'Heber Park at Hebersham' WHEN 5 THEN 'our facilities' WHEN 6 THEN 'Jarama riverbed, Madrid' WHEN 7 THEN 'abc' WHEN 8 THEN 'offshore site' ELSE 'Lake  Xochimilco' END"""
STORY = """CASE claim_id % 8 WHEN 0 THEN 'In Mumbai we planted trees' WHEN 1 THEN 'Our plant saved water' WHEN 2 THEN 'Across India' WHEN 3 THEN 'The refinery in Houston' WHEN 4 THEN 'Nothing here' WHEN 5 THEN 'Sites in South Korea, Busan' WHEN 6 THEN 'Indiana is no match' ELSE 'Offices in Paris and London' END"""
REPLY = """CASE claim_id % 8 WHEN 0 THEN concat('```json\\n[{"aspect": "water", "metric": {"value": ', CAST(claim_id AS STRING), ', "unit": "kl"}, "confidence": 1.5}]\\n```') WHEN 1 THEN concat('Here it is: {"claims": [{"aspect": "energy", "action": "cut", "location": {"raw_text": "x", "specificity": "moon"}}, {"aspect": " "}]} done')
    WHEN 2 THEN 'no json' WHEN 3 THEN '{"claims": []}' WHEN 4 THEN '[{"aspect": "waste", "confidence": -1, "location": {"specificity": "city"}}]' WHEN 5 THEN '{broken' WHEN 6 THEN NULL ELSE '[{"aspect": "a", "confidence": 0.25}, {"aspect": "b"}]' END"""
_PLACE_SQL, _REPLY_SQL = PLACE.replace("\\'", "''"), REPLY.replace("\\n", "' || chr(10) || '")


def _with(spark, d, name, sql):
    return claims(spark, d).withColumn(name, F.expr(sql))


def _one(name, sql, out):
    return lambda s, d: _with(s, d, name, sql).select("claim_id", *(F.expr(v).alias(k) for k, v in out.items()))


def metric_from_text(spark, d):
    c = _with(spark, d, "t", f"lower(trim({PHRASE}))").withColumns({"value": F.expr(S.number_named("t")), "unit": F.expr(S.unit_named("t"))}).where("t <> '' AND value IS NOT NULL")
    return c.select("claim_id", F.expr("CASE WHEN value > 0 AND value < 1 AND unit = '%' THEN value * 100 ELSE value END").alias("value"), F.expr("coalesce(unit, 'unspecified')").alias("unit"), F.expr(S.direction_named("t")).alias("direction"))


def location_gazetteer(spark, d):
    c = _with(spark, d, "t", STORY).withColumn("place", F.expr(S.place_named("t")))
    return c.select("claim_id", "place", F.expr(S.place_kind("place", "t")).alias("kind"), F.expr(S.place_country("place")).alias("country"))


def geo_pick(spark, d):
    """Hits of places are events: the best by importance among those that are ground to look at."""
    hits = table(spark, d, "events").selectExpr("user_id AS place", "event_id", "CASE event_id % 5 WHEN 0 THEN 'amenity' WHEN 1 THEN 'leisure' WHEN 2 THEN 'natural' WHEN 3 THEN 'place' ELSE 'shop' END AS class", "CASE WHEN event_id % 2 = 0 THEN 'park' ELSE 'pitch' END AS type", "value AS importance")
    good = F.col("class").isin(S.GEO_CLASSES) | ((F.col("class") == "leisure") & F.col("type").isin(S.GOOD_LEISURE))
    return hits.where(good).groupBy("place").agg(F.max_by("event_id", F.struct("importance", -F.col("event_id"))).alias("event_id"))


def json_lenient(spark, d):
    c = _with(spark, d, "reply", REPLY)
    return c.select("claim_id", F.expr(X.lenient_json("reply")).isNotNull().alias("parsed"))


def enrich_json(spark, d):
    return X.reply_claims(_with(spark, d, "reply", REPLY).select("claim_id", "reply")).select("claim_id", "aspect", "action", "value", "unit", "specificity", "confidence")


def bundle_commit(spark, d):
    """A digest of what a verdict rests on: fields in order of name as compact JSON."""
    c = claims(spark, d).select("claim_id", F.sha2(F.to_json(F.struct("claim_id", "report_id", "time_bucket")), 256).alias("bundle"))
    return c


def jsonl_roundtrip(spark, d):
    """Claims as JSON lines with a broken one after every hundredth: the broken ones go, the rest come back."""
    c = claims(spark, d).select("claim_id", "aspect", "metric_value", "source_sentence")
    line = F.to_json(F.struct("claim_id", "aspect", "metric_value", "source_sentence"))
    lines = c.select(F.explode(F.expr("CASE WHEN claim_id % 100 = 0 THEN array(true, false) ELSE array(true) END")).alias("whole"), line.alias("line"))
    torn = lines.select(F.when(F.col("whole"), F.col("line")).otherwise(F.expr("left(line, length(line) - 9)")).alias("line"))
    schema = "claim_id BIGINT, aspect STRING, metric_value DOUBLE, source_sentence STRING, torn STRING"
    back = torn.select(F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "torn"}).alias("r")).select("r.*")
    return back.where("torn IS NULL AND claim_id IS NOT NULL").drop("torn")


def reply_enrich(spark, d):
    """Model replies as whole claims: units, type, node, dates, keys, scores."""
    c = _with(spark, d, "reply", REPLY).select("claim_id", "reply", F.col("source_sentence").alias("sentence"))
    found = X.enriched_replies(c)
    return found.select("claim_id", "aspect", "normalized_aspect", "action", "claim_type", "metric_value", "metric_unit", "location_scope", "time_bucket", "metric_key", "claim_signature", "groundability", "vagueness", "confidence")


QUERIES = {
    "reply_enrich": reply_enrich,
    "parse_number": _one("t", CELL, {"value": S.parse_number("t"), "plain": S.cell_number("t")}),
    "clean_fields": _one("t", f"struct({DATE} AS d, CASE WHEN claim_id % 4 = 0 THEN ' N/A ' WHEN claim_id % 4 = 1 THEN ' Pune ' ELSE location_text END AS p)", {"date": S.clean_date("t.d"), "place": S.clean_text("t.p")}),
    "slug": _one("t", "concat('--', company_name, ' & Co. ', CAST(report_year AS STRING), '!')", {"slug": S.slug("t"), "empty": S.slug("'!!'")}),
    "metric_from_text": metric_from_text,
    "metric_normalize": _one("t", "CASE WHEN claim_id % 3 = 0 THEN 'none' WHEN claim_id % 3 = 1 THEN 'KWh' ELSE metric_unit END", {"unit": S.inferred_unit("t", "aspect", "coalesce(metric_value, 0)"), "direction": f"coalesce(metric_direction, {S.direction_named('source_sentence')})"}),
    "unit_base": _one("t", "metric_unit", {"base": S.unit_base("t")}),
    "check_key": lambda s, d: claims(s, d).select("claim_id", F.expr(S.check_key("report_id", "normalized_aspect", "location_text", "time_bucket")).alias("check_key")),
    "contra_id": lambda s, d: claims(s, d).select("claim_id", F.expr(S.short_sha1("source_sentence")).alias("contra_id")),
    "unit_id": lambda s, d: claims(s, d).select("claim_id", F.expr(f"concat('txt_', {S.short_sha1("concat_ws('|', report_id, 'txt', page_number, source_sentence)")})").alias("unit_id")),
    "metric_year": lambda s, d: claims(s, d).select("claim_id", F.expr("CASE WHEN time_bucket RLIKE '^[0-9]{4}$' THEN CAST(time_bucket AS INT) ELSE report_year END").alias("year")),
    "geocodable": _one("t", PLACE, {"geocodable": S.geocodable("t")}),
    "geo_ladder": _one("t", PLACE, {"ladder": f"array_join({S.ladder('t')}, ';')"}),
    "geo_pick": geo_pick,
    "location_gazetteer": location_gazetteer,
    "json_lenient": json_lenient,
    "enrich_json": enrich_json,
    "jsonl_roundtrip": jsonl_roundtrip,
    "bundle_commit": bundle_commit,
    "materiality": lambda s, d: enriched(s, d).select("claim_id", F.expr(E.materiality("metric_key")).alias("weight")),
}

_T = lambda sql: f"WITH {CLAIMS}, x AS (SELECT *, {sql.replace('AS STRING', 'AS VARCHAR')} AS t FROM claims)"
_DIR = "CASE WHEN t LIKE '%reduced%' OR t LIKE '%lower%' OR t LIKE '%cut%' OR t LIKE '%saved%' THEN 'decrease' WHEN t LIKE '%grew%' THEN 'increase' WHEN t LIKE '%generated%' THEN 'absolute' END"
ORACLES = {
    "parse_number": f"""{_T(CELL)}, r AS (SELECT claim_id, t, replace(regexp_extract(trim(t), '^[^0-9+-]*([-+]?[0-9][0-9,]*[.]?[0-9]*)\\s*[%a-zA-Z°/³²]*\\s*[*†‡]?$', 1), ',', '') AS raw, replace(trim(t), ',', '') AS p FROM x)
        SELECT claim_id, CASE WHEN raw <> '' AND NOT regexp_full_match(raw, '(19|20)[0-9]{{2}}') THEN CAST(raw AS DOUBLE) END AS value, TRY_CAST(nullif(p, '') AS DOUBLE) AS plain FROM r""",
    "clean_fields": f"""{_T(DATE)} SELECT claim_id, CASE WHEN regexp_full_match(t, '[0-9]{{4}}') THEN t || '-01-01' WHEN regexp_full_match(trim(t), '[0-9]{{4}}([-/])[0-9]+[-/][0-9]+') THEN CAST(TRY_CAST(replace(trim(t), '/', '-') AS DATE) AS VARCHAR) END AS date,
        CASE claim_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Pune' ELSE location_text END AS place FROM x""",
    "slug": f"WITH {CLAIMS} SELECT claim_id, 'company_' || company_id || '_co_' || report_year AS slug, 'company' AS empty FROM claims",
    "metric_from_text": f"""{_T(f'lower(trim({PHRASE}))')} SELECT claim_id, CASE claim_id % 11 WHEN 0 THEN claim_id % 100 WHEN 1 THEN 40 WHEN 2 THEN 1000 + claim_id % 1000 WHEN 3 THEN 50 WHEN 5 THEN claim_id % 13 + 0.5 WHEN 6 THEN 12 WHEN 7 THEN 3 WHEN 8 THEN 20 ELSE 7 END::DOUBLE AS value,
        CASE claim_id % 11 WHEN 0 THEN '%' WHEN 1 THEN 'hectares' WHEN 2 THEN 'tonnes' WHEN 3 THEN '%' WHEN 5 THEN 'GWh' WHEN 6 THEN 'kL' WHEN 7 THEN 'GW' WHEN 8 THEN 'employees' ELSE 'trees' END AS unit, {_DIR} AS direction FROM x WHERE claim_id % 11 NOT IN (4, 9)""",
    "metric_normalize": f"""WITH {CLAIMS}, x AS (SELECT *, CASE claim_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'KWh' ELSE metric_unit END AS t, lower(aspect) AS a, lower(source_sentence) AS s FROM claims)
        SELECT claim_id, CASE WHEN t IN ('none', '') THEN CASE WHEN a LIKE '%employ%' OR a LIKE '%work%' OR a LIKE '%diversity%' THEN CASE WHEN coalesce(metric_value, 0) > 100 THEN 'employees' ELSE 'unspecified' END WHEN a LIKE '%emissions%' THEN 'tCO2e' WHEN a LIKE '%water%' THEN 'kL' ELSE 'unspecified' END
            ELSE CASE lower(t) WHEN 'kwh' THEN 'kWh' WHEN 'kilolitres' THEN 'kL' WHEN 'mtco2e' THEN 'MtCO2e' WHEN 'tco2e' THEN 'tCO2e' WHEN 'gwh' THEN 'GWh' WHEN 'mwh' THEN 'MWh' WHEN 'tonnes' THEN 'tonnes' WHEN 'kg' THEN 'kg' WHEN 'acres' THEN 'acres' WHEN '%' THEN '%' WHEN 'employees' THEN 'employees' ELSE t END END AS unit,
            coalesce(metric_direction, CASE WHEN s LIKE '%cut%' THEN 'decrease' WHEN regexp_matches(s, 'reduced|reduction|decreased|decline|lower|saved|avoided') THEN 'decrease' WHEN regexp_matches(s, 'increase|grew|growth|higher|expanded') THEN 'increase' WHEN regexp_matches(s, 'achieved|reached|maintained|generated|produced|consumed') THEN 'absolute' END) AS direction FROM x""",
    "check_key": f"WITH {CLAIMS} SELECT claim_id, substr(sha256(report_id || '|' || normalized_aspect || '|' || coalesce(location_text, '') || '|' || time_bucket), 1, 16) AS check_key FROM claims",
    "contra_id": f"WITH {CLAIMS} SELECT claim_id, substr(sha1(source_sentence), 1, 12) AS contra_id FROM claims",
    "unit_id": f"WITH {CLAIMS} SELECT claim_id, 'txt_' || substr(sha1(report_id || '|txt|' || page_number || '|' || source_sentence), 1, 12) AS unit_id FROM claims",
    "metric_year": f"WITH {CLAIMS} SELECT claim_id, CAST(CASE WHEN time_bucket = 'unknown_time' THEN CAST(report_year AS VARCHAR) ELSE time_bucket END AS INT) AS year FROM claims",
    "unit_base": f"""WITH {CLAIMS} SELECT claim_id, CASE metric_unit WHEN '' THEN NULL WHEN 'tCO2e' THEN 'co2e_mass' WHEN 'ktCO2e' THEN 'co2e_mass' WHEN 'million tonnes CO2e' THEN 'co2e_mass' WHEN 'MtCO2e' THEN 'co2e_mass' WHEN 'gCO2e/MJ' THEN 'co2e_mass' WHEN '%' THEN 'percent'
        WHEN 'GWh' THEN 'energy' WHEN 'MWh' THEN 'energy' WHEN 'GJ per year' THEN 'energy' WHEN 'kilolitres' THEN 'volume' WHEN 'tonnes' THEN 'mass' WHEN 'kg' THEN 'mass' WHEN 'employees' THEN 'count' WHEN 'cases' THEN 'count' WHEN 'hours' THEN 'currency' WHEN 'acres' THEN 'currency' ELSE CASE WHEN metric_unit = 'INR crore' THEN 'currency' WHEN metric_unit = 'km' THEN 'other' WHEN metric_unit = 'per million hours' THEN 'currency' END END AS base FROM claims""",
    "geocodable": f"WITH {CLAIMS} SELECT claim_id, claim_id % 10 IN (1, 3, 4, 6, 9) AS geocodable FROM claims",
    "geo_ladder": f"""WITH {CLAIMS} SELECT claim_id, CASE claim_id % 10 WHEN 0 THEN 'Global' WHEN 1 THEN 'Mumbai plant;Mumbai' WHEN 2 THEN 'India' WHEN 3 THEN 'Madrid''s Jarama riverbed;Jarama riverbed, Madrid;Jarama, Madrid;Madrid''s Jarama' WHEN 4 THEN 'Heber Park at Hebersham;Hebersham' WHEN 5 THEN 'our facilities'
        WHEN 6 THEN 'Jarama riverbed, Madrid;Jarama , Madrid;Madrid' WHEN 7 THEN '' WHEN 8 THEN 'offshore site;offshore' ELSE 'Lake Xochimilco' END AS ladder FROM claims""",
    "geo_pick": """SELECT user_id AS place, event_id FROM events WHERE event_id % 5 IN (2, 3) OR (event_id % 5 = 1 AND event_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
    "location_gazetteer": f"""WITH {CLAIMS} SELECT claim_id, CASE claim_id % 8 WHEN 0 THEN 'mumbai' WHEN 2 THEN 'india' WHEN 3 THEN 'houston' WHEN 5 THEN 'busan' WHEN 7 THEN 'london' END AS place, CASE claim_id % 8 WHEN 0 THEN 'city' WHEN 1 THEN 'facility' WHEN 2 THEN 'country' WHEN 3 THEN 'city' WHEN 5 THEN 'city' WHEN 7 THEN 'city' END AS kind,
        CASE claim_id % 8 WHEN 0 THEN 'India' WHEN 2 THEN 'India' WHEN 3 THEN 'USA' WHEN 5 THEN 'South Korea' WHEN 7 THEN 'United Kingdom' END AS country FROM claims""",
    "json_lenient": f"WITH {CLAIMS} SELECT claim_id, claim_id % 8 NOT IN (2, 5, 6) AS parsed FROM claims",
    "enrich_json": f"""WITH {CLAIMS} SELECT claim_id, 'water' AS aspect, 'reported' AS action, CAST(claim_id AS DOUBLE) AS value, 'kl' AS unit, NULL AS specificity, 1e0 AS confidence FROM claims WHERE claim_id % 8 = 0
        UNION ALL SELECT claim_id, 'energy', 'cut', NULL, NULL, 'global', 0.5 FROM claims WHERE claim_id % 8 = 1 UNION ALL SELECT claim_id, 'waste', 'reported', NULL, NULL, 'city', 0 FROM claims WHERE claim_id % 8 = 4
        UNION ALL SELECT claim_id, 'a', 'reported', NULL, NULL, NULL, 0.25 FROM claims WHERE claim_id % 8 = 7 UNION ALL SELECT claim_id, 'b', 'reported', NULL, NULL, NULL, 0.5 FROM claims WHERE claim_id % 8 = 7""",
    "jsonl_roundtrip": f"WITH {CLAIMS} SELECT claim_id, aspect, metric_value, source_sentence FROM claims",
    "bundle_commit": f"""WITH {CLAIMS} SELECT claim_id, sha256('{{"claim_id":' || claim_id || ',"report_id":"' || report_id || '","time_bucket":"' || time_bucket || '"}}') AS bundle FROM claims""",
    "materiality": f"""WITH {ENRICH} SELECT claim_id, CASE split_part(metric_key, '.', 1) WHEN 'emissions' THEN 3e0 WHEN 'energy' THEN 2e0 WHEN 'water' THEN 2e0 WHEN 'waste' THEN 2e0 WHEN 'biodiversity' THEN 2e0 WHEN 'governance' THEN 1.5e0 ELSE 1e0 END AS weight FROM enriched""",
}
