"""Queries over evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import analytics as A
from claimweave.operators import evidence as E
from claimweave.plans.claims import enriched
from claimweave.plans.dialect import ENRICH
from claimweave.sources.tables import in_parts, settled

#: Every tenth claim that has a year and a value as a record, its value up to 8 % higher.
EVIDENCE_SQL = """SELECT company_id, replace(replace(metric_key, '.mass', '.tonnes'), '.volume', '.kl') AS metric_key, time_bucket AS year, metric_value * (100 + 2 * (claim_id % 5)) / 100e0 AS value, metric_unit AS unit,
    CASE claim_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'self_reported' WHEN 2 THEN 'illustrative' ELSE 'else' END AS quality, claim_id AS at,
    CASE WHEN claim_id % 3 = 0 THEN '' ELSE 'filing' END AS source, CASE WHEN claim_id % 7 = 0 THEN '' ELSE 'https://example.com/f' END AS url
    FROM {enriched} WHERE claim_id % 10 = 3 AND metric_value IS NOT NULL AND time_bucket <> 'unknown_time' AND metric_key <> 'uncategorized'"""


#: What claims and records meet by and are judged by.
CHECKING = "claim_id company_id report_id report_year metric_key metric_value metric_unit time_bucket claim_type canonical_value canonical_unit".split()


def evidence(spark, d, claims=None):
    return spark.sql(EVIDENCE_SQL, enriched=claims if claims is not None else settled(enriched(spark, d).select(CHECKING)))


def _both(spark, d, *more):
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*CHECKING, *more]))))
    return e, evidence(spark, d, e)


def fact_check(spark, d):
    e, records = _both(spark, d)
    return E.fact_check(e, records).select("claim_id", "verdict", "confidence", "evidence_quality", "compared", "agree")


def fact_check_summary(spark, d):
    return summarized(*_both(spark, d))


#: What flags, conflicts and scores are made of.
SCORING = "vagueness groundability metric_direction location_scope metric_family normalized_aspect source_sentence value_plausible".split()


def summarized(e, records):
    """Verdicts by report: evidence meets in parts, by company, and verdicts are summed up in parts, by report."""
    facts = in_parts(lambda c, r: E.fact_check(c, r).select("report_id", "metric_key", "verdict", "evidence_quality"), "company_id", e, records)
    return in_parts(E.fact_check_summary, "report_id", e, facts)


def score_factcheck(spark, d):
    e, records = _both(spark, d, *SCORING)
    return E.score_factcheck(A.conflicting_scores(e), summarized(e, records))


def score_satellite(spark, d):
    e = settled(enriched(spark, d).select(*CHECKING, *SCORING))
    images = e.where("claim_id % 9 = 0").select("report_id", F.expr("CASE claim_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_supported' ELSE 'inconclusive' END").alias("verdict"))
    return E.score_satellite(A.conflicting_scores(e), images)


def find_evidence(spark, d):
    e, records = _both(spark, d)
    found = E.find_evidence(e, records).groupBy("report_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("claim_u") == F.col("u")).alias("comparable"))
    return found


def evidence_merge(spark, d):
    e, records = _both(spark, d)
    named = ["company_id", "metric_key", "year", "value", "unit", "quality", "at"]
    records = records.withColumn("quality", E.quality("quality")).select(named)
    return E.merge_evidence(records.where("at % 2 = 1"), records.where("at % 2 = 0"))


QUERIES = {
    "fact_check": fact_check,
    "fact_check_summary": fact_check_summary,
    "score_factcheck": score_factcheck,
    "score_satellite": score_satellite,
    "find_evidence": find_evidence,
    "evidence_quality_tiers": lambda s, d: E.corpus_quality(evidence(s, d).withColumn("quality", E.quality("quality"))),
    "evidence_validate": lambda s, d: E.validate_evidence(evidence(s, d)).select("at", F.concat_ws(",", "errors").alias("errors")),
    "evidence_merge": evidence_merge,
}

_DIM = "CASE d WHEN 'tonnes' THEN 'mass' WHEN 'tonne' THEN 'mass' WHEN 'kilolitres' THEN 'volume' WHEN 'kl' THEN 'volume' ELSE d END"
_TO = lambda source: f"""SELECT *, {_DIM} AS dim FROM (SELECT *, list_extract(string_split(metric_key, '.'), -1) AS d, array_to_string(list_slice(string_split(metric_key, '.'), 1, -2), '.') AS asp FROM {source})"""
#: Verdicts claim by claim: canonical figures of records come from their claims, for both have one unit.
CHECKED = f"""ev AS ({EVIDENCE_SQL.replace('{enriched}', 'enriched')}),
    evc AS (SELECT ev.*, CASE WHEN c.metric_value <> 0 THEN ev.value * (c.canonical_value / c.metric_value) ELSE 0 END AS v, lower(trim(coalesce(c.canonical_unit, ''))) AS u FROM ev JOIN enriched AS c ON c.claim_id = ev.at),
    src AS ({_TO('evc')}), cl AS ({_TO("(SELECT *, lower(trim(coalesce(canonical_unit, ''))) AS u FROM enriched WHERE regexp_full_match(time_bucket, '[0-9]+'))")}),
    facts AS (SELECT company_id, NULL AS report_id, year, asp, dim, v, u, CASE WHEN quality = 'else' THEN 'unverified' ELSE quality END AS quality FROM src
        UNION ALL SELECT company_id, report_id, time_bucket, asp, dim, canonical_value, u, 'self_reported' FROM cl WHERE metric_value IS NOT NULL),
    met AS (SELECT c.claim_id, c.report_id, c.metric_key, CASE f.quality WHEN 'verified' THEN 3 WHEN 'self_reported' THEN 2 WHEN 'illustrative' THEN 1 ELSE 0 END AS q, c.u = f.u AS same,
            CASE WHEN c.u = f.u THEN CASE WHEN greatest(abs(c.canonical_value), abs(f.v)) > 1e-9 THEN abs(c.canonical_value - f.v) / greatest(abs(c.canonical_value), abs(f.v)) ELSE 0 END END AS rel
        FROM cl AS c JOIN facts AS f ON c.company_id = f.company_id AND c.time_bucket = f.year AND c.asp = f.asp AND f.report_id IS DISTINCT FROM c.report_id
            AND (c.dim = f.dim OR (c.dim = 'unspecified' OR f.dim = 'unspecified') AND c.dim IN ('co2e', 'mass', 'volume', 'count', 'energy', 'power', 'unspecified') AND f.dim IN ('co2e', 'mass', 'volume', 'count', 'energy', 'power', 'unspecified')
                OR c.dim IN ('co2e', 'mass') AND f.dim IN ('co2e', 'mass'))
        WHERE c.metric_value IS NOT NULL AND c.metric_key <> 'uncategorized' AND c.metric_key NOT LIKE '%.unspecified'),
    verdicts AS (SELECT claim_id, any_value(report_id) AS report_id, any_value(metric_key) AS metric_key, count(rel) AS compared, count(*) FILTER (rel <= 0.05) AS agree, max(q) FILTER (rel IS NOT NULL) AS q, min(rel) AS closest FROM met GROUP BY claim_id),
    fact AS (SELECT claim_id, report_id, metric_key, compared, agree, CASE q WHEN 3 THEN 'verified' WHEN 2 THEN 'self_reported' WHEN 1 THEN 'illustrative' WHEN 0 THEN 'unverified' END AS evidence_quality,
        CASE WHEN compared = 0 THEN 'UNVERIFIED' WHEN agree > 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict,
        CASE WHEN compared = 0 THEN 0.3e0 WHEN agree > 0 THEN least(6 + agree, 9.5e0) / 10 ELSE floor(least(0.55e0 + floor(closest * 1e3 + 0.5e0) / 1e3, 0.97e0) * 1e2 + 0.5e0) / 1e2 END AS confidence FROM verdicts),
    weighed AS (SELECT *, CASE WHEN metric_key LIKE 'emissions%' THEN 3e0 WHEN metric_key LIKE 'energy%' OR metric_key LIKE 'water%' OR metric_key LIKE 'waste%' OR metric_key LIKE 'biodiversity%' THEN 2e0 WHEN metric_key LIKE 'governance%' THEN 1.5e0 ELSE 1e0 END AS w FROM fact),
    summary AS (SELECT report_id, any_value(checkable) AS checkable, count(claim_id) AS checked, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'CONTRADICTED') AS contradicted, count(*) FILTER (verdict = 'UNVERIFIED') AS unverified,
            coalesce(sum(w), 0) AS w, coalesce(sum(w) FILTER (verdict = 'SUPPORTED'), 0) AS ws, coalesce(bool_or(verdict = 'CONTRADICTED' AND evidence_quality = 'verified'), FALSE) AS grave
        FROM (SELECT report_id, count(*) FILTER (metric_value IS NOT NULL AND regexp_full_match(time_bucket, '[0-9]+') AND metric_key <> 'uncategorized' AND metric_key NOT LIKE '%.unspecified') AS checkable FROM enriched GROUP BY report_id) AS t LEFT JOIN weighed USING (report_id) GROUP BY report_id),
    rates AS (SELECT report_id, checked, checkable, supported, contradicted, unverified, CASE WHEN checkable > 0 THEN floor(checked / checkable * 100 + 0.5) / 100 END AS coverage, CASE WHEN checked > 0 THEN floor(supported / checked * 100 + 0.5) / 100 END AS credibility,
        CASE WHEN w > 0 THEN floor(ws / w * 100 + 0.5) / 100 END AS weighted_credibility, grave FROM summary)"""
#: Scores of ``graded`` with the verdicts folded in.
FOLDED = """lowered AS (SELECT g.report_id, g.claims, g.score, r.*, CASE WHEN contradicted > 0 THEN floor(CASE WHEN grave THEN 50 ELSE 30 END * least(1e0, contradicted / g.claims) * 10 + 0.5) / 10 ELSE 0e0 END AS penalty FROM graded AS g LEFT JOIN (SELECT * FROM rates) AS r USING (report_id)),
    raised AS (SELECT *, CASE WHEN weighted_credibility >= 0.7 AND coverage >= 0.15 THEN floor(least(10e0, 10e0 * coverage * weighted_credibility, greatest(0e0, 100e0 - (score - penalty))) * 10 + 0.5) / 10 ELSE 0e0 END AS bonus FROM lowered),
    folded AS (SELECT report_id, claims, floor(greatest(0e0, least(100e0, score - penalty + bonus)) * 10 + 0.5) / 10 AS score, penalty, bonus FROM raised)"""
ORACLES = {
    "fact_check": f"WITH {ENRICH}, {CHECKED} SELECT claim_id, verdict, confidence, evidence_quality, compared, agree FROM fact",
    "fact_check_summary": f"WITH {ENRICH}, {CHECKED} SELECT * FROM rates",
    "evidence_quality_tiers": f"""WITH {ENRICH}, ev AS ({EVIDENCE_SQL.replace('{enriched}', 'enriched')}) SELECT count(*) AS total, count(*) FILTER (quality = 'verified') AS verified, count(*) FILTER (quality = 'self_reported') AS self_reported,
        count(*) FILTER (quality = 'illustrative') AS illustrative, count(*) FILTER (quality = 'else') AS unverified, count(*) FILTER (quality = 'verified') = 0 AND count(*) > 0 AS illustrative_only FROM ev""",
    "evidence_validate": f"""WITH {ENRICH}, ev AS ({EVIDENCE_SQL.replace('{enriched}', 'enriched')}) SELECT "at", concat_ws(',', CASE WHEN trim(unit) = '' THEN 'missing unit' END, CASE WHEN quality = 'else' THEN 'bad quality' END,
        CASE WHEN quality IN ('verified', 'self_reported') AND (source = '' OR url = '') THEN 'no citation' END) AS errors FROM ev""",
    "evidence_merge": f"""WITH {ENRICH}, ev AS ({EVIDENCE_SQL.replace('{enriched}', 'enriched')}), o AS (SELECT * REPLACE (CASE quality WHEN 'else' THEN 'unverified' ELSE quality END AS quality), 1 - "at" % 2 AS side FROM ev),
        r AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric_key, year ORDER BY quality = 'verified' DESC, side DESC, "at" DESC) AS r FROM o)
        SELECT company_id, metric_key, year, value, unit, quality, CASE side WHEN 1 THEN 'new' ELSE 'old' END AS origin FROM r WHERE r = 1""",
}
