"""Queries that compare, check and score claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.operators import analytics as A
from claimweave.operators import evidence as E
from claimweave.plans.claims import enriched
from claimweave.plans.dialect import CLAIMS, ENRICH, portable
from claimweave.plans.evidence import CHECKED, FOLDED, evidence, summarized
from claimweave.sources.tables import claims, settled


#: What figures, conflicts, signatures and flags are made of.
FIGURES = "claim_id company_id report_year claim_type metric_key metric_value time_bucket canonical_value canonical_unit value_plausible".split()
CONFLICTING = "claim_id report_id metric_key time_bucket location_scope metric_direction metric_value canonical_value canonical_unit value_plausible source_sentence".split()
SIGNED = "claim_signature report_id metric_value metric_direction".split()
FLAGGING = "claim_id report_id claim_type metric_value metric_direction time_bucket location_scope vagueness groundability".split()
REPORTING = [*FLAGGING, *"company_id report_year metric_family normalized_aspect source_sentence".split()]


def _e(spark, d, *columns):
    """Enriched claims, those columns alone, written once: these queries filter and branch on derived columns."""
    return settled(enriched(spark, d).select(list(dict.fromkeys(columns))))


def _dismissed(enriched):
    return A.claim_flags(enriched).where("claim_id % 5 = 0").select("claim_id", "flag")


def integrity_score(spark, d):
    e = _e(spark, d, *REPORTING, *CONFLICTING)
    return A.conflicting_scores(e)


def integrity_reviewed(spark, d):
    e = _e(spark, d, *REPORTING, *CONFLICTING)
    return A.conflicting_scores(e, _dismissed)


def portfolio(spark, d):
    """Scores after review, with conflicts and the evidence of other reports."""
    e = _e(spark, d, *REPORTING, *CONFLICTING, "metric_unit", *FIGURES)
    return A.portfolio(e, E.score_factcheck(A.conflicting_scores(e, _dismissed), summarized(e, evidence(spark, d, e)))).select("company_id", "report_id", "report_year", "claims", "score", "grade")


def risk_score(spark, d):
    e = _e(spark, d, *REPORTING, *CONFLICTING, "observability")
    return A.risk_score(e, A.numeric_conflicts(e))


def target_gap(spark, d):
    """Every company's target is nine tenths of its last figure, five years on."""
    e = _e(spark, d, *FIGURES)
    last = A.representative(e).groupBy("company_id", "metric_key").agg(F.max_by("value", "metric_year").alias("v"), F.max("metric_year").alias("y"))
    return A.trajectory(e, last.select("company_id", "metric_key", (F.col("v") * 0.9).alias("target_value"), (F.col("y") + 5).alias("target_year")))


QUERIES = {
    "representative": lambda s, d: A.representative(_e(s, d, *FIGURES)),
    "cross_company": lambda s, d: A.cross_company(_e(s, d, *FIGURES)),
    "scorecard": lambda s, d: A.scorecard(_e(s, d, *FIGURES)),
    "trajectory": lambda s, d: A.trajectory(_e(s, d, *FIGURES)),
    "target_gap": target_gap,
    "contradictions_numeric": lambda s, d: A.numeric_conflicts(_e(s, d, *CONFLICTING)).select("report_id", "claim_a", "claim_b", "conflict", "severity", (F.col("members_a") * F.col("members_b")).alias("pairs")),
    "contradictions_signature": lambda s, d: A.signature_conflicts(_e(s, d, *SIGNED)),
    "timeline_anomaly": lambda s, d: A.timeline_anomalies(claims(s, d)),
    "claim_flags": lambda s, d: A.claim_flags(_e(s, d, *FLAGGING)).select("claim_id", "flag"),
    "greenwash_flags": lambda s, d: A.report_flags(_e(s, d, *REPORTING)).where("n > 0 AND flag <> 'ASPIRATIONAL_HEAVY'"),
    "report_flags": lambda s, d: A.report_flags(_e(s, d, *REPORTING)).where("flag IN ('DISCLOSURE_GAP', 'ASPIRATIONAL_HEAVY')"),
    "dismiss_anti": lambda s, d: (lambda e: A.report_flags(e, _dismissed(e)).where("n > 0 AND flag <> 'ASPIRATIONAL_HEAVY'").select("report_id", "flag", "n"))(_e(s, d, *REPORTING)),
    "integrity_score": integrity_score,
    "integrity_reviewed": integrity_reviewed,
    "portfolio": portfolio,
    "risk_score": risk_score,
}

_KEY = "metric_key <> 'uncategorized' AND metric_key NOT LIKE '%.unspecified'"
_REP = f"""{ENRICH}, shown AS (SELECT *, CASE WHEN regexp_matches(time_bucket, '^[0-9]{{4}}$') THEN CAST(time_bucket AS INT) ELSE report_year END AS metric_year, coalesce(canonical_unit, '') AS unit FROM enriched
        WHERE metric_value IS NOT NULL AND claim_type <> 'narrative' AND value_plausible AND NOT {portable(X.artefact_zero('metric_key', 'metric_value'))}),
    by_unit AS (SELECT company_id, metric_key, metric_year, unit, count(*) AS n, median(canonical_value) AS v FROM shown GROUP BY ALL),
    rep AS (SELECT company_id, metric_key, metric_year, unit, round(v, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY company_id, metric_key, metric_year ORDER BY n DESC, unit) AS r FROM by_unit) WHERE r = 1)"""
_PEERS = f"""{_REP}, latest AS (SELECT company_id, metric_key, metric_year, unit, value FROM (SELECT *, row_number() OVER (PARTITION BY company_id, metric_key ORDER BY metric_year DESC) AS r FROM rep) WHERE r = 1),
    modal AS (SELECT metric_key, unit FROM (SELECT metric_key, unit, row_number() OVER (PARTITION BY metric_key ORDER BY count(*) DESC, unit DESC) AS r FROM latest GROUP BY metric_key, unit) WHERE r = 1),
    kept AS (SELECT l.*, {portable(X.polarity('metric_key'))} AS polarity FROM latest AS l JOIN modal USING (metric_key, unit)),
    whole AS (SELECT *, CAST(round(value * 10000) AS BIGINT) AS tenk FROM kept),
    stats AS (SELECT metric_key, count(*) AS peers, CAST(2 * median(tenk) AS BIGINT) AS med2 FROM whole GROUP BY metric_key),
    cross_c AS (SELECT k.metric_key, k.company_id, metric_year, unit, value, polarity,
        CAST(row_number() OVER (PARTITION BY k.metric_key ORDER BY CASE polarity WHEN 'higher_better' THEN -value ELSE value END, k.company_id) AS INT) AS rank,
        CAST(CASE WHEN peers = 1 THEN 100 ELSE floor((SELECT count(*) FROM kept AS o WHERE o.metric_key = k.metric_key AND CASE k.polarity WHEN 'higher_better' THEN o.value < k.value ELSE o.value > k.value END) * 100 / (peers - 1) + 0.5) END AS INT) AS percentile,
        floor((2 * tenk - med2 + 1) / 2) / 1e4 AS vs_median, floor((med2 + 1) / 2) / 1e4 AS median, peers, CASE WHEN peers < 3 THEN 'low' ELSE 'ok' END AS confidence
        FROM whole AS k JOIN stats USING (metric_key))"""
_STATE = r"trim(regexp_replace(regexp_replace(lower(source_sentence), '[0-9]|[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))"
#: Claims of one report, pair by pair; alike ones are named by the least of them.
CONFLICTS = f"""{ENRICH}, cand AS MATERIALIZED (SELECT *, {_STATE} AS statement, coalesce(lower(trim(canonical_unit)), '') AS u FROM enriched WHERE {_KEY} AND value_plausible AND time_bucket <> 'unknown_time'),
    named AS MATERIALIZED (SELECT *, min(claim_id) OVER (PARTITION BY report_id, metric_key, time_bucket, location_scope, statement, canonical_value, u, metric_direction) AS name FROM cand),
    pr AS (SELECT a.report_id, least(a.name, b.name) AS claim_a, greatest(a.name, b.name) AS claim_b, a.location_scope = b.location_scope AS same, a.statement = b.statement OR a.statement = '' OR b.statement = '' AS said,
            coalesce(abs(a.canonical_value) > 1e-9 AND abs(b.canonical_value) > 1e-9 AND abs(a.canonical_value - b.canonical_value) / greatest(abs(a.canonical_value), abs(b.canonical_value)) > 0.05, FALSE) AS apart,
            coalesce((a.metric_direction = 'increase' AND b.metric_direction = 'decrease') OR (a.metric_direction = 'decrease' AND b.metric_direction = 'increase'), FALSE) AS turned
        FROM named AS a JOIN named AS b ON a.report_id = b.report_id AND a.metric_key = b.metric_key AND a.time_bucket = b.time_bucket AND a.claim_id < b.claim_id WHERE a.u = '' OR b.u = '' OR a.u = b.u),
    judged AS MATERIALIZED (SELECT report_id, claim_a, claim_b, CASE WHEN apart THEN CASE WHEN NOT said THEN NULL WHEN same THEN 'Metric' ELSE 'Scope' END WHEN same AND turned THEN 'Hard' END AS conflict FROM pr),
    conflicts AS MATERIALIZED (SELECT report_id, claim_a, claim_b, conflict, CASE conflict WHEN 'Metric' THEN 'High' WHEN 'Scope' THEN 'Low' ELSE 'Critical' END AS severity, count(*) AS pairs
        FROM judged WHERE conflict IS NOT NULL GROUP BY report_id, claim_a, claim_b, conflict)"""
_FLAGGED = """flagged AS MATERIALIZED (
        SELECT claim_id, report_id, 'VAGUE' AS flag FROM enriched WHERE vagueness >= 0.6
        UNION ALL SELECT claim_id, report_id, 'UNSUBSTANTIATED_TARGET' FROM enriched WHERE claim_type = 'target' AND (metric_value IS NULL OR time_bucket = 'unknown_time')
        UNION ALL SELECT claim_id, report_id, 'MISSING_BASELINE' FROM enriched WHERE claim_type = 'performance' AND metric_direction IN ('increase', 'decrease') AND time_bucket = 'unknown_time'
        UNION ALL SELECT claim_id, report_id, 'NON_GROUNDABLE' FROM enriched WHERE groundability < 0.4
        UNION ALL SELECT claim_id, report_id, 'SELECTIVE_SCOPE' FROM enriched WHERE metric_value IS NOT NULL AND location_scope <> 'global')"""
_TOTALS = """totals AS MATERIALIZED (SELECT report_id, count(*) AS total, count(*) FILTER (claim_type = 'performance') AS done, count(*) FILTER (claim_type <> 'performance') AS promised,
        bool_or(metric_family LIKE 'emissions%') AS emits, bool_or(normalized_aspect LIKE 'emissions.scope3%' OR lower(source_sentence) LIKE '%scope 3%') AS scope3 FROM enriched GROUP BY report_id)"""


def _flag_sql(where: str = "TRUE") -> str:
    return f"""{_FLAGGED}, {_TOTALS},
    counted AS (SELECT report_id, flag, count(*) AS n FROM flagged WHERE {where} GROUP BY report_id, flag),
    claimed AS (SELECT report_id, flag, CASE WHEN flag = 'VAGUE' AND floor(n * 100 / total + 0.5) >= 30 OR flag = 'UNSUBSTANTIATED_TARGET' AND n >= 3 OR flag = 'NON_GROUNDABLE' AND floor(n * 100 / total + 0.5) >= 40 THEN 'High' ELSE 'Medium' END AS severity, n, total
        FROM counted JOIN totals USING (report_id)),
    structural AS MATERIALIZED (SELECT report_id, 'DISCLOSURE_GAP' AS flag, 'High' AS severity, 0 AS n, total FROM totals WHERE emits AND NOT scope3
        UNION ALL SELECT report_id, 'ASPIRATIONAL_HEAVY', 'Medium', promised, total FROM totals WHERE total >= 10 AND done > 0 AND promised / done >= 2)"""


def _score_sql(flags: str) -> str:
    return f"""scored AS (SELECT report_id, total AS claims, round(greatest(0, least(100, 100 - coalesce(p, 0))), 1) AS score FROM totals LEFT JOIN (
        SELECT report_id, sum(round(CASE severity WHEN 'Critical' THEN 50 WHEN 'High' THEN 30 WHEN 'Medium' THEN 16 ELSE 6 END * CASE WHEN n > 0 THEN least(1.0, CAST(n AS DOUBLE) / total) ELSE 0.5 END, 1)) AS p FROM ({flags}) GROUP BY report_id) USING (report_id)),
    graded AS (SELECT report_id, claims, score, {X.grade('score')} AS grade, CASE WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Moderate' ELSE 'High' END AS risk FROM scored)"""


_BOTH = "SELECT * FROM claimed UNION ALL SELECT * FROM structural"
WITH_CONFLICTS = f"{_BOTH} UNION ALL SELECT c.report_id, 'CONTRADICTION', CASE WHEN bool_or(severity IN ('Critical', 'High')) THEN 'Critical' ELSE 'Medium' END, CAST(sum(pairs) AS BIGINT), any_value(total) FROM conflicts AS c JOIN totals USING (report_id) GROUP BY c.report_id"
_MOVED = f"{_REP}, t AS (SELECT company_id, metric_key, min(metric_year) AS first_year, max(metric_year) AS last_year, arg_min(value, metric_year) AS a, arg_max(value, metric_year) AS b, count(*) AS points FROM rep GROUP BY company_id, metric_key HAVING count(*) > 1)"
ORACLES = {
    "representative": f"WITH {_REP} SELECT * FROM rep",
    "cross_company": f"WITH {_PEERS} SELECT * FROM cross_c",
    "scorecard": f"WITH {_PEERS} SELECT company_id, metric_key, rank, peers, percentile, CASE WHEN percentile >= 66 THEN 'leading' WHEN percentile <= 33 THEN 'lagging' ELSE 'mid-pack' END AS verdict FROM cross_c WHERE peers >= 2 AND {_KEY}",
    "trajectory": f"""WITH {_MOVED} SELECT company_id, metric_key, first_year, last_year, points, round(b - a, 4) AS change, CASE WHEN a <> 0 THEN round((b - a) * 100 / abs(a), 1) END AS change_pct, round((b - a) / (last_year - first_year), 4) AS per_year,
            CASE WHEN a > 0 AND b > 0 THEN round(pow(b / a, 1 / (last_year - first_year)) - 1, 4) END AS cagr, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS trend FROM t""",
    "target_gap": f"""WITH {_MOVED}, g AS (SELECT *, b * 0.9 - b AS gap, (b * 0.9 - b) / 5 AS need, round((b - a) / (last_year - first_year), 4) AS per_year, {portable(X.polarity('metric_key'))} AS polarity FROM t)
        SELECT company_id, metric_key, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS trend, per_year, floor(gap * 1e4 + 0.5) / 1e4 AS gap, floor(need * 1e4 + 0.5) / 1e4 AS required_per_year,
            CASE polarity WHEN 'lower_better' THEN per_year <= need WHEN 'higher_better' THEN per_year >= need END AS on_track FROM g""",
    "contradictions_numeric": f"WITH {CONFLICTS} SELECT * FROM conflicts",
    "contradictions_signature": f"""WITH {ENRICH}, v AS (SELECT claim_id, claim_signature, report_id, metric_value, CASE WHEN metric_direction = 'increase' THEN 1 WHEN metric_direction = 'decrease' THEN -1 ELSE 0 END AS way
            FROM (SELECT *, metric_key || '|' || time_bucket || '|' || location_scope AS claim_signature FROM enriched)),
        p AS (SELECT a.claim_id, a.claim_signature, a.report_id, a.metric_value, a.way, a.way * b.way = -1 AS turned, coalesce(abs(a.metric_value - b.metric_value) / greatest(abs(a.metric_value), abs(b.metric_value), 1) * 100 > 30, FALSE) AS apart
            FROM v AS a JOIN v AS b ON a.claim_signature = b.claim_signature AND a.report_id <> b.report_id),
        m AS (SELECT claim_signature, report_id, metric_value, way, count(DISTINCT claim_id) AS members, count(*) FILTER (turned) AS turned, count(*) FILTER (apart) AS apart, count(*) FILTER (turned OR apart) AS links FROM p GROUP BY ALL)
        SELECT claim_signature, report_id, metric_value, way, members, turned // members AS turned, apart // members AS apart, links // members AS links FROM m WHERE links > 0""",
    "timeline_anomaly": f"""WITH {CLAIMS}, f AS (SELECT company_id, normalized_aspect, report_year, arg_min(metric_value, claim_id) AS v, min_by(struct_pack(d := metric_direction), claim_id).d AS metric_direction FROM claims WHERE metric_value IS NOT NULL GROUP BY ALL),
        w AS (SELECT *, lag(v) OVER y AS b, lag(report_year) OVER y AS year_from FROM f WINDOW y AS (PARTITION BY company_id, normalized_aspect ORDER BY report_year))
        SELECT company_id, normalized_aspect, year_from, report_year AS year_to, b AS value_from, v AS value_to, metric_direction FROM w WHERE b <> 0 AND v <> 0 AND ((metric_direction = 'increase' AND v < b) OR (metric_direction = 'decrease' AND v > b))""",
    "claim_flags": f"WITH {ENRICH}, {_FLAGGED} SELECT claim_id, flag FROM flagged",
    "greenwash_flags": f"WITH {ENRICH}, {_flag_sql()} SELECT * FROM claimed",
    "report_flags": f"WITH {ENRICH}, {_flag_sql()} SELECT * FROM structural",
    "dismiss_anti": f"WITH {ENRICH}, {_flag_sql('claim_id % 5 <> 0')} SELECT report_id, flag, n FROM claimed",
    "integrity_score": f"WITH {CONFLICTS}, {_flag_sql()}, {_score_sql(WITH_CONFLICTS)} SELECT * FROM graded",
    "integrity_reviewed": f"WITH {CONFLICTS}, {_flag_sql('claim_id % 5 <> 0')}, {_score_sql(WITH_CONFLICTS)} SELECT * FROM graded",
    "portfolio": f"""WITH {CONFLICTS}, {_flag_sql('claim_id % 5 <> 0')}, {_score_sql(WITH_CONFLICTS)}, {CHECKED}, {FOLDED}, l AS (SELECT company_id, arg_max(report_id, report_year) AS report_id, max(report_year) AS report_year FROM enriched GROUP BY company_id)
        SELECT company_id, report_id, report_year, claims, score, {X.grade('score')} AS grade FROM l LEFT JOIN folded USING (report_id)""",
    "risk_score": f"""WITH {CONFLICTS}, s AS (SELECT report_id, count(*) AS n, count(*) FILTER (vagueness >= 0.4) AS vague, count(*) FILTER (claim_type = 'narrative') AS narrative, count(*) FILTER (metric_value IS NULL) AS missing FROM enriched GROUP BY report_id),
        j AS (SELECT s.*, coalesce(c.n, 0) AS conflicts, least(1e0, (4 * vague + 3 * coalesce(c.n, 0) + 2 * narrative + missing) / (10 * s.n)) AS risk FROM s LEFT JOIN (SELECT report_id, CAST(sum(pairs) AS BIGINT) AS n FROM conflicts GROUP BY report_id) AS c USING (report_id))
        SELECT report_id, vague, narrative, missing, conflicts, risk, CASE WHEN risk > 0.6 THEN 'High Risk' WHEN risk > 0.3 THEN 'Moderate Risk' ELSE 'Low Risk' END AS status FROM j""",
}
PLAIN = f"{ENRICH}, {_flag_sql()}, {_score_sql(_BOTH)}"
WHOLE = f"{CONFLICTS}, {_flag_sql()}, {_score_sql(WITH_CONFLICTS)}"
ORACLES |= {
    "score_factcheck": f"WITH {WHOLE}, {CHECKED}, {FOLDED} SELECT report_id, claims, score, {X.grade('score')} AS grade, penalty, bonus FROM folded",
    "score_satellite": f"""WITH {WHOLE}, seen AS (SELECT report_id, count(*) FILTER (claim_id % 4 = 0) AS sup, count(*) FILTER (claim_id % 4 = 1) AS con, count(*) AS checked FROM enriched WHERE claim_id % 9 = 0 GROUP BY report_id),
        j AS (SELECT report_id, claims, score, coalesce(checked, 0) AS checked, coalesce(sup, 0) AS supported, coalesce(con, 0) AS not_supported, floor(50 * least(1e0, coalesce(con, 0) / claims) * 10 + 0.5) / 10 AS penalty FROM graded LEFT JOIN seen USING (report_id)),
        k AS (SELECT *, floor(least(5e0, 2e0 * supported, greatest(0e0, 100e0 - (score - penalty))) * 10 + 0.5) / 10 AS bonus FROM j)
        SELECT report_id, checked, supported, not_supported, penalty, bonus, floor(greatest(0e0, least(100e0, score - penalty + bonus)) * 10 + 0.5) / 10 AS score FROM k""",
}
