"""Queries for display and for documents and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import claims as C
from claimweave.operators import ordering as Q
from claimweave.operators import views as O
from claimweave.plans.claims import KNOWN_TAGS as _KNOWN_TAGS
from claimweave.plans.claims import enriched
from claimweave.plans.dialect import ENRICH, GATE
from claimweave.sources.tables import settled, table


def shown(spark, d):
    """Claims of the rule layer with the columns that pages show."""
    return O.ui_claims(settled(C.gate(settled(enriched(spark, d)))))


def facet_filter(spark, d):
    wanted = O.apply_facets(shown(spark, d), search="figure", status="review", quality_flag="none", min_confidence=50, claim_type="performance")
    return wanted.select("claim_id", "confidence")


def sorted_claims(spark, d):
    """All claims by value, greatest first and missing ones last, with their place and page."""
    found = Q.in_order(enriched(spark, d).select("claim_id", "company_id", "metric_value", "groundability"), "metric_value", descending=True)
    return found.withColumn("page", F.expr("(place - 1) div 20 + 1"))


def claim_pages(spark, d):
    """The third page of 1,000 claims by groundability, as the explorer reads them."""
    ordered = Q.in_order(enriched(spark, d).select("claim_id", "groundability"), "groundability", descending=True)
    return Q.page(ordered, 3, 1000)


QUERIES = {
    "sorted_claims": sorted_claims,
    "claim_pages": claim_pages,
    "ui_claim": lambda s, d: O.ui_claims(enriched(s, d)).select("claim_id", "status", "risk", "confidence", "verifiability", "sector"),
    "company_rollup": lambda s, d: O.company_rollup(O.ui_claims(enriched(s, d))),
    "metric_timeline": lambda s, d: O.metric_timeline(O.ui_claims(settled(enriched(s, d)))),
    "facets": lambda s, d: O.facet_tallies(shown(s, d), "emissions"),
    "facet_filter": facet_filter,
    "content_hash": lambda s, d: O.document_keys(table(s, d, "documents")).select("doc_id", "content_hash"),
    "document_id": lambda s, d: O.document_keys(table(s, d, "documents")).select("doc_id", "document_id"),
    "file_hash_dedup": lambda s, d: O.first_copies(table(s, d, "documents")),
    "job_state": lambda s, d: O.latest_state(table(s, d, "events")),
}
_STATUS = "CASE WHEN groundability > 0.8 THEN 'verified' WHEN groundability < 0.4 THEN 'gap' ELSE 'review' END"
_SHOWN = f"{GATE}, shown AS (SELECT *, {_STATUS} AS status, CAST(floor(groundability * 100 + 0.5) AS INT) AS confidence, split_part(metric_family, '.', 1) AS sector FROM gated)"
_TALLY = lambda facet, option, source="shown", where="TRUE": f"SELECT '{facet}' AS facet, option, count(*) AS n FROM (SELECT {option} AS option FROM {source} WHERE {where}) WHERE coalesce(option, '') <> '' GROUP BY option"
ORACLES = {
    "sorted_claims": f"WITH {ENRICH}, n AS (SELECT claim_id, company_id, metric_value, groundability, row_number() OVER (ORDER BY metric_value DESC NULLS LAST, claim_id) AS place FROM enriched) SELECT *, (place - 1) // 20 + 1 AS page FROM n",
    "claim_pages": f"WITH {ENRICH}, n AS (SELECT claim_id, groundability, row_number() OVER (ORDER BY groundability DESC NULLS LAST, claim_id) AS place FROM enriched) SELECT * FROM n WHERE place BETWEEN 2001 AND 3000",
    "ui_claim": f"""WITH {ENRICH} SELECT claim_id, {_STATUS} AS status, CASE WHEN groundability > 0.7 THEN 'low' WHEN groundability > 0.4 THEN 'medium' ELSE 'high' END AS risk,
        CAST(floor(groundability * 100 + 0.5) AS INT) AS confidence, CAST(floor((1 - vagueness) * 100 + 0.5) AS INT) AS verifiability, split_part(metric_family, '.', 1) AS sector FROM enriched""",
    "company_rollup": f"""WITH {ENRICH}, u AS (SELECT *, {_STATUS} AS status FROM enriched) SELECT company_id, report_id, count(*) AS claims, count(*) FILTER (status = 'verified') AS verified,
        count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'gap') AS gap FROM u GROUP BY ROLLUP (company_id, report_id)""",
    "metric_timeline": f"""WITH {ENRICH}, v AS (SELECT *, {_STATUS} AS status, CASE WHEN length(time_bucket) = 4 THEN time_bucket ELSE CAST(report_year AS VARCHAR) END AS year FROM enriched WHERE metric_value IS NOT NULL),
        u AS (SELECT metric_family, coalesce(nullif(arg_min(metric_unit, claim_id), ''), 'units') AS unit FROM v GROUP BY metric_family)
        SELECT metric_family, year, arg_min(metric_value, claim_id) AS value, count(*) FILTER (status = 'gap') > 0 AS anomaly, any_value(unit) AS unit FROM v JOIN u USING (metric_family) GROUP BY metric_family, year""",
    "facets": f"""WITH {_SHOWN}, tags AS (SELECT claim_id, list_distinct(list_concat(known, codes)) AS tags FROM ({_KNOWN_TAGS})) """
    + " UNION ALL ".join([_TALLY("claim_type", "lower(claim_type)"), _TALLY("observability", "observability"), _TALLY("sector", "sector"), _TALLY("metric", "metric_family", where="sector = 'emissions'"), _TALLY("framework", "unnest(tags)", "tags"), _TALLY("quality_flag", "unnest(quality_flags)")]),
    "facet_filter": f"""WITH {_SHOWN} SELECT claim_id, confidence FROM shown WHERE status = 'review' AND len(quality_flags) = 0 AND confidence >= 50 AND claim_type = 'performance'
        AND lower(concat_ws(' ', source_sentence, company_name, coalesce(location_text, 'unspecified'), claim_id, report_id)) LIKE '%figure%'""",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "document_id": "SELECT doc_id, substr(md5(CASE WHEN octet_length(encode(coalesce(text, ''))) <= 4096 THEN encode(coalesce(text, '')) ELSE array_slice(encode(text), 1, 4096) END), 1, 12) AS document_id FROM documents",
    "file_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "job_state": "SELECT user_id, state, events FROM (SELECT user_id, event_type AS state, count(*) OVER (PARTITION BY user_id) AS events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
}
