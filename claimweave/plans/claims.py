"""Queries over claims: derived columns and the rule layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import vocabulary as V
from claimweave.operators import claims as C
from claimweave.plans.dialect import CLAIMS, ENRICH, GATE, GATE_ALL, PHRASES
from claimweave.sources.tables import claims, settled


def enriched(spark, d):
    """Claims with their derived columns; a query computes only those that it reads."""
    return C.enrich(claims(spark, d))


def gated(spark, d):
    return C.gate(enriched(spark, d))


_enriched, _gated = enriched, gated


def _pick(make, *columns):
    return lambda spark, d: make(spark, d).select(*columns)


def _simple(cte: str, source: str, columns: list[str], where: str = "TRUE") -> str:
    return f"WITH {cte} SELECT {', '.join(columns)} FROM {source} WHERE {where}"


def gate_aspect(spark, d):
    return _gated(spark, d).select("claim_id", "gated_aspect", "gated_key", "gated_family", "gated_signature", "aspect_flag", "route_flag")


def gate_flags(spark, d):
    return _gated(spark, d).select("claim_id", F.concat_ws(",", "quality_flags").alias("flags"))


def tags(spark, d):
    return _gated(spark, d).select("claim_id", F.concat_ws(",", "framework_tags").alias("tags"))


def gate_stats(spark, d):
    e = settled(C.gate_classes(_enriched(spark, d)))
    return C.gate_stats(C.gate(e), e)


def gate_workload(spark, d):
    return C.gate_workload(C.gate(_enriched(spark, d), keep_furniture=True))


def dedup(spark, d):
    return C.near_duplicates(claims(spark, d)).select("claim_id", "report_id")


def normalize_aspect(spark, d):
    c = claims(spark, d)
    return c.select("claim_id", "aspect").join(C.normalize_aspects(c, spark), "aspect").select("claim_id", "node")


_TAGS = "CASE gated_aspect " + " ".join(f"WHEN '{n}' THEN [{', '.join(repr(t) for t in ts)}]" for n, ts in V.FRAMEWORKS.items()) + " ELSE [] END"

QUERIES = {
    "metric_family": _pick(_enriched, "claim_id", "metric_family"),
    "unit_dimension": _pick(_enriched, "claim_id", "dimension"),
    "plausible_unit": lambda s, d: _enriched(s, d).select("claim_id", F.expr("metric_key NOT LIKE '%.unspecified'").alias("plausible")),
    "metric_key": _pick(_enriched, "claim_id", "metric_key"),
    "claim_signature": _pick(_enriched, "claim_id", "claim_signature"),
    "unit_canonical": lambda s, d: _enriched(s, d).select("claim_id", "canonical_unit", F.round("canonical_value", 6).alias("canonical_value")),
    "value_plausible": _pick(_enriched, "claim_id", "value_plausible"),
    "vagueness": _pick(_enriched, "claim_id", "vagueness"),
    "groundability": _pick(_enriched, "claim_id", "groundability", "observability"),
    "classify_type": lambda s, d: claims(s, d).select("claim_id", F.expr(C.X.classify_type("action", "source_sentence")).alias("kind")),
    "metric_direction": lambda s, d: claims(s, d).select("claim_id", F.expr(C.X.direction("source_sentence")).alias("direction")),
    "polarity": lambda s, d: _enriched(s, d).select("claim_id", F.expr(C.X.polarity("metric_key")).alias("polarity")),
    "verification_method": lambda s, d: _enriched(s, d).select("claim_id", F.expr(C.X.verification_method("observability", "metric_value")).alias("method")),
    "furniture": lambda s, d: C.derive(claims(s, d), C.GATED[:2]).select("claim_id", "is_furniture"),
    "gate_aspect": gate_aspect,
    "gate_type": _pick(_gated, "claim_id", "gated_type", "type_flag"),
    "value_in_source": lambda s, d: claims(s, d).where("metric_value IS NOT NULL").select("claim_id", C.value_in_source("metric_value", "source_sentence").alias("found")),
    "gate_flags": gate_flags,
    "framework_tags": tags,
    "gate_stats": gate_stats,
    "gate_workload": gate_workload,
    "dedup": dedup,
    "meaningful": lambda s, d: C.meaningful(claims(s, d)).select("claim_id"),
    "validate_legacy": lambda s, d: C.legacy_valid(_enriched(s, d)).select("claim_id"),
    "top5_per_chunk": lambda s, d: C.top_per_page(_enriched(s, d)).select("claim_id", "place"),
    "cleanup": lambda s, d: C.clean_up(_enriched(s, d)).select("claim_id", "location_scope"),
    "backfill_observability": lambda s, d: _enriched(s, d).withColumn("old", F.expr("CASE WHEN claim_id % 3 = 0 THEN NULL ELSE 'kept' END")).select("claim_id", F.coalesce("old", "observability").alias("observability")),
    "normalize_aspect": normalize_aspect,
    "claims_scan": _pick(_enriched, "claim_id", "groundability", "metric_key"),
    "regate": lambda s, d: _gated(s, d).select("claim_id", "report_id", "gated_key", "gated_type"),
}

from claimweave.plans.dialect import portable as _p  # noqa: E402

#: Clauses of each gated claim's node, and those that its sentence names.
KNOWN_TAGS = f"SELECT claim_id, {_TAGS} AS known, list_transform(regexp_extract_all(source_sentence, '{V.CLAUSE_CODE}', 1), lambda c: 'GRI ' || c) AS codes FROM gated"

ORACLES = {
    "metric_family": _simple(ENRICH, "enriched", ["claim_id", "metric_family"]),
    "unit_dimension": _simple(ENRICH, "enriched", ["claim_id", "dimension"]),
    "plausible_unit": _simple(ENRICH, "enriched", ["claim_id", "metric_key NOT LIKE '%.unspecified' AS plausible"]),
    "metric_key": _simple(ENRICH, "enriched", ["claim_id", "metric_key"]),
    "claim_signature": _simple(ENRICH, "enriched", ["claim_id", "metric_key || '|' || time_bucket || '|' || location_scope AS claim_signature"]),
    "unit_canonical": _simple(ENRICH, "enriched", ["claim_id", "canonical_unit", "round(canonical_value, 6) AS canonical_value"]),
    "value_plausible": _simple(ENRICH, "enriched", ["claim_id", "value_plausible"]),
    "vagueness": _simple(ENRICH, "enriched", ["claim_id", "vagueness"]),
    "groundability": _simple(ENRICH, "enriched", ["claim_id", "groundability", "observability"]),
    "classify_type": _simple(CLAIMS, "claims", ["claim_id", _p(C.X.classify_type("action", "source_sentence")) + " AS kind"]),
    "metric_direction": _simple(CLAIMS, "claims", ["claim_id", _p(C.X.direction("source_sentence")) + " AS direction"]),
    "polarity": _simple(ENRICH, "enriched", ["claim_id", _p(C.X.polarity("metric_key")) + " AS polarity"]),
    "verification_method": _simple(ENRICH, "enriched", ["claim_id", _p(C.X.verification_method("observability", "metric_value")) + " AS method"]),
    "furniture": f"WITH {CLAIMS}, s AS (SELECT *, lower(trim(source_sentence)) AS s FROM claims) SELECT claim_id, {_p(C.GATED[1][1])} AS is_furniture FROM s",
    "gate_aspect": _simple(GATE, "gated", ["claim_id", "gated_aspect", "gated_key", "gated_family", "gated_signature", "aspect_flag", "route_flag"]),
    "gate_type": _simple(GATE, "gated", ["claim_id", "gated_type", "type_flag"]),
    "value_in_source": _simple(CLAIMS, "claims", ["claim_id", r"list_contains(list_transform(regexp_extract_all(source_sentence, '\d[\d,]*(?:\.\d+)?'), lambda t: CAST(replace(t, ',', '') AS DOUBLE)), metric_value) AS found"], "metric_value IS NOT NULL"),
    "gate_flags": _simple(GATE, "gated", ["claim_id", "array_to_string(quality_flags, ',') AS flags"]),
    "framework_tags": f"""WITH {GATE}, t AS ({KNOWN_TAGS})
        SELECT claim_id, array_to_string(list_concat(known, list_filter(codes, lambda c: NOT list_contains(known, c))), ',') AS tags FROM t""",
    "gate_stats": f"WITH {GATE} SELECT flag, count(*) AS n FROM (SELECT unnest(quality_flags) AS flag FROM gated) GROUP BY flag UNION ALL SELECT 'furniture_dropped', count(*) FROM ruled_claims WHERE is_furniture",
    "gate_workload": f"""WITH {GATE_ALL} SELECT count(*) AS claims, count(*) FILTER (lower(aspect) <> normalized_aspect AND normalized_aspect <> 'uncategorized') AS mapped,
        count(*) FILTER (gated_aspect = 'uncategorized') AS uncategorized_after, count(*) FILTER (gated_aspect IS DISTINCT FROM normalized_aspect) AS aspect_changed, count(*) FILTER (gated_type IS DISTINCT FROM claim_type) AS type_changed,
        count(*) FILTER (is_furniture) AS furniture, count(*) FILTER (len(quality_flags) > 0) AS flagged, round(count(*) FILTER (len(quality_flags) > 0) / greatest(count(*), 1), 6) AS flag_rate FROM gated""",
    "dedup": f"WITH {CLAIMS} SELECT min(claim_id) AS claim_id, report_id FROM claims GROUP BY report_id, lower(aspect), lower(action), metric_value, page_number",
    "meaningful": _simple(CLAIMS, "claims", ["claim_id"], "metric_value IS NOT NULL OR time_bucket <> 'unknown_time' OR location_text IS NOT NULL"),
    "validate_legacy": f"""WITH {ENRICH}, n AS (SELECT *, len(regexp_extract_all(source_sentence, '\\b\\d{{1,3}}(?:,\\d{{3}})*(?:\\.\\d+)?\\b')) AS numbers, len(list_filter(string_split_regex(source_sentence, '\\s+'), lambda w: w <> '')) AS words FROM enriched)
        SELECT claim_id FROM n WHERE vagueness < 0.4 AND metric_value IS NOT NULL AND lower(metric_unit) NOT IN ('unspecified', 'none', 'null', '') AND numbers <= 6 AND (words = 0 OR numbers <= words * 0.5)
            AND (source_sentence ILIKE '%increase%' OR source_sentence ILIKE '%reduce%' OR source_sentence ILIKE '%decrease%' OR source_sentence ILIKE '%maintain%' OR source_sentence ILIKE '%achieve%'
                OR source_sentence ILIKE '%improve%' OR source_sentence ILIKE '%drop%' OR source_sentence ILIKE '%fall%' OR source_sentence ILIKE '%rise%')""",
    "top5_per_chunk": f"WITH {ENRICH}, r AS (SELECT claim_id, CAST(row_number() OVER (PARTITION BY report_id, page_number ORDER BY groundability DESC, claim_id) AS INTEGER) AS place FROM enriched) SELECT * FROM r WHERE place <= 5",
    "cleanup": f"""WITH {ENRICH} SELECT claim_id, coalesce(nullif(location_scope, ''), 'Global') AS location_scope FROM enriched
        WHERE (metric_value IS NULL OR coalesce(lower(metric_unit), 'none') NOT IN ('unspecified', 'none', 'null', '')) AND coalesce(vagueness, 0) <= 0.8""",
    "backfill_observability": _simple(ENRICH, "enriched", ["claim_id", "CASE WHEN claim_id % 3 = 0 THEN observability ELSE 'kept' END AS observability"]),
    "normalize_aspect": f"""WITH {CLAIMS}, m AS (SELECT a.aspect, t.node, t.place, CASE WHEN lower(trim(a.aspect)) = phrase THEN 0 WHEN regexp_matches(lower(trim(a.aspect)), '\\b' || regexp_escape(phrase) || '\\b') THEN 1
            WHEN regexp_matches(phrase, '\\b' || regexp_escape(lower(trim(a.aspect))) || '\\b') THEN 2 END AS kind, length(phrase) AS n FROM (SELECT DISTINCT aspect FROM claims) AS a, {PHRASES}),
        b AS (SELECT aspect, node, row_number() OVER (PARTITION BY aspect ORDER BY kind, CASE kind WHEN 1 THEN -n WHEN 2 THEN n ELSE 0 END, place) AS r FROM m WHERE kind IS NOT NULL)
        SELECT claim_id, coalesce(node, 'uncategorized') AS node FROM claims LEFT JOIN b ON claims.aspect = b.aspect AND r = 1""",
    "claims_scan": _simple(ENRICH, "enriched", ["claim_id", "groundability", "metric_key"]),
    "regate": _simple(GATE, "gated", ["claim_id", "report_id", "gated_key", "gated_type"]),
}
