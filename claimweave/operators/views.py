"""Roll-ups, timelines and keys that reports and pages are shown by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ui_claims(claims: DataFrame) -> DataFrame:
    """``claims`` as pages show them: status, risk, confidence, verifiability and sector from the two scores."""
    g = "coalesce(groundability, 0)"
    shown = {
        "status": f"CASE WHEN {g} > 0.8 THEN 'verified' WHEN {g} < 0.4 THEN 'gap' ELSE 'review' END",
        "risk": f"CASE WHEN {g} > 0.7 THEN 'low' WHEN {g} > 0.4 THEN 'medium' ELSE 'high' END",
        "confidence": f"CAST(floor({g} * 100 + 0.5) AS INT)",
        "verifiability": f"CAST(floor(coalesce(1 - vagueness, {g}) * 100 + 0.5) AS INT)",
        "sector": "coalesce(split_part(metric_family, '.', 1), 'Uncategorized')",
    }
    return claims.withColumns({k: F.expr(v) for k, v in shown.items()})


def company_rollup(shown: DataFrame) -> DataFrame:
    """Claims by company and report, and by status, with subtotals (report null) and the total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "review", "gap")]
    return shown.rollup("company_id", "report_id").agg(F.count("*").alias("claims"), *counts)


def metric_timeline(shown: DataFrame) -> DataFrame:
    """The first value of each family and year among claims with a value, whether any of them has the status
    ``gap``, and the unit of the family's first claim."""
    year = F.expr("CASE WHEN time_bucket RLIKE '^[0-9]{4}$' THEN time_bucket ELSE CAST(report_year AS STRING) END")
    valued = shown.where("metric_value IS NOT NULL AND metric_family IS NOT NULL").withColumn("year", year)
    points = valued.groupBy("metric_family", "year").agg(F.min_by("metric_value", "claim_id").alias("value"), F.bool_or(F.col("status") == "gap").alias("anomaly"), F.min_by("metric_unit", "claim_id").alias("unit"), F.min("claim_id").alias("at"))
    unit = F.first(F.when(F.col("unit") == "", "units").otherwise(F.coalesce("unit", F.lit("units")))).over(Window.partitionBy("metric_family").orderBy("at"))
    return points.withColumn("unit", unit).select("metric_family", "year", "value", "anomaly", "unit")


#: The facets that claims can be narrowed by, as arrays of the options of a claim.
FACETS = {
    "claim_type": "array(lower(claim_type))",
    "observability": "array(lower(observability))",
    "sector": "array(lower(sector))",
    "metric": "array(coalesce(metric_family, 'uncategorized'))",
    "framework": "framework_tags",
    "quality_flag": "quality_flags",
}


def facet_tallies(shown: DataFrame, sector: str | None = None) -> DataFrame:
    """(facet, option, n) over the options of each facet; a sector narrows the metrics only."""
    facets = dict(FACETS)
    if sector is not None:
        facets["metric"] = f"CASE WHEN lower(sector) = '{sector}' THEN {facets['metric']} ELSE array() END"
    pairs = F.expr("concat(" + ", ".join(f"transform({v}, o -> struct('{k}' AS facet, o AS option))" for k, v in facets.items()) + ")")
    return shown.select(F.explode(pairs).alias("p")).where("coalesce(p.option, '') <> ''").groupBy("p.facet", "p.option").agg(F.count("*").alias("n"))


def apply_facets(shown: DataFrame, search: str = "", status: str | None = None, quality_flag: str | None = None, min_confidence: int = 0, **wanted: str) -> DataFrame:
    """Claims that every given facet lets pass: a phrase in the texts, the status, the least confidence, a
    quality flag (``none`` for claims without any) and the options of FACETS by name."""
    out = shown
    if search.strip():
        hay = F.lower(F.concat_ws(" ", "source_sentence", "company_name", F.coalesce("location_text", F.lit("Unspecified")), "claim_id", F.coalesce("report_id", F.lit(""))))
        out = out.where(F.contains(hay, F.lit(search.strip().lower())))
    if status is not None:
        out = out.where(F.col("status") == status)
    if quality_flag is not None:
        out = out.where(F.size("quality_flags") == 0 if quality_flag == "none" else F.array_contains("quality_flags", quality_flag))
    for facet, option in wanted.items():
        out = out.where(F.expr(f"array_contains({FACETS[facet]}, '{option}')"))
    return out.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else out


def document_keys(docs: DataFrame) -> DataFrame:
    """SHA-256 of the whole text, and twelve digits of the MD5 of its first 4096 bytes."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", F.sha2(body, 256).alias("content_hash"), F.substring(F.md5(F.substring(body, 1, 4096)), 1, 12).alias("document_id"))


def first_copies(docs: DataFrame) -> DataFrame:
    """The smallest id of each text."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each user, the higher event id among equals in time."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"))
