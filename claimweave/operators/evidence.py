"""Evidence: records about a company's figures, verdicts on claims, and what they do to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.functions import vocabulary as V
from claimweave.operators.claims import derive
from claimweave.sources.tables import settled

#: Older names of dimensions, and the dimensions that one quantity may be written in.
OLD_DIMENSIONS = {"tonnes": "mass", "tonne": "mass", "kilolitres": "volume", "kl": "volume"}
DIMENSION_CLASSES = [("co2e", "mass", "unspecified"), ("volume", "unspecified"), ("mass", "unspecified"), ("count", "unspecified"), ("energy", "unspecified"), ("power", "unspecified")]
#: How far apart figures may be to agree, and the bonus for claims that stand up to evidence.
TOLERANCE, BONUS, BONUS_CREDIBILITY, BONUS_COVERAGE = 0.05, 10.0, 0.7, 0.15
#: Points for a satellite image that confirms a claim, in all at most, and for one against it.
SATELLITE_BONUS, SATELLITE_CAP, SATELLITE_PENALTY = 2.0, 5.0, 50.0
#: Trust tiers, best first.
TIERS = sorted(V.QUALITY_RANK, key=V.QUALITY_RANK.__getitem__, reverse=True)
CHECKABLE = "metric_value IS NOT NULL AND year IS NOT NULL AND coalesce(metric_key, '') NOT IN ('', 'uncategorized') AND metric_key NOT LIKE '%.unspecified'"


def half_up(value: str, places: int) -> str:
    """SQL that rounds to decimal places, ties up, alike in every engine."""
    return f"(floor(({value}) * 1e{places} + 0.5e0) / 1e{places})"


def quality(column: str) -> Column:
    """The trust tier of a record; anything else is unverified."""
    q = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return F.when(q.isin(TIERS), q).otherwise("unverified")


def load_evidence(spark, path: str) -> DataFrame:
    """Evidence records from JSON, either ``{"records": [...]}`` or a bare list with an inline schema record.
    Records without a company are dropped and unknown tiers become unverified."""
    record = "company_id string, metric_key string, year string, value double, unit string, statement string, source string, url string, quality string"
    raw = spark.read.schema(f"{record}, records array<struct<{', '.join(f.replace(' ', ': ', 1) for f in record.split(', '))}>>").json(path, multiLine=True)
    flat = raw.where("records IS NULL").drop("records")
    nested = raw.select(F.explode("records").alias("r")).select("r.*")
    kept = flat.unionByName(nested).where("coalesce(company_id, '') NOT IN ('', '_schema')")
    return kept.withColumn("quality", quality("quality"))


def corpus_quality(evidence: DataFrame) -> DataFrame:
    """How many records each trust tier has, and whether none is verified."""
    counts = [F.count_if(F.col("quality") == t).alias(t) for t in TIERS]
    return evidence.agg(F.count("*").alias("total"), *counts).withColumn("illustrative_only", F.expr("verified = 0 AND total > 0"))


def _key_parts(df: DataFrame) -> DataFrame:
    """``df`` with the aspect and dimension of its metric key; a year is kept only if it is one."""
    last = "substring_index(metric_key, '.', -1)"
    dim = f"CASE WHEN NOT contains(metric_key, '.') THEN '' {' '.join(f"WHEN {last} = '{k}' THEN '{v}'" for k, v in OLD_DIMENSIONS.items())} ELSE {last} END"
    aspect = f"CASE WHEN contains(metric_key, '.') THEN left(metric_key, length(metric_key) - length({last}) - 1) ELSE metric_key END"
    return df.withColumns({"key_aspect": F.expr(aspect), "key_dim": F.expr(dim), "year": F.expr("CASE WHEN trim(year) RLIKE '^[0-9]+$' THEN trim(year) END")})


def _canonical(df: DataFrame) -> DataFrame:
    return derive(df, [("stem", X.unit_stem("unit")), ("u", f"lower(trim(coalesce({X.canonical_unit('unit', 'stem')}, '')))"), ("v", f"value * ({X.canonical_factor('unit', 'stem')})")]).drop("stem")


def keys_match(a: str, b: str) -> str:
    """SQL of whether two dimensions of one aspect denote the same quantity."""
    both = [f"({a}.key_dim IN {c} AND {b}.key_dim IN {c})" for c in DIMENSION_CLASSES]
    return f"({a}.key_dim = {b}.key_dim OR {' OR '.join(both)})"


def find_evidence(claims: DataFrame, external: DataFrame) -> DataFrame:
    """(claim class, evidence class) pairs: a company's records and its claims in other reports about the same
    quantity and year.

    Claims alike in report, key, year, value and unit are one class and so are records, each with its number of
    ``members``; so a figure that is repeated many times meets another one once.
    """
    own = claims.select("company_id", "report_id", "metric_key", F.col("time_bucket").alias("year"), F.col("metric_value").alias("value"), F.coalesce("metric_unit", F.lit("")).alias("unit"))
    own = own.where("coalesce(metric_key, '') <> ''").groupBy("company_id", "report_id", "metric_key", "year", "value", "unit").agg(F.count("*").alias("members"))
    own = settled(_canonical(_key_parts(own)).where("year IS NOT NULL"))  # both sides of the join begin with it
    peers = own.where("value IS NOT NULL").select("company_id", "report_id", "year", "key_aspect", "key_dim", "v", "u", F.lit("self_reported").alias("quality"), "members")
    records = external.select("company_id", F.lit(None).cast("string").alias("report_id"), "metric_key", F.col("year").cast("string").alias("year"), F.col("value").cast("double").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), quality("quality").alias("quality"))
    records = records.groupBy("company_id", "report_id", "metric_key", "year", "value", "unit", "quality").agg(F.count("*").alias("members"))
    records = _canonical(_key_parts(records)).select("company_id", "report_id", "year", "key_aspect", "key_dim", "v", "u", "quality", "members")
    e = peers.unionByName(records).alias("e")
    on = "c.company_id = e.company_id AND c.year = e.year AND c.key_aspect = e.key_aspect AND (e.report_id IS NULL OR e.report_id <> c.report_id) AND " + keys_match("c", "e")
    named = ["company_id", "report_id", "metric_key", "year", "value", "unit"]
    return own.alias("c").join(e, F.expr(on)).select(*(f"c.{n}" for n in named), F.col("c.v").alias("claim_v"), F.col("c.u").alias("claim_u"), F.col("e.v").alias("v"), F.col("e.u").alias("u"), "e.quality", "e.members")


def fact_check(claims: DataFrame, external: DataFrame) -> DataFrame:
    """A verdict on every claim that can be checked and has evidence: supported if a figure in its unit is
    within 5 %, contradicted if all are further off, unverified if none can be compared."""
    found = find_evidence(claims, external).withColumn("top", F.expr("greatest(abs(claim_v), abs(v))"))
    rel = "CASE WHEN claim_v IS NOT NULL AND v IS NOT NULL AND claim_u = u THEN CASE WHEN top > 1e-9 THEN abs(claim_v - v) / top ELSE 0e0 END END"
    rank = "CASE quality " + " ".join(f"WHEN '{q}' THEN {r}" for q, r in V.QUALITY_RANK.items()) + " END"
    named = ["company_id", "report_id", "metric_key", "year", "value", "unit"]
    judged = found.withColumns({"rel": F.expr(rel), "rank": F.expr(rank)}).groupBy(*named).agg(
        F.expr("coalesce(sum(members) FILTER (WHERE rel IS NOT NULL), 0)").alias("compared"), F.expr(f"coalesce(sum(members) FILTER (WHERE rel <= {TOLERANCE}), 0)").alias("agree"),
        F.min("rel").alias("closest"), F.expr("max(rank) FILTER (WHERE rel IS NOT NULL)").alias("rank"),
    )
    closest = half_up("closest", 3)
    tier = "CASE rank " + " ".join(f"WHEN {r} THEN '{q}'" for q, r in V.QUALITY_RANK.items()) + " END"
    verdict = judged.select(
        *(F.col(n).alias(f"__{n}") for n in named), "compared", "agree", F.expr(tier).alias("evidence_quality"),
        F.expr("CASE WHEN compared = 0 THEN 'UNVERIFIED' WHEN agree > 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END").alias("verdict"),
        F.expr(f"CASE WHEN compared = 0 THEN 0.3e0 WHEN agree > 0 THEN least(6 + agree, 9.5e0) / 10 ELSE {half_up(f'least(0.55e0 + {closest}, 0.97e0)', 2)} END").alias("confidence"),
    )
    c = claims.withColumn("year", F.expr("CASE WHEN trim(time_bucket) RLIKE '^[0-9]+$' THEN trim(time_bucket) END")).where(CHECKABLE)
    left = {"value": c["metric_value"], "unit": F.coalesce(c["metric_unit"], F.lit(""))}
    on = [left.get(n, c[n] if n in c.columns else None) == verdict[f"__{n}"] for n in named]
    return c.join(verdict, on).select("claim_id", "report_id", "metric_key", "year", "verdict", "confidence", "evidence_quality", "compared", "agree")


def fact_check_summary(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """By report: claims checked and checkable, coverage, verdicts, and credibility, plain and by materiality."""
    year = F.expr("CASE WHEN trim(time_bucket) RLIKE '^[0-9]+$' THEN trim(time_bucket) END")
    every = claims.withColumn("year", year).groupBy("report_id").agg(F.expr(f"count_if({CHECKABLE})").alias("checkable"))
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("SUPPORTED", "CONTRADICTED", "UNVERIFIED")]
    weight = F.expr(X.materiality("metric_key"))
    verified = F.bool_or((F.col("verdict") == "CONTRADICTED") & (F.col("evidence_quality") == "verified"))
    some = facts.groupBy("report_id").agg(F.count("*").alias("checked"), *counts, F.sum(weight).alias("w"), F.sum(F.when(F.col("verdict") == "SUPPORTED", weight).otherwise(0.0)).alias("ws"), verified.alias("grave"))
    joined = every.join(some, "report_id", "left").fillna(0, ["checked", "supported", "contradicted", "unverified"])
    ratio = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN {half_up(f'{a} / {b}', 2)} END")
    return joined.select("report_id", "checked", "checkable", "supported", "contradicted", "unverified", ratio("checked", "checkable").alias("coverage"), ratio("supported", "checked").alias("credibility"), ratio("ws", "w").alias("weighted_credibility"), F.coalesce("grave", F.lit(False)).alias("grave"))


def score_factcheck(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Scores (report_id, claims, score) with evidence folded in: contradicted claims cost by how many of
    all there are, more if verified evidence is against one; credible and covered reports earn a bonus."""
    s = scores.select("report_id", "claims", "score").join(summary, "report_id", "left")
    points = half_up("CASE WHEN grave THEN 50e0 ELSE 30e0 END * least(1e0, contradicted / claims)", 1)
    s = s.withColumn("penalty", F.expr(f"CASE WHEN contradicted > 0 THEN {points} ELSE 0e0 END")).withColumn("low", F.expr("score - penalty"))
    bonus = half_up(f"least({BONUS}, {BONUS} * coverage * weighted_credibility, greatest(0e0, 100e0 - low))", 1)
    s = s.withColumn("bonus", F.expr(f"CASE WHEN weighted_credibility >= {BONUS_CREDIBILITY} AND coverage >= {BONUS_COVERAGE} THEN {bonus} ELSE 0e0 END"))
    s = s.withColumn("score", F.expr(half_up("greatest(0e0, least(100e0, low + bonus))", 1)))
    return s.select("report_id", "claims", "score", F.expr(X.grade("score")).alias("grade"), "penalty", "bonus")


def score_satellite(scores: DataFrame, images: DataFrame) -> DataFrame:
    """Scores with verdicts of satellite images (report_id, verdict) folded in."""
    seen = images.groupBy("report_id").agg(F.count_if(F.col("verdict") == "supported").alias("sup"), F.count_if(F.col("verdict") == "not_supported").alias("con"), F.count("*").alias("checked"))
    s = scores.select("report_id", "claims", "score").join(seen, "report_id", "left").fillna(0, ["sup", "con", "checked"])
    s = s.withColumn("penalty", F.expr(half_up(f"{SATELLITE_PENALTY} * least(1e0, con / claims)", 1))).withColumn("low", F.expr("score - penalty"))
    s = s.withColumn("bonus", F.expr(half_up(f"least({SATELLITE_CAP}, {SATELLITE_BONUS} * sup, greatest(0e0, 100e0 - low))", 1)))
    return s.select("report_id", "checked", F.col("sup").alias("supported"), F.col("con").alias("not_supported"), "penalty", "bonus", F.expr(half_up("greatest(0e0, least(100e0, low + bonus))", 1)).alias("score"))


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record for each company, metric and year: the new one replaces the old one in place, except that a
    verified record stands against one of a lesser tier. The last of several new records counts.

    Both have ``at``, the place of a record in its sheet.
    """
    key = ["company_id", "metric_key", "year"]
    rank = F.expr("CASE quality " + " ".join(f"WHEN '{q}' THEN {r}" for q, r in V.QUALITY_RANK.items()) + " END")
    sides = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    body = F.struct("value", "unit", "quality", "side")
    grave = F.max(F.when(rank == V.QUALITY_RANK["verified"], F.struct("side", "at"))).alias("grave")
    best = F.max_by(body, F.when(rank == V.QUALITY_RANK["verified"], F.struct("side", "at"))).alias("verified")
    picked = sides.groupBy(*key).agg(grave, best, F.max_by(body, F.struct("side", "at")).alias("last"))
    chosen = picked.select(*key, F.when(F.col("grave").isNotNull(), F.col("verified")).otherwise(F.col("last")).alias("r"))
    return chosen.select(*key, "r.value", "r.unit", "r.quality", F.when(F.col("r.side") == 1, "new").otherwise("old").alias("origin"))


def validate_evidence(sheet: DataFrame) -> DataFrame:
    """``sheet`` with ``errors``: what is missing or malformed in each row; trusted tiers must cite a source."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    checks = [F.when(blank(c), f"missing {c}") for c in ("company_id", "metric_key", "year", "value", "unit")]
    checks.append(F.when(~blank("year") & ~F.col("year").cast("string").rlike(r"^(19|20)\d{2}$"), "bad year"))
    checks.append(F.when(~blank("value") & F.expr("try_cast(value AS DOUBLE)").isNull(), "bad value"))
    checks.append(F.when(~F.lower(F.trim(F.coalesce("quality", F.lit("")))).isin(TIERS), "bad quality"))
    checks.append(F.when(quality("quality").isin("verified", "self_reported") & (blank("source") | blank("url")), "no citation"))
    return sheet.withColumn("errors", F.array_compact(F.array(*checks)))
