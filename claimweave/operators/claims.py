"""Derived columns of claims, and the rule layer that repairs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.functions import vocabulary as V

TIME = "CASE WHEN time_bucket <> 'unknown_time' THEN time_bucket END"

#: Columns that follow from a claim's aspect, unit, value, time and place, in order.
ENRICHED: list[tuple[str, str]] = [
    ("dimension", X.dimension("metric_unit")),
    ("metric_family", X.metric_family("normalized_aspect")),
    ("metric_key", X.metric_key("normalized_aspect", "dimension")),
    ("unit_stem", X.unit_stem("metric_unit")),
    ("canonical_unit", f"CASE WHEN metric_value IS NULL THEN metric_unit ELSE {X.canonical_unit('metric_unit', 'unit_stem')} END"),
    ("canonical_value", f"metric_value * ({X.canonical_factor('metric_unit', 'unit_stem')})"),
    ("value_plausible", X.value_plausible("metric_key", "metric_value")),
    ("claim_signature", "concat_ws('|', metric_key, time_bucket, location_scope)"),
    ("vagueness", X.vagueness("metric_value", TIME, "location_text", "claim_type")),
    ("observability", X.observability("metric_value", TIME, "location_text", "aspect")),
    ("groundability", X.groundability("metric_value", TIME, "location_text", "location_scope", "observability", "claim_type")),
]

#: The steps of the rule layer on enriched claims. ``s`` is the sentence, lower-cased and trimmed.
GATED: list[tuple[str, str]] = [
    ("s", "lower(trim(source_sentence))"),
    ("is_furniture", X.furniture("s", "metric_value", "source_type")),
    ("rule", X.aspect_rule("normalized_aspect", "s")),
    ("ruled", X.ruled_aspect("rule", "normalized_aspect", "s")),
    ("gated_aspect", X.waste_route("rule", "ruled", "s")),
    ("aspect_flag", f"CASE WHEN rule IS NOT NULL AND ruled <> normalized_aspect THEN {X.aspect_flag('rule')} WHEN rule IS NULL AND ruled <> normalized_aspect THEN 'waste_water_fixed' END"),
    ("route_flag", "CASE WHEN gated_aspect <> ruled THEN 'aspect_fixed' END"),
    ("gated_type", X.fixed_type("claim_type", "s", "metric_value", "source_type")),
    ("type_flag", "CASE WHEN gated_type <> claim_type THEN 'type_fixed' END"),
    ("unit_flag", f"CASE WHEN metric_value IS NOT NULL AND NOT {X.plausible('gated_aspect', 'dimension')} THEN 'implausible_unit' END"),
    ("gated_key", X.metric_key("gated_aspect", "dimension")),
    ("gated_family", X.metric_family("gated_aspect")),
    ("gated_signature", "concat_ws('|', gated_key, time_bucket, location_scope)"),
]


def derive(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """``df`` with columns added one after another, each from SQL over those before."""
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df


def enrich(claims: DataFrame) -> DataFrame:
    return derive(claims, ENRICHED)


def value_in_source(value: str, sentence: str):
    """Whether a number of a sentence equals a value; signs are not read, groups of digits are joined."""
    numbers = F.transform(F.regexp_extract_all(F.col(sentence), F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda t: F.regexp_replace(t, ",", "").cast("double"))
    return F.coalesce(F.exists(numbers, lambda f: (f == F.col(value)) | ((f != 0) & (F.abs(f - F.col(value)) / F.abs(f) < 1e-9))), F.lit(False))


def gate(claims: DataFrame, keep_furniture: bool = False) -> DataFrame:
    """Enriched claims through the rule layer: furniture goes, aspect and type are put right, flags say
    what was changed or looks wrong, framework tags name the clauses."""
    kept = derive(claims, GATED)
    kept = kept if keep_furniture else kept.where("NOT is_furniture")
    invented = F.when(F.col("metric_value").isNotNull() & (F.col("source_type") != "table") & ~value_in_source("metric_value", "source_sentence"), "value_not_in_source")
    flags = F.array_compact(F.array("aspect_flag", "route_flag", "type_flag", invented, "unit_flag"))
    return kept.withColumns({"quality_flags": flags, "framework_tags": framework_tags("gated_aspect", "source_sentence")})


def framework_tags(aspect: str, sentence: str):
    """Clauses of a node, then clause codes in the text that are not among them."""
    known = F.lit(None).cast("array<string>")
    for node, tags in V.FRAMEWORKS.items():
        known = F.when(F.col(aspect) == node, F.array(*map(F.lit, tags))).otherwise(known)
    codes = F.transform(F.regexp_extract_all(F.coalesce(F.col(sentence), F.lit("")), F.lit(V.CLAUSE_CODE), 1), lambda c: F.concat(F.lit("GRI "), c))
    return F.array_distinct(F.concat(F.coalesce(known, F.array().cast("array<string>")), codes))


#: What the flags of the rule layer depend on.
FLAGGED_BY = ["normalized_aspect", "claim_type", "metric_value", "dimension", "source_type", "source_sentence"]


def gate_classes(claims: DataFrame) -> DataFrame:
    """Enriched claims alike in all that flags depend on as one, with how many there are; time and scope, which only go
    into signatures, are null."""
    alike = claims.groupBy(*FLAGGED_BY).agg(F.count("*").alias("members"))
    return alike.withColumns({c: F.lit(None).cast("string") for c in ("time_bucket", "location_scope")})


def gate_stats(gated: DataFrame, all_claims: DataFrame) -> DataFrame:
    """How often each flag was set, and how many claims were dropped as furniture; rows with ``members`` (see
    ``gate_classes``) stand for so many claims."""
    held = lambda df: F.col("members") if "members" in df.columns else F.lit(1).cast("long").alias("members")
    # explode_outer keeps the optimizer from copying the rule layer into a filter on the array's size
    flags = gated.select(held(gated), F.explode_outer("quality_flags").alias("flag")).where("flag IS NOT NULL").groupBy("flag").agg(F.sum("members").alias("n"))
    furniture = derive(all_claims, GATED[:2]).where("is_furniture").select(held(all_claims))
    dropped = furniture.agg(F.lit("furniture_dropped").alias("flag"), F.coalesce(F.sum("members"), F.lit(0).cast("long")).alias("n"))
    return flags.unionByName(dropped)


def gate_workload(gated: DataFrame) -> DataFrame:
    """How much the rule layer did, over claims that went through it with furniture kept (see ``gate``)."""
    changed = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    flagged = F.count_if(F.size("quality_flags") > 0)
    return gated.agg(
        F.count("*").alias("claims"),
        F.count_if((F.lower("aspect") != F.col("normalized_aspect")) & (F.col("normalized_aspect") != "uncategorized")).alias("mapped"),
        F.count_if(F.col("gated_aspect") == "uncategorized").alias("uncategorized_after"),
        changed("normalized_aspect", "gated_aspect").alias("aspect_changed"),
        changed("claim_type", "gated_type").alias("type_changed"),
        F.count_if("is_furniture").alias("furniture"),
        flagged.alias("flagged"),
        F.round(flagged / F.greatest(F.count("*"), F.lit(1)), 6).alias("flag_rate"),
    )


def near_duplicates(claims: DataFrame) -> DataFrame:
    """The first claim of each report, aspect, action, value and page."""
    same = Window.partitionBy("report_id", F.lower("aspect"), F.lower("action"), "metric_value", "page_number").orderBy("claim_id")
    return claims.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")


def meaningful(claims: DataFrame) -> DataFrame:
    """Claims with a metric, a time or a place."""
    return claims.where("metric_value IS NOT NULL OR time_bucket <> 'unknown_time' OR location_text IS NOT NULL")


#: What an older importer took for verbs, and for no unit at all.
LEGACY_VERBS = "increase|reduce|decrease|maintain|achieve|improve|drop|fall|rise"
NO_UNIT = "('unspecified', 'none', 'null', '')"


def legacy_valid(claims: DataFrame) -> DataFrame:
    """Claims that an older importer let pass: specific, with value and unit, few numbers, with a verb."""
    numbers = F.regexp_count("source_sentence", F.lit(r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"))
    words = F.size(F.filter(F.split("source_sentence", r"\s+"), lambda w: w != ""))
    kept = claims.where(f"vagueness < 0.4 AND metric_value IS NOT NULL AND lower(coalesce(metric_unit, '')) NOT IN {NO_UNIT}")
    return kept.where((numbers <= 6) & ((words == 0) | (numbers / words <= 0.5)) & F.lower("source_sentence").rlike(LEGACY_VERBS))


def top_per_page(claims: DataFrame, k: int = 5) -> DataFrame:
    """The k most groundable claims of each report page, earlier claims first among equals."""
    best = Window.partitionBy("report_id", "page_number").orderBy(F.desc("groundability"), "claim_id")
    return claims.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def clean_up(claims: DataFrame) -> DataFrame:
    """Drop values without unit and very vague claims; an unset scope becomes ``Global``."""
    kept = claims.where(f"NOT (metric_value IS NOT NULL AND (metric_unit IS NULL OR lower(metric_unit) IN {NO_UNIT})) AND NOT coalesce(vagueness > 0.8, false)")
    return kept.withColumn("location_scope", F.expr("CASE WHEN coalesce(location_scope, '') = '' THEN 'Global' ELSE location_scope END"))


def normalize_aspects(aspects: DataFrame, spark) -> DataFrame:
    """(aspect, node) of each distinct raw aspect: an exact phrase, else the longest phrase within it, else
    the shortest phrase that it is within, else uncategorized; phrases match at word bounds and earlier
    nodes win ties. Aspects meet phrases by shared words, not all with all."""
    rows = [(i, node, phrase) for i, (node, phrases) in enumerate(V.TAXONOMY.items()) for phrase in phrases]
    phrases = spark.createDataFrame(rows, "place int, node string, phrase string")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    raw = aspects.select("aspect", F.lower(F.trim("aspect")).alias("raw")).distinct()
    left = raw.select("aspect", "raw", F.explode(words(F.col("raw"))).alias("word"))
    right = phrases.select("*", F.explode(words(F.col("phrase"))).alias("word"))
    met = left.join(F.broadcast(right), "word").drop("word").distinct()  # the taxonomy has a fixed size
    bound = lambda inner: F.concat(F.lit(r"\b\Q"), inner, F.lit(r"\E\b"))
    kind = F.when(F.col("raw") == F.col("phrase"), 0).when(F.regexp_like("raw", bound(F.col("phrase"))), 1).when(F.regexp_like("phrase", bound(F.col("raw"))), 2)
    size = F.when(F.col("kind") == 1, -F.length("phrase")).when(F.col("kind") == 2, F.length("phrase")).otherwise(0)
    ranked = met.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("size", size)
    best = ranked.groupBy("aspect").agg(F.min_by("node", F.struct("kind", "size", "place")).alias("node"))
    return raw.select("aspect").join(best, "aspect", "left").select("aspect", F.coalesce("node", F.lit("uncategorized")).alias("node"))
