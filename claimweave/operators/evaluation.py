"""How good extracted claims are: against labels, against the page, stage by stage, by resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import scalars as S
from claimweave.sources.tables import settled

#: The rates of a composite, in order; the pillar is reported only.
RATES = ["prec", "node", "value", "unit", "type"]
#: Values agree within this share; strata of a sample and how much of it each gets.
TOLERANCE = 0.01
ALLOCATION = {"A_numeral_and_esg": 0.60, "B_numeral_only": 0.25, "C_other": 0.15}


def normal_sentence(column: str):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"\s+", " "))


def first_of_sentences(extracted: DataFrame) -> DataFrame:
    """(sentence, at) of the first claim of each normalised sentence, written as a table, whose size tells how it is best joined."""
    found = extracted.withColumn("__s", normal_sentence("source_sentence")).where("__s <> ''")
    return settled(found.groupBy("__s").agg(F.min("at").alias("__at")))


def match_gold(gold: DataFrame, extracted: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """Each label with the claim of its id, else the first one (by ``at``) of its sentence; of claims that share
    an id the last one counts. ``how`` says which; null without a match.

    Only claims that a label can meet are sorted: those of the labels' ids, and the first of each sentence (``firsts``,
    see ``first_of_sentences``, for a caller that has them).
    """
    fields = ["normalized_aspect", "metric_value", "metric_unit", "claim_type"]
    row = F.struct("claim_id", *fields)
    asked = gold.select("claim_id").distinct().hint("shuffle_hash")
    by_id = extracted.select("claim_id", *fields, "at").join(asked, "claim_id", "left_semi").groupBy(F.col("claim_id").alias("__id")).agg(F.max_by(row, "at").alias("one"))
    sentence = normal_sentence("source_sentence")
    firsts = first_of_sentences(extracted) if firsts is None else firsts
    first = extracted.select("claim_id", *fields, "at", sentence.alias("__c")).join(firsts, (F.col("at") == F.col("__at")) & (F.col("__c") == F.col("__s")))
    by_text = first.groupBy("__s").agg(F.min_by(row, "at").alias("two"))
    met = gold.withColumn("__t", sentence).join(by_id, F.col("claim_id") == F.col("__id"), "left").join(by_text, F.col("__t") == F.col("__s"), "left")
    how = F.when(F.col("one").isNotNull(), "claim_id").when(F.col("two").isNotNull(), "source_sentence")
    return met.select(*gold.columns, how.alias("how"), F.coalesce("one", "two").alias("found"))


def judged(matched: DataFrame) -> DataFrame:
    """One row a matched label with what is right: real, node, pillar, value, unit family and type; null where
    a label does not ask."""
    pillar = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    near = "CASE WHEN found.metric_value IS NULL THEN false WHEN value = 0 THEN abs(found.metric_value) < 1e-9 ELSE abs(found.metric_value - value) / abs(value) <= %s END" % TOLERANCE
    real = F.col("is_esg_claim")
    return matched.where("how IS NOT NULL").select(
        "claim_id", real.alias("prec"), F.when(real, F.col("found.normalized_aspect").eqNullSafe(F.col("aspect"))).alias("node"), F.when(real, pillar("found.normalized_aspect") == pillar("aspect")).alias("pillar"),
        F.when(real & ~F.col("value_ambiguous") & F.col("value").isNotNull(), F.expr(near)).alias("value"),
        F.when(real & F.col("unit_base").isNotNull(), F.expr(f"({S.unit_base('found.metric_unit')}) <=> unit_base")).alias("unit"),
        F.when(real & F.col("gold_type").isNotNull(), F.col("found.claim_type").eqNullSafe(F.col("gold_type"))).alias("type"),
    )


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """The share of each that is right, and the mean of those that exist as a composite in percent."""
    out = rows.groupBy(*by).agg(*(F.expr(f"count_if({r}) / nullif(count({r}), 0)").alias(r) for r in [*RATES, "pillar"]), F.count("*").alias("n"))
    parts = F.array_compact(F.array(*RATES))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return out.withColumn("composite", F.floor(mean * 1000 + 0.5) / 10)


def grounding(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """How many valued claims (page_id, value) have their figure on their page; pages not at hand are left out."""
    numbers = F.transform(F.regexp_extract_all("markdown", F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda t: F.regexp_replace(t, ",", "").cast("double"))
    held = pages.select("page_id", F.array_distinct(numbers).alias("numbers"))
    met = claims.where("value IS NOT NULL").join(held, "page_id", "left")
    right = F.expr("exists(numbers, f -> f = value OR (f <> 0 AND abs(f - value) / abs(f) < 1e-9))")
    out = met.agg(F.count_if(F.col("numbers").isNotNull()).alias("checked"), F.count_if(right).alias("grounded"), F.count_if(F.col("numbers").isNull()).alias("skipped"))
    return out.withColumn("precision", F.expr("CASE WHEN checked > 0 THEN floor(grounded / checked * 1e4 + 0.5) / 1e4 END"))


def stratum(text: str, numeral: str) -> str:
    """SQL of the stratum of a unit: by whether it has a number, and a term of the field."""
    esg = rf"regexp_like({text}, r'(?i)\b(emission|ghg|carbon|energy|water|waste|safety|employee|training|biodiversity|target|community|governance|board|supplier)')"
    return f"CASE WHEN ({numeral}) AND {esg} THEN 'A_numeral_and_esg' WHEN ({numeral}) THEN 'B_numeral_only' ELSE 'C_other' END"


def stratified_sample(units: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``units`` (unit_id, stratum) in the sample: each stratum's share of ``n``, the least by a digest of the
    id, with the probability of being drawn and its inverse as weight. Exact in number, alike on every run.
    No quota is over ``n``, so each task sends at most ``n`` units of a stratum to the one that ranks it."""
    sizes = units.groupBy("stratum").agg(F.count("*").alias("frame"))
    share = F.coalesce(F.create_map(*(F.lit(x) for kv in ALLOCATION.items() for x in kv))[F.col("stratum")], F.lit(0.0))
    quota = F.least(F.floor(share * n + 0.5), F.col("frame"))
    order = Window.partitionBy("stratum").orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), "unit_id")), "unit_id")
    ranked = units.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).join(F.broadcast(sizes.withColumn("quota", quota)), "stratum")
    p = F.col("quota") / F.col("frame")
    return ranked.where("nth <= quota").select("unit_id", "stratum", F.expr("floor(quota / frame * 1e6 + 0.5) / 1e6").alias("inclusion_prob"), F.expr("floor(frame / quota * 1e4 + 0.5) / 1e4").alias("ipw_weight")).where(p > 0)


def label_changes(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Labels that were added, removed or changed, field by field."""
    a = old.select("claim_id", F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("a"))
    b = new.select("claim_id", F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("b"))
    both = a.join(b, "claim_id", "full")
    whole = both.select("claim_id", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").alias("change"), F.lit(None).cast("string").alias("field")).where("change IS NOT NULL")
    each = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)))
    some = both.where("a IS NOT NULL AND b IS NOT NULL").select("claim_id", F.lit("CHANGED").alias("change"), F.explode(each).alias("field"))
    return whole.unionByName(some)


def verdict(low: str, high: str, eps: float = 0.005) -> str:
    """SQL of what two repair gains say, at the weaker and the stronger tier, each judged by its own sign."""
    return (
        f"CASE WHEN {high} > {eps} AND {low} > {eps} THEN CASE WHEN {high} >= {low} - {eps} THEN 'helps at both' ELSE 'helps at both, shrinks' END WHEN {high} > {eps} THEN 'helps the stronger only' WHEN {low} > {eps} THEN 'helps the weaker only'"
        f" WHEN {high} < -{eps} AND {low} < -{eps} THEN 'costs at both' WHEN {high} < -{eps} THEN 'costs the stronger' WHEN {low} < -{eps} THEN 'costs the weaker' ELSE 'inert' END"
    )


def interaction(scores: DataFrame) -> DataFrame:
    """By lane, what repair adds at two tiers (lane, tier 0 or 1, repaired, rate, match_rate), how they differ, and
    the verdict; withheld where under half of the labels matched."""
    at = lambda t, r: F.max(F.when((F.col("tier") == t) & (F.col("repaired") == r), F.col("rate")))
    out = scores.groupBy("lane").agg((at(0, True) - at(0, False)).alias("gain_low"), (at(1, True) - at(1, False)).alias("gain_high"), F.min("match_rate").alias("match_rate"))
    out = out.withColumn("interaction", F.col("gain_high") - F.col("gain_low"))
    return out.withColumn("verdict", F.expr(f"CASE WHEN match_rate < 0.5 THEN 'withheld' ELSE {verdict('gain_low', 'gain_high')} END"))
