"""Claims from sentences by rules, from replies of a model, and back to the sentence they quote."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.functions import scalars as S
from claimweave.functions.expressions import first, text
from claimweave.operators import claims as C

# What a lower-cased sentence speaks of, what was done, and where; the first that it has decides.
ASPECTS = [
    (r"\b(scope\s*[123]|ghg|greenhouse|carbon|co2|emission)", "emissions"), (r"\b(water|wastewater|effluent)", "water"), (r"\b(energy|electricity|renewable|solar|wind)", "energy"), (r"\b(waste|recycl|circular|landfill)", "waste"),
    (r"\b(reforest|afforest|tree|plant|vegetation|forest|biodiversity)", "reforestation"), (r"\b(deforest|land.?use|land.?cover)", "deforestation"),
]
ACTIONS = [
    (r"\b(reduc|decreas|lower|cut|sav|avoid)", "reduced"), (r"\b(increas|grew|growth|expand|rais)", "increased"), (r"\b(achiev|reach|maintain|certif)", "achieved"),
    (r"\b(plant|restor|conserv|protect)", "planted"), (r"\b(generat|produc|sourc|procur)", "generated"),
]
PLACES = [
    (r"(?i)\b(?:at|in|near)\s+(?:our\s+)?(\w+(?:\s+\w+)?)\s+(?:facility|plant|factory|site|campus|hub|office)", "facility"),
    (r"(?i)\b(?:in|across)\s+(\w+(?:\s+\w+)?)\s+(?:district|city|town|municipality)", "city"), (r"(?i)\b(?:in|across)\s+(\w+(?:\s+\w+)?)\s+(?:state|province|region)", "region"),
]
TIMES = r"(?i)(?:FY\s*)?(\d{4})\s*[-–to]+\s*(?:FY\s*)?(\d{4})|(?:FY|fy)\s*(\d{4})|(?:in|during|since|by)\s+(\d{4})"
METRIC = r"(?i)([\d,]+\.?\d*)\s*(%|percent|per\s*cent|tonnes?|tons?|mt|hectares?|ha|kwh|mwh|gwh|trees?|saplings?|litres?|liters?|employees?|people|kg|gj|tj)"


def rule_claims(found: DataFrame, sentence: str = "sentence") -> DataFrame:
    """One claim for each sentence that names an aspect: action, value and unit, place, time span."""
    low = f"lower({sentence})"
    part = lambda p, i: f"regexp_extract({sentence}, r'{p}', {i})"
    have = first([(f"regexp_like({low}, r'{p}')", text(a)) for p, a in ASPECTS], "NULL")
    act = first([(f"regexp_like({low}, r'{p}')", text(a)) for p, a in ACTIONS], "'reported'")
    where = first([(f"regexp_like({sentence}, r'{p}')", part(p, 1)) for p, _ in PLACES], "NULL")
    kind = first([(f"regexp_like({sentence}, r'{p}')", text(k)) for p, k in PLACES], "NULL")
    claims = found.withColumn("aspect", F.expr(have)).where("aspect IS NOT NULL")
    cols = {"action": act, "value": f"try_cast(nullif(replace({part(METRIC, 1)}, ',', ''), '') AS DOUBLE)", "location": where, "specificity": kind}
    claims = claims.withColumns({k: F.expr(v) for k, v in cols.items()}).withColumn("unit", F.expr(f"CASE WHEN value IS NOT NULL THEN {part(METRIC, 2)} END"))
    claims = claims.withColumns({f"t{i}": F.expr(f"nullif({part(TIMES, i)}, '')") for i in (1, 2, 3, 4)})
    start = "CASE WHEN t2 IS NOT NULL THEN concat(t1, '-01-01') WHEN t3 IS NOT NULL THEN concat(CAST(t3 AS INT) - 1, '-04-01') WHEN t4 IS NOT NULL THEN concat(t4, '-01-01') END"
    end = "CASE WHEN t2 IS NOT NULL THEN concat(t2, '-12-31') WHEN t3 IS NOT NULL THEN concat(t3, '-03-31') WHEN t4 IS NOT NULL THEN concat(t4, '-12-31') END"
    return claims.withColumns({"start_date": F.expr(start), "end_date": F.expr(end)}).drop("t1", "t2", "t3", "t4")


def lenient_json(reply: str) -> str:
    """SQL of the JSON object in a model's reply: without a code fence if that parses, else from the first
    brace to the last; null if neither does."""
    bare = rf"trim(regexp_replace(regexp_replace(trim({reply}), r'^```[a-zA-Z0-9_-]*\s*', ''), r'\s*```$', ''))"
    plain = f"CASE WHEN startswith(trim({reply}), '```') THEN {bare} ELSE trim({reply}) END"
    inner = rf"regexp_extract({plain}, r'(?s)\{{.*\}}', 0)"
    valid = lambda x: f"try_parse_json({x}) IS NOT NULL"
    return f"CASE WHEN {valid(plain)} THEN {plain} WHEN {inner} <> '' AND {valid(inner)} THEN {inner} END"


#: The fields of a claim in a model's reply.
REPLY = "ARRAY<STRUCT<aspect: STRING, action: STRING, metric: STRUCT<value: DOUBLE, unit: STRING, direction: STRING>, location: STRUCT<raw_text: STRING, specificity: STRING>, time: STRUCT<start_date: STRING, end_date: STRING>, confidence: DOUBLE>>"


def reply_claims(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The claims in replies, a list or an object with ``claims``; what cannot be read or has no aspect goes. An
    unknown specificity is global, and confidence is kept between 0 and 1."""
    json = F.expr(lenient_json(reply))
    found = replies.withColumn("json", json).where("json IS NOT NULL")
    listed = f"CASE WHEN startswith(json, '[') THEN from_json(json, '{REPLY}') ELSE from_json(json, 'claims {REPLY}').claims END"
    each = found.withColumn("c", F.explode(F.expr(listed)))
    place = "CASE WHEN c.location IS NULL THEN NULL WHEN c.location.specificity IN ('facility', 'city', 'region', 'country') THEN c.location.specificity ELSE 'global' END"
    kept = each.where("coalesce(trim(c.aspect), '') <> ''")
    return kept.select(*[x for x in replies.columns if x != reply], "c.aspect", F.expr("coalesce(c.action, 'reported')").alias("action"), "c.metric.value", "c.metric.unit", F.expr(place).alias("specificity"), F.expr("greatest(0e0, least(1e0, coalesce(c.confidence, 0.5e0)))").alias("confidence"))


#: The same with every field as text, so that an odd one does not spoil the others; a location is a struct or a name.
RAW_REPLY = "ARRAY<STRUCT<aspect: STRING, action: STRING, metric: STRUCT<value: STRING, unit: STRING, direction: STRING>, location: STRING, time: STRUCT<start_date: STRING, end_date: STRING, baseline_year: STRING>, confidence: STRING>>"


def enriched_replies(replies: DataFrame, reply: str = "reply", sentence: str = "sentence") -> DataFrame:
    """The claims in replies with all that follows from them: units by name, text or aspect, type, taxonomy node, dates, keys,
    scores. ``replies`` has the sentence that was asked about; its other columns stay.

    A claim whose value or confidence is no number is left out, as is a reply that cannot be read. A missing aspect is ``unknown``,
    a missing action ``reported``, a place without a known specificity is ``global``, one given by name alone a region. A metric
    without a value is none, so are dates that are none or ``null``; the time bucket is the year of the end, else of the start.
    """
    spark = replies.sparkSession
    found = replies.withColumn("__json", F.expr(lenient_json(reply))).where("__json IS NOT NULL")
    listed = f"CASE WHEN startswith(__json, '[') THEN from_json(__json, '{RAW_REPLY}') WHEN get_json_object(__json, '$.claims') IS NOT NULL THEN from_json(__json, 'claims {RAW_REPLY}').claims ELSE from_json(concat('[', __json, ']'), '{RAW_REPLY}') END"
    each = found.withColumn("c", F.explode(F.expr(listed))).where("c IS NOT NULL")
    blank = lambda x: f"CASE WHEN lower({x}) <> 'null' THEN {x} END"
    place = "CASE WHEN startswith(c.location, '{') THEN from_json(c.location, 'raw_text STRING, specificity STRING') END"
    read = each.withColumn("__place", F.expr(place)).withColumn("__number", F.expr("try_cast(trim(c.metric.value) AS DOUBLE)"))
    read = read.where("(c.metric.value IS NULL OR __number IS NOT NULL) AND (c.confidence IS NULL OR try_cast(c.confidence AS DOUBLE) IS NOT NULL)")
    known = "('facility', 'city', 'region', 'country')"
    read = read.select(
        *[x for x in replies.columns if x != reply], F.expr("coalesce(nullif(trim(c.aspect), ''), 'unknown')").alias("aspect"), F.expr("coalesce(nullif(c.action, ''), 'reported')").alias("action"), F.col("__number").alias("metric_value"),
        F.expr("CASE WHEN __number IS NOT NULL THEN coalesce(c.metric.unit, 'unspecified') END").alias("__unit"), F.expr("CASE WHEN __number IS NOT NULL THEN c.metric.direction END").alias("__direction"),
        F.expr("CASE WHEN __place IS NOT NULL THEN nullif(__place.raw_text, '') ELSE nullif(trim(c.location), '') END").alias("location_text"),
        F.expr(f"CASE WHEN c.location IS NULL OR (__place IS NOT NULL AND coalesce(__place.raw_text, '') = '') THEN 'global' WHEN __place IS NULL THEN 'region' WHEN lower(__place.specificity) IN {known} THEN lower(__place.specificity) ELSE 'global' END").alias("location_scope"),
        *(F.expr(S.clean_date(blank(f"c.time.{d}"))).alias(d) for d in ("start_date", "end_date")), F.expr(f"try_cast({blank('c.time.baseline_year')} AS INT)").alias("baseline_year"),
        F.expr("greatest(0e0, least(1e0, coalesce(try_cast(c.confidence AS DOUBLE), 0.5e0)))").alias("confidence"),
    )
    read = read.withColumns({
        "metric_unit": F.expr(f"CASE WHEN metric_value IS NOT NULL THEN {S.inferred_unit('__unit', 'aspect', 'metric_value')} END"),
        "metric_direction": F.expr(f"CASE WHEN metric_value IS NOT NULL THEN coalesce(__direction, {S.direction_named(sentence)}) END"),
        "claim_type": F.expr(X.classify_type("action", sentence)), "time_bucket": F.expr("coalesce(left(coalesce(end_date, start_date), 4), 'unknown_time')"),
    }).drop("__unit", "__direction")
    nodes = C.normalize_aspects(read.select("aspect"), spark).withColumnRenamed("node", "normalized_aspect")
    return C.enrich(read.join(nodes, "aspect"))


def quoted(found: DataFrame) -> DataFrame:
    """Every seventh sentence as a model might quote it: a piece of it, or with a word left out."""
    some = found.where("pmod(xxhash64(doc_id, block_id, idx), 7) = 0")
    cut = F.expr("CASE WHEN idx % 2 = 0 THEN substr(sentence, 3, 60) ELSE regexp_replace(sentence, '^(\\\\S+\\\\s+\\\\S+\\\\s+)\\\\S+\\\\s+', '$1') END")
    return some.select("doc_id", "block_id", F.col("idx").alias("quote"), cut.alias("source"))


#: A quote is compared with so many sentences of its block at a time, and is like none below this ratio.
SOME, LIKE = 64, 0.5


def likest(source: str, sentences: Iterable[str], numbers: Iterable[int]) -> tuple[float | None, int | None]:
    """(ratio, number) of the sentence that is likest to ``source``, both in lower case, the least number among equals; nothing
    below LIKE.

    The letters that two texts have in common bound the ratio from above. Sentences are tried by that bound, so once
    one is as like as all that are left could be, those need no comparison.
    """
    a = source.lower()
    letters, tried = Counter(a), []
    for sentence, number in zip(sentences, numbers, strict=True):
        b = sentence.lower()
        both = len(a) + len(b)
        if not both or 2.0 * min(len(a), len(b)) / both >= LIKE:
            most = 2.0 * sum(min(n, b.count(c)) for c, n in letters.items()) / both if both else 1.0
            tried.append((-most, number, b))
    best = (-LIKE, math.inf)
    for most, number, b in sorted(tried):
        if most > best[0]:
            break
        if (most, number) < best:
            best = min(best, (-SequenceMatcher(None, a, b).ratio(), number))
    return (None, None) if best[1] == math.inf else (-best[0], best[1])


def match_sentences(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, block_id, quote, idx): the sentence of the block that a quote comes from: the first of which one
    holds the other, else the likest one from a ratio of one half on, else null.

    A quote meets the sentences of its own block, SOME in a row. Containment is settled first; only quotes without it
    are compared (see ``likest``).
    """
    key = ["doc_id", "block_id"]
    some = found.groupBy(*key, F.expr(f"idx div {SOME}").alias("part")).agg(F.collect_list(F.struct("idx", "sentence")).alias("some")).drop("part")
    inside = "filter(some, x -> contains(lower(x.sentence), low) OR contains(low, lower(x.sentence)))"
    met = quotes.withColumn("low", F.lower("source")).join(some, key).withColumn("held", F.expr(f"array_min(transform({inside}, x -> x.idx))"))
    met = met.withColumn("held", F.min("held").over(Window.partitionBy(*key, "quote")))

    @F.pandas_udf("ratio double, idx int")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            best = [(None, None) if a is None else likest(a, b, i) for a, b, i in zip(*rows, strict=True)]
            yield pd.DataFrame({"ratio": pd.Series([r for r, _ in best], dtype="float64"), "idx": pd.Series([i for _, i in best], dtype="Int32")})

    left = lambda x: F.expr(f"CASE WHEN held IS NULL THEN {x} END")
    best = met.select(*key, "quote", "held", compared(left("source"), left("some.sentence"), left("some.idx")).alias("b"))
    by_ratio = F.max_by("b.idx", F.when(F.col("b.idx").isNotNull(), F.struct("b.ratio", -F.col("b.idx"))))
    out = quotes.join(best.groupBy(*key, "quote").agg(F.min("held").alias("held"), by_ratio.alias("near")), [*key, "quote"], "left")
    return out.select(*key, "quote", F.coalesce("held", "near").alias("idx"))
