"""Queries over stored tables, vectors, reviews and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.functions.scalars import check_key
from claimweave.operators import analytics as A
from claimweave.operators import claims as C
from claimweave.operators import evaluation as V
from claimweave.operators import knn as K
from claimweave.operators import resample as R
from claimweave.operators import review as W
from claimweave.operators import store as T
from claimweave.operators import tables as B
from claimweave.operators import vectors as N
from claimweave.operators import views as O
from claimweave.plans.analytics import CONFLICTS, CONFLICTING, FIGURES, PLAIN, REPORTING, WHOLE, WITH_CONFLICTS
from claimweave.plans.claims import enriched
from claimweave.plans.dialect import CLAIMS, ENRICH, GATE_ALL
from claimweave.plans.documents import CELLS, pages
from claimweave.plans.views import _STATUS as STATUS
from claimweave.sources import published as P
from claimweave.sources.functions import register
from claimweave.sources.tables import claims, in_parts, settled, shared_folder, table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def match_claims(spark, d):
    """The ten claims most like each claim, of its label."""
    return K.nearest_of_all(_vectors(spark, d), 10, 0.2, "label").select("query_id", "place", "id", F.round("similarity", 6).alias("similarity"))


def nli_neighbors(spark, d):
    """Pairs of a claim and one of its three nearest of the same label that are not of one sentence. Reports ask for a
    similarity over 0.85; no two of the given vectors have that, so 0.2 is asked here."""
    found = K.nearest_of_all(_vectors(spark, d), 3, 0.2, "label")
    return K.contrary_pairs(found, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sentence"))).select("a", "b", F.round("similarity", 6).alias("similarity"))


def search_claims(spark, d):
    """Every hundredth claim asks all claims' vectors; a best hit under 0.25 is of low relevance."""
    v = _vectors(spark, d)
    found = N.neighbours(v, v.where("id % 100 = 0"), 8, -1.0)
    low = F.max("similarity").over(Window.partitionBy("query_id")) < 0.25
    return found.select("query_id", "place", "id", F.round("similarity", 6).alias("similarity"), low.alias("low_relevance"))


def match_claims_sql(spark, d):
    """For the first claim of the table, the five most like it in every label, asked in SQL of the set-returning function."""
    register(spark)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("claim_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    first = v.orderBy("claim_id").first()
    asked = "array(" + ", ".join(f"{x!r}D" for x in first["embedding"]) + ")"
    return spark.sql(f"SELECT label, claim_id, round(similarity, 6) AS similarity FROM match_claims(TABLE({{v}}) PARTITION BY (label) ORDER BY (claim_id), {asked}, 0.0D, 5, {first['claim_id']}L)", v=v)


def pair_dedup(spark, d):
    p = table(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 60 END AS a", "l_suppkey % 60 AS b", "l_orderkey * 8 + l_linenumber AS at").distinct()
    return N.distinct_pairs(p).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").isNull().alias("open"))


def conflict_enrich(spark, d):
    """Conflicts with both texts and places; ids in no claim get a placeholder."""
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*CONFLICTING, "page_number"]))))
    c = A.numeric_conflicts(e).select("claim_a", F.expr("CASE WHEN claim_b % 7 = 0 THEN -1 ELSE claim_b END").alias("claim_b"), "severity")
    side = lambda x: e.select(F.col("claim_id").alias(f"claim_{x}"), F.col("source_sentence").alias(f"text_{x}"), F.col("page_number").alias(f"page_{x}"))
    met = c.join(side("a"), "claim_a", "left").join(side("b"), "claim_b", "left")
    return met.select("claim_a", "claim_b", "severity", *(F.coalesce(f"text_{x}", F.lit("Unknown claim")).alias(f"text_{x}") for x in "ab"), "page_a", "page_b")


def score_join(spark, d):
    """Scores by company name or id, letters and digits alone in lower case; the id counts before the name."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "concat('COMPANY-', CAST(s_suppkey AS STRING)) AS name", "CAST(s_suppkey % 100 AS INT) AS score").where("s_suppkey % 3 <> 0")
    keys = s.select(fold("name").alias("k"), "score", F.lit(1).alias("o")).unionByName(s.where("s_suppkey % 2 = 0").select(fold(F.concat(F.lit("id"), F.col("s_suppkey").cast("string"))).alias("k"), "score", F.lit(0).alias("o")))
    one = keys.groupBy("k").agg(F.min_by("score", F.struct("o", "score")).alias("score"))
    companies = claims(spark, d).select("company_id", "company_name").distinct()
    by_name, by_id = one.select(F.col("k").alias("kn"), F.col("score").alias("sn")), one.select(F.col("k").alias("ki"), F.col("score").alias("si"))
    met = companies.join(by_name, fold("company_name") == F.col("kn"), "left").join(by_id, F.concat(F.lit("id"), F.col("company_id").cast("string")) == F.col("ki"), "left")
    return met.select("company_id", F.coalesce("si", "sn").alias("score"))


def satellite_relink(spark, d):
    """Checks of earlier claims found again by what they are about; the latest of each, orphans go."""
    key = F.expr(check_key("report_id", "normalized_aspect", "location_text", "time_bucket"))
    c = claims(spark, d).withColumn("k", key)
    stored = c.where("claim_id % 3 = 0").select(F.expr("CASE WHEN claim_id % 2 = 0 THEN k ELSE concat(k, 'x') END").alias("k"), F.col("claim_id").alias("at"), F.expr("CASE WHEN claim_id % 4 = 0 THEN 'supported' ELSE 'inconclusive' END").alias("verdict"))
    live = c.groupBy("k").agg(F.max("claim_id").alias("claim_id"))
    return T.latest(stored, ["k"], "at").join(live, "k").select("claim_id", "verdict", "at")


def _reviews(e):
    flagged = A.claim_flags(e)
    events = F.explode(F.expr("sequence(1, CASE WHEN claim_id % 4 = 0 THEN 2 ELSE 1 END)"))
    some = flagged.where("claim_id % 5 = 0").withColumn("at", events)
    return some.select("report_id", F.col("claim_id").cast("string").alias("subject_id"), "flag", "at", F.expr("CASE WHEN (claim_id + at) % 2 = 0 THEN 'dismissed' ELSE 'confirmed' END").alias("verdict"))


def review_latest(spark, d):
    return T.latest(_reviews(settled(enriched(spark, d).select(REPORTING))), ["report_id", "subject_id", "flag"], "at").select("report_id", "subject_id", "flag", "verdict")


def review_queue(spark, d):
    """Every item that can be reviewed: claims' flags, conflicts by a digest of their text, and report flags; with
    the latest verdict and its place in the queue (open first, then dismissed, then confirmed)."""
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*REPORTING, *CONFLICTING]))))
    items = A.claim_flags(e).select("report_id", F.col("claim_id").cast("string").alias("subject_id"), "flag")
    bad = A.numeric_conflicts(e).select("report_id", F.expr("left(sha1(concat_ws('|', claim_a, claim_b, conflict)), 12)").alias("subject_id"), F.lit("CONTRADICTION").alias("flag"))
    whole = A.report_flags(e).where("flag IN ('DISCLOSURE_GAP', 'ASPIRATIONAL_HEAVY')").select("report_id", F.lit("__report__").alias("subject_id"), "flag")
    verdicts = T.latest(_reviews(e), ["report_id", "subject_id", "flag"], "at").drop("at")
    met = items.unionByName(bad).unionByName(whole).join(verdicts, ["report_id", "subject_id", "flag"], "left")
    return met.withColumn("queue", F.expr("CASE WHEN verdict IS NULL THEN 0 WHEN verdict = 'dismissed' THEN 1 ELSE 2 END"))


def _review_inputs(spark, d):
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*REPORTING, *CONFLICTING, "page_number"]))))
    return e, settled(A.numeric_conflicts(e))


def review_items(spark, d):
    """Every item of the review queue with its kind, title, reason, sentence and page."""
    return W.review_items(*_review_inputs(spark, d))


def review_scores(spark, d):
    """Scores before and after reviews that dismiss claims' flags, one kind of conflict and reports' own flags."""
    e, found = _review_inputs(spark, d)
    items = W.review_items(e, found).select("report_id", "subject_id", "flag", "kind", "title")
    low = found.where("conflict = 'Scope'").select("report_id", W.conflict_subject().alias("subject_id")).withColumn("flag", F.lit("CONTRADICTION"))
    own = items.where("kind = 'report' AND flag = 'ASPIRATIONAL_HEAVY'").select("report_id", "subject_id", "flag")
    gone = W.dismissed(_reviews(e)).unionByName(low).unionByName(own)
    return W.reviewed_scores(e, found, gone)


def flag_details(spark, d):
    """Flags of reports with their share, text and first five claims."""
    return W.flag_details(_review_inputs(spark, d)[0]).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: F.concat(x["claim_id"].cast("string"), F.lit(" "), x["source_sentence"])), ";"))


def page_matched(spark, d):
    """Claims on pages that both arms produced, by report and page."""
    c = claims(spark, d).select("claim_id", "report_id", "page_number")
    a, b = c.where("claim_id % 2 = 0"), c.where("claim_id % 2 = 1")
    both = a.select("report_id", "page_number").intersect(b.select("report_id", "page_number"))
    return c.join(both, ["report_id", "page_number"], "left_semi").select("claim_id")


def yoy_common(spark, d):
    """The first figure of each metric that a company reports in both of two neighbouring report years."""
    e = settled(enriched(spark, d).select(FIGURES)).where(f"metric_value IS NOT NULL AND {A.MEANINGFUL}")
    first = e.groupBy("company_id", "metric_key", "report_year").agg(F.min_by("metric_value", "claim_id").alias("v"))
    later = first.select("company_id", "metric_key", (F.col("report_year") - 1).alias("report_year"), F.col("v").alias("value_next"))
    return first.join(later, ["company_id", "metric_key", "report_year"]).select("company_id", "metric_key", "report_year", F.col("v").alias("value"), "value_next")


def suggest_questions(spark, d):
    """Questions that a report's flags raise, without repeats, five at most, in order of severity."""
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*REPORTING, *CONFLICTING]))))
    flags = A.report_flags(e, None, A.numeric_conflicts(e))
    rank = F.expr("CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END")
    ask = F.when(F.col("flag") == "VAGUE", "Which environmental claims lack measurable metrics?").when(F.col("flag") == "CONTRADICTION", "Where does this report contradict itself on emissions or targets?").when(F.col("flag") == "ASPIRATIONAL_HEAVY", "Which targets have no baseline, deadline, or interim milestones?").otherwise(F.concat(F.lit("What evidence supports the '"), F.col("flag"), F.lit("' flag?")))
    some = flags.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "flag", ask.alias("q")))), lambda x: x["q"]).alias("qs"))
    return some.select("report_id", F.array_join(F.slice(F.array_distinct("qs"), 1, 5), ";").alias("questions"))


def evidence_quality(spark, d):
    """By report: how groundable claims are, what they lack, and the six weakest."""
    e = settled(enriched(spark, d))
    pct = lambda cond: F.floor(F.count_if(F.expr(cond)) * 1000 / F.count("*") + 0.5) / 10
    parts = e.groupBy("report_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("groundability") >= 0.75).alias("high"), F.count_if((F.col("groundability") >= 0.5) & (F.col("groundability") < 0.75)).alias("medium"), F.count_if(F.col("groundability") < 0.5).alias("low"),
        pct("metric_value IS NULL").alias("no_metric"), pct("time_bucket = 'unknown_time'").alias("no_time"), pct("location_text IS NULL").alias("no_place"), F.count_if(F.col("claim_type") == "narrative").alias("narrative"),
    )
    weak = T.latest(e.select("report_id", "claim_id", "groundability"), ["report_id", "claim_id"], "claim_id")
    w = Window.partitionBy("report_id").orderBy("groundability", "claim_id")
    six = weak.withColumn("n", F.row_number().over(w)).where("n <= 6").groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim_id"))), lambda x: x["claim_id"].cast("string")), ",").alias("weakest"))
    return parts.join(six, "report_id")


def evidence_template(spark, d):
    """The 40 commonest figures (company, metric, year) and an example, the report of what evidence to gather."""
    e = settled(enriched(spark, d).select("claim_id", "company_id", "metric_key", "time_bucket", "metric_value")).where("metric_key <> 'uncategorized' AND time_bucket <> 'unknown_time'")
    n = e.groupBy("company_id", "metric_key", F.col("time_bucket").alias("year")).agg(F.count("*").alias("n"), F.min_by("metric_value", F.when(F.col("metric_value").isNotNull(), F.col("claim_id"))).alias("example"))
    return n.orderBy(F.desc("n"), "company_id", "metric_key", "year").limit(40)


REGIONS = [("Asia Pacific", "singapore|japan|india|australia|tokyo|sydney"), ("Europe", "berlin|europe|germany|uk|oslo"), ("North America", "usa|united states|america|houston"), ("South America", "brazil|são paulo|buenos aires"), ("Africa", "johannesburg|africa"), ("Middle East", "uae|dubai")]


def regions(spark, d):
    """Companies, claims and mean score by region of the places that a company names; each counts once."""
    e = settled(enriched(spark, d).select(list(dict.fromkeys([*REPORTING, *CONFLICTING, "location_text"]))))
    region = F.when(F.col("location_text").isNull(), "Global")
    for name, words in REGIONS:
        region = region.when(F.lower("location_text").rlike(words), name)
    scores = A.portfolio(e, A.conflicting_scores(e)).select("company_id", "score")
    every = e.groupBy("company_id").agg(F.count("*").alias("n"))
    some = e.select("company_id", region.otherwise("Other").alias("region")).distinct().join(every, "company_id").join(scores, "company_id", "left")
    return some.groupBy("region").agg(F.count("*").alias("companies"), F.sum("n").alias("claims"), F.floor(F.avg("score") + 0.5).cast("long").alias("avg_score"))


def system_stats(spark, d):
    s = O.ui_claims(settled(enriched(spark, d)))
    tests = {"total": "true", "high": "confidence >= 75", "medium": "confidence >= 50 AND confidence < 75", "low": "confidence < 50", "with_metric": "metric_value IS NOT NULL", "with_location": "location_text IS NOT NULL"}
    counts = s.agg(*(F.count_if(F.expr(v)).alias(k) for k, v in tests.items()))
    wide = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*tests))).alias("name", "n"))
    top = s.groupBy(F.concat(F.lit("aspect "), "normalized_aspect").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(12)
    kinds = s.groupBy(F.concat(F.lit("type "), "claim_type").alias("name")).agg(F.count("*").alias("n"))
    return wide.unionByName(top).unionByName(kinds)


def ui_risk(spark, d):
    s = O.ui_claims(enriched(spark, d)).groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "gap").alias("gap"), F.count_if(F.col("status") == "review").alias("review"))
    return s.select("company_id", F.expr("floor((gap * 8 + review * 2) / (10 * n) * 1e4 + 0.5) / 1e4").alias("risk"), F.expr("CASE WHEN gap > n * 0.1 THEN 'High Risk' ELSE 'Moderate Risk' END").alias("status"))


def paired_z(spark, d):
    """Two composites pixel by pixel (vectors of neighbouring ids): mean change, z with neighbours discounted, verdict."""
    e = table(spark, d, "embeddings").selectExpr("vec_id div 2 AS pair", "vec_id % 2 AS side", "embedding")
    both = e.groupBy("pair").agg(F.min_by("embedding", F.when(F.col("side") == 0, 0)).alias("a"), F.min_by("embedding", F.when(F.col("side") == 1, 1)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    delta = F.expr("filter(zip_with(b, a, (x, y) -> CAST(x AS DOUBLE) - CAST(y AS DOUBLE)), x -> NOT isnan(x))")
    stats = both.select("pair", delta.alias("d")).withColumns({"n": F.size("d"), "m": F.expr("aggregate(d, 0e0, (s, x) -> s + x) / size(d)")})
    stats = stats.withColumn("sd", F.expr("sqrt(aggregate(d, 0e0, (s, x) -> s + (x - m) * (x - m)) / n)"))
    return stats.select("pair", "n", F.round("m", 4).alias("delta"), F.round(F.expr("m / (CASE WHEN sd = 0 THEN 1e-6 ELSE sd END / sqrt(greatest(1e0, n / 16e0)))"), 2).alias("z")).withColumn("verdict", F.expr("CASE WHEN abs(delta) < 0.05 OR abs(z) < 2 THEN 'inconclusive' WHEN delta > 0 THEN 'supported' ELSE 'not_supported' END"))


def ndvi_median(spark, d):
    """Median index of each pixel over a place's four least cloudy scenes: (near infrared - red) over their sum."""
    s = table(spark, d, "embeddings").selectExpr("label AS place", "vec_id AS scene", "vec_id % 37 AS cloud", "transform(embedding, x -> abs(CAST(x AS DOUBLE))) AS v")
    w = Window.partitionBy("place").orderBy("cloud", "scene")
    best = s.withColumn("n", F.row_number().over(w)).where("n <= 4")
    pixels = best.select("place", F.posexplode(F.expr("zip_with(slice(v, 1, 32), slice(v, 33, 32), (nir, red) -> CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) END)")).alias("pixel", "index")).where("index IS NOT NULL")
    return pixels.groupBy("place", "pixel").agg(F.round(F.median("index"), 6).alias("ndvi"))


#: Labels made from claims: every fiftieth, some not claims, some with another node, value or type.
GOLD = """SELECT CASE WHEN claim_id % 4 = 0 THEN -claim_id ELSE claim_id END AS claim_id, source_sentence, claim_id % 6 <> 0 AS is_esg_claim, CASE WHEN claim_id % 3 = 0 THEN 'waste.total' ELSE normalized_aspect END AS aspect,
    CASE WHEN claim_id % 5 = 0 THEN metric_value * 2 ELSE metric_value END AS value, claim_id % 9 = 0 AS value_ambiguous, CASE WHEN claim_id % 2 = 0 THEN 'energy' END AS unit_base, CASE WHEN claim_id % 7 = 0 THEN 'target' ELSE claim_type END AS gold_type FROM {source} WHERE claim_id % 50 = 1 OR claim_id % 50 = 4"""


def _judged(spark, d):
    c = claims(spark, d)
    return V.judged(V.match_gold(spark.sql(GOLD, source=c), c.withColumn("at", F.col("claim_id"))))


def gold_match(spark, d):
    c = claims(spark, d)
    return V.match_gold(spark.sql(GOLD, source=c), c.withColumn("at", F.col("claim_id"))).select("claim_id", "how", F.col("found.claim_id").alias("found_id"))


def eval_metrics(spark, d):
    return V.rates(_judged(spark, d).withColumn("g", F.lit(1)), "g").select("n", *(F.round(r, 6).alias(r) for r in [*V.RATES, "pillar"]), "composite")


#: Stages of the rule layer, each on top of those before.
STAGES = ("S0", "S1", "S2", "S3", "S4", "S5")


def _stages(spark, d):
    """The claims after each stage: free text, taxonomy, years of columns, values found in their table, gate, furniture
    dropped. The page of a claim from a table shows its value under the year before in every fifth one."""
    raw = settled(claims(spark, d))
    of_table = raw.where("source_type = 'table' AND metric_value > 0")
    right = "CAST(metric_value AS BIGINT)"
    cells = f"CASE WHEN claim_id % 5 = 0 THEN concat({right}, ' | ', 2 * {right}) ELSE concat(2 * {right} + 1, ' | ', {right}) END"
    shown = of_table.selectExpr("claim_id AS page_id", f"concat('| Metric | FY2022 | FY2023 |\n| --- | --- | --- |\n| figure | ', {cells}, ' |') AS markdown")
    fixed = settled(B.repair_years(of_table.selectExpr("claim_id", "claim_id AS page_id", "'figure in FY2023' AS label", "metric_value AS value"), shown).where("fy_column_fixed").select("claim_id", "value"))
    repaired = raw.join(fixed, "claim_id", "left").withColumn("metric_value", F.coalesce("value", "metric_value")).drop("value")
    numbers = F.transform(F.regexp_extract_all("markdown", F.lit(r"\d+"), 0), lambda t: t.cast("double"))
    held = shown.select(F.col("page_id").alias("claim_id"), numbers.alias("numbers"))
    r = settled(repaired)
    flagged = r.join(held, "claim_id", "left").withColumn("value_not_in_table", F.expr("numbers IS NOT NULL AND NOT array_contains(numbers, metric_value)")).drop("numbers")
    gated = C.gate(C.enrich(r), keep_furniture=True)
    last = settled(gated.select("claim_id", "source_sentence", F.col("gated_aspect").alias("normalized_aspect"), "metric_value", "metric_unit", F.col("gated_type").alias("claim_type"), "is_furniture"))
    return raw, {"S0": raw.withColumn("normalized_aspect", F.lower("aspect")), "S1": raw, "S2": r, "S3": flagged, "S4": last, "S5": last.where("NOT is_furniture")}


def _staged(spark, d, names=STAGES):
    """The labels judged after each stage. All stages but the last have the same sentences, so their first claims are found once."""
    raw, stages = _stages(spark, d)
    gold = settled(spark.sql(GOLD, source=raw))
    ordered = {name: c.withColumn("at", F.col("claim_id")) for name, c in stages.items()}
    firsts = V.first_of_sentences(ordered["S1"])
    out = None
    for name in names:
        part = V.judged(V.match_gold(gold, ordered[name], None if name == "S5" else firsts)).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return stages, out


def ablation(spark, d):
    return V.rates(settled(_staged(spark, d)[1]), "stage").select("stage", "n", *(F.round(r, 6).alias(r) for r in ("node", "value", "type")), "composite")


def bootstrap_ci(spark, d):
    """Intervals of every rate and of the composite of every stage over 2,000 resamples of the labels."""
    return R.intervals(settled(_staged(spark, d)[1]), V.RATES, "stage", extra=("pillar",))


def bootstrap_deltas(spark, d):
    """What each stage, and all stages from the first and from the second, add to the composite: paired intervals."""
    rows = settled(_staged(spark, d)[1])
    point = V.rates(rows, "stage").select("stage", "composite")
    found = R.paired_deltas(rows, V.RATES, "stage", R.stage_pairs(list(STAGES)))
    found = found.join(point.select(F.col("stage").alias("before"), F.col("composite").alias("a")), "before").join(point.select(F.col("stage").alias("after"), F.col("composite").alias("b")), "after")
    return found.select("before", "after", F.round(F.col("b") - F.col("a"), 1).alias("gain"), "low", "high", "excludes_zero")


def grounding(spark, d):
    c = table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 10 = 0 THEN -p_partkey ELSE p_partkey END AS page_id", "CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 1000000 END AS DOUBLE) AS value")
    return V.grounding(c, pages(spark, d))


def _units(spark, d):
    cells = B.table_cells(B.tables(pages(spark, d)))
    unit = F.expr("concat('tbl_', left(sha1(concat_ws('|', page_id, island, row, col)), 12))")
    return cells.select(unit.alias("unit_id"), F.expr(V.stratum("concat(label, ' ', column)", "col <> 2")).alias("stratum"))


def frame_describe(spark, d):
    u = _units(spark, d).groupBy("stratum").agg(F.count("*").alias("units"))
    total = u.agg(F.sum("units").alias("total"))
    return u.crossJoin(F.broadcast(total)).select("stratum", "units", F.expr("floor(units / total * 1000 + 0.5) / 10").alias("share"))


FIELDS = ["is_esg_claim", "aspect", "value", "gold_type"]


def gold_diff(spark, d):
    g = spark.sql(GOLD, source=claims(spark, d)).where("claim_id > 0")
    new = g.where("claim_id % 11 <> 0").withColumn("aspect", F.expr("CASE WHEN claim_id % 13 = 0 THEN 'x' ELSE aspect END")).withColumn("value", F.expr("CASE WHEN claim_id % 17 = 0 THEN NULL ELSE value END"))
    return V.label_changes(g.where("claim_id % 19 <> 0"), new, FIELDS)


def provenance_check(spark, d):
    """Whether the first three words of a part's name are on its page."""
    c = table(spark, d, "part").selectExpr("p_partkey AS page_id", "CASE WHEN p_partkey % 2 = 0 THEN 'some PROSE | never' ELSE 'Subject for review | 1' END AS sentence")
    start = F.expr("lower(array_join(slice(split(left(sentence, 60), ' '), 1, 3), ' '))")
    return c.join(pages(spark, d), "page_id").select("page_id", F.contains(F.lower("markdown"), start).alias("found"))


def interaction(spark, d):
    """Two lanes at two tiers with and without repair, from counts of claims."""
    c = claims(spark, d).selectExpr("CASE WHEN claim_id % 2 = 0 THEN 'recall' ELSE 'grounding' END AS lane", "CAST(claim_id % 4 >= 2 AS INT) AS tier", "claim_id % 8 >= 4 AS repaired", "claim_id")
    rates = c.groupBy("lane", "tier", "repaired").agg(F.expr("count_if(claim_id % (CASE WHEN repaired THEN 3 ELSE 5 END) <> 0) / count(*)").alias("rate")).withColumn("match_rate", F.lit(0.6))
    return V.interaction(rates).select("lane", *(F.round(x, 6).alias(x) for x in ("gain_low", "gain_high", "interaction")), "verdict")


def tradeoff(spark, d):
    """What dropping furniture costs and gains: claims dropped, and labels of real claims among them."""
    s, rows = _staged(spark, d, ("S4", "S5"))
    rates = settled(V.rates(rows, "stage").select("stage", "composite", "n"))
    a = rates.where("stage = 'S4'").select(F.col("composite").alias("before"), F.col("n").alias("matched_before"))
    b = rates.where("stage = 'S5'").select(F.col("composite").alias("after"), F.col("n").alias("matched_after"))
    gone = s["S4"].agg(F.count_if("is_furniture").alias("dropped"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(gone)).select("matched_before", "matched_after", "dropped", F.round(F.col("after") - F.col("before"), 1).alias("gain"))


def ingest_replace(spark, d):
    c = claims(spark, d).select("claim_id", "report_id", "metric_value")
    new = c.where("report_id LIKE '%_1995' AND claim_id % 2 = 0").withColumn("metric_value", F.lit(-1.0))
    empty = c.where("false")
    return T.replace_reports(T.replace_reports(c, new), empty)


def contradiction_replace(spark, d):
    """Stored contradictions after the reports of every other company were scanned again without their targets: theirs are
    replaced, also by none, and the others stay."""
    e = settled(enriched(spark, d).select(*CONFLICTING, "company_id", "claim_type"))
    conflicts = lambda c: A.numeric_conflicts(c).select("report_id", "claim_a", "claim_b", "severity", "conflict")
    found = in_parts(conflicts, "report_id", e, write=True)  # a store reads them twice
    kept = P.Store(spark, shared_folder(spark, "stores"), found.schema, "report_id", 8)
    kept.replace(found)
    again = e.where("company_id % 2 = 0")
    found = in_parts(conflicts, "report_id", again.where("claim_type <> 'target'"), write=True)
    kept.replace(found, keys=again.select("report_id").distinct())
    return kept.read()


def report_upsert(spark, d):
    r = claims(spark, d).groupBy("report_id").agg(F.count("*").alias("claims"), F.first("company_id").alias("company_id"))
    new = r.where("company_id % 2 = 0").withColumn("claims", -F.col("claims")).unionByName(spark.createDataFrame([("r_new", 0, -1)], "report_id string, claims long, company_id long"))
    return T.upsert(r, new, ["report_id"])


def resume_units(spark, d):
    u = claims(spark, d).select(F.col("claim_id").cast("string").alias("unit"))
    lines = u.where("CAST(unit AS BIGINT) % 2 = 0").select(F.expr("CASE WHEN CAST(unit AS BIGINT) % 10 = 0 THEN concat('{\"unit\": \"', unit) ELSE concat('{\"unit\": \"', unit, '\", \"claims\": []}') END").alias("text"))
    return T.todo(u, lines)


def metadata_backfill(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "text", "source AS doc", "CASE WHEN doc_id % 5 = 0 THEN 'kept' END AS company")
    return T.backfill_company(rows, [("the", "The Company"), ("web", "Web Company"), ("de", "De Company")]).select("doc_id", "company")


def file_names(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 5 WHEN 0 THEN concat('tata-power-brsr-2023-24-', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('Shell_sustainability_report_20', lpad(CAST(s_suppkey % 30 AS STRING), 2, '0')) WHEN 2 THEN 'esg-report' WHEN 3 THEN 'acme_of_things' ELSE 'x-2019' END AS stem")


def audit_counts(spark, d):
    c = claims(spark, d)
    names = ["metric_value", "location_text", "metric_direction", "time_bucket"]
    return c.agg(F.count("*").alias("claims"), F.count_distinct("report_id").alias("reports"), F.count_distinct("company_id").alias("companies"), *(F.count_if(F.col(n).isNull()).alias(f"no_{n}") for n in names))


QUERIES = {
    "match_claims": match_claims, "nli_neighbors": nli_neighbors, "match_claims_sql": match_claims_sql, "search_claims": search_claims, "pair_dedup": pair_dedup, "conflict_enrich": conflict_enrich, "score_join": score_join,
    "satellite_relink": satellite_relink, "review_latest": review_latest, "review_queue": review_queue, "review_items": review_items, "review_scores": review_scores, "flag_details": flag_details, "page_matched": page_matched, "yoy_common": yoy_common, "suggest_questions": suggest_questions,
    "evidence_quality": evidence_quality, "evidence_template": evidence_template, "regions": regions, "system_stats": system_stats, "ui_risk": ui_risk, "paired_z": paired_z, "ndvi_median": ndvi_median,
    "gold_match": gold_match, "eval_metrics": eval_metrics, "ablation": ablation, "bootstrap_ci": bootstrap_ci, "bootstrap_deltas": bootstrap_deltas, "grounding": grounding, "stratified_sample": lambda s, d: V.stratified_sample(_units(s, d), 400),
    "frame_describe": frame_describe, "gold_diff": gold_diff, "provenance_check": provenance_check, "interaction": interaction, "tradeoff": tradeoff,
    "ingest_replace": ingest_replace, "contradiction_replace": contradiction_replace, "report_upsert": report_upsert, "resume_units": resume_units, "claims_snapshot": lambda s, d: T.snapshot(claims(s, d)), "metadata_backfill": metadata_backfill,
    "collect_links": lambda s, d: T.links(table(s, d, "pages")).select("page_id", "nth", "href", "text", "absolute"), "infer_metadata": lambda s, d: T.file_metadata(file_names(s, d)).drop("stem"),
    "page_ranges": lambda s, d: T.page_runs(table(s, d, "lineitem").selectExpr("l_suppkey AS doc", "l_partkey % 50 AS page")), "audit_counts": audit_counts,
}

_DOT = "list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x))))"
_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_NEAR = lambda q, on: f"{_VEC}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 9) AS similarity FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND {on} WHERE q.{q})"
_GOLD = f"gold AS ({GOLD.replace('{source}', 'claims')})"
_NORM = "trim(regexp_replace(lower(source_sentence), '\\s+', ' ', 'g'))"
_MATCH = f"""{_GOLD}, txt AS (SELECT {_NORM} AS s, min(claim_id) AS cid FROM {{x}} GROUP BY 1), hit AS (SELECT g.*, CASE WHEN c.claim_id IS NOT NULL THEN 'claim_id' WHEN t.cid IS NOT NULL THEN 'source_sentence' END AS how, coalesce(c.claim_id, t.cid) AS found_id
        FROM (SELECT *, {_NORM} AS s FROM gold) AS g LEFT JOIN {{x}} AS c ON c.claim_id = g.claim_id LEFT JOIN txt AS t ON t.s = g.s)"""
_BASE = """CASE WHEN lower(metric_unit) LIKE '%co2%' THEN 'co2e_mass' WHEN metric_unit IN ('GWh', 'MWh') OR metric_unit LIKE 'GJ%' THEN 'energy' ELSE 'none' END"""
_JUDGED = """jd AS (SELECT h.claim_id, h.is_esg_claim AS prec, CASE WHEN h.is_esg_claim THEN c.normalized_aspect = h.aspect END AS node, CASE WHEN h.is_esg_claim THEN split_part(c.normalized_aspect, '.', 1) = split_part(h.aspect, '.', 1) END AS pillar,
        CASE WHEN h.is_esg_claim AND NOT value_ambiguous AND h.value IS NOT NULL THEN coalesce(CASE WHEN h.value = 0 THEN c.metric_value = 0 ELSE abs(c.metric_value - h.value) / abs(h.value) <= 0.01 END, FALSE) END AS value,
        CASE WHEN h.is_esg_claim AND unit_base IS NOT NULL THEN """ + _BASE + """ = unit_base END AS unit, CASE WHEN h.is_esg_claim THEN c.claim_type = gold_type END AS type FROM hit AS h JOIN {x} AS c ON c.claim_id = h.found_id)"""
_RATE = lambda r: f"count(*) FILTER ({r}) / nullif(count({r}), 0)"
_COMPOSITE = "floor((coalesce(prec, 0) + coalesce(node, 0) + coalesce(value, 0) + coalesce(unit, 0) + coalesce(type, 0)) / ((prec IS NOT NULL)::INT + (node IS NOT NULL)::INT + (value IS NOT NULL)::INT + (unit IS NOT NULL)::INT + (type IS NOT NULL)::INT) * 1000 + 0.5) / 10 AS composite"
_SIDE = lambda x: f"coalesce({x}.source_sentence, 'Unknown claim') AS text_{x}"
_REVIEWED = "reviewed AS MATERIALIZED (SELECT report_id, CAST(claim_id AS VARCHAR) AS subject_id, flag, CASE WHEN (claim_id + CASE WHEN claim_id % 4 = 0 THEN 2 ELSE 1 END) % 2 = 0 THEN 'dismissed' ELSE 'confirmed' END AS verdict FROM flagged WHERE claim_id % 5 = 0)"


def _stage_sql(name: str, source: str) -> str:
    """The judged labels of one stage as ``jd_<name>``."""
    text = f"{_MATCH}, {_JUDGED}".replace(f"{_GOLD}, ", "").replace("{x}", source)
    return re.sub(r"\b(txt|hit|jd)\b", rf"\1_{name}", text)


_DOUBLED = "CASE WHEN source_type = 'table' AND claim_id % 5 = 0 AND metric_value > 0 THEN 2 * metric_value ELSE metric_value END"
_STAGED = f"""{CLAIMS.replace('claims AS (', 'raw AS (', 1)}, claims AS (SELECT * REPLACE ({_DOUBLED} AS metric_value) FROM raw), {GATE_ALL.removeprefix(CLAIMS + ', ')}, {_GOLD.replace('FROM claims', 'FROM raw')}, s0 AS (SELECT * REPLACE (lower(aspect) AS normalized_aspect) FROM raw),
    s4 AS (SELECT * REPLACE (gated_aspect AS normalized_aspect, gated_type AS claim_type) FROM gated), s5 AS (SELECT * FROM s4 WHERE NOT is_furniture),
    {_stage_sql('S0', 's0')}, {_stage_sql('S1', 'raw')}, {_stage_sql('S2', 'claims')}, {_stage_sql('S4', 's4')}, {_stage_sql('S5', 's5')}, jd_S3 AS (SELECT * FROM jd_S2),
    rated AS (SELECT stage, count(*) AS n, {', '.join(f'{_RATE(r)} AS {r}' for r in V.RATES)} FROM ({' UNION ALL '.join(f"SELECT '{x}' AS stage, * FROM jd_{x}" for x in STAGES)}) GROUP BY stage)"""
_POINTS = "round(CASE severity WHEN 'Critical' THEN 50 WHEN 'High' THEN 30 WHEN 'Medium' THEN 16 ELSE 6 END * CASE WHEN n > 0 THEN least(1.0, CAST(n AS DOUBLE) / total) ELSE 0.5 END, 1)"
_GRADE = X.grade("score")
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_CASE = lambda texts, i: "CASE flag " + " ".join(f"WHEN '{k}' THEN {_QUOTED(v[i])}" for k, v in texts.items()) + " END"
_AGAIN = re.sub(r"\b(cand|named|pr|judged|conflicts)\b", r"\1_again", CONFLICTS.removeprefix(ENRICH + ", ")).replace("FROM enriched WHERE", "FROM enriched WHERE claim_type <> 'target' AND company_id % 2 = 0 AND")
ORACLES = {
    "contradiction_replace": f"""WITH {CONFLICTS}, {_AGAIN}, odd AS (SELECT DISTINCT report_id FROM enriched WHERE company_id % 2 <> 0)
        SELECT report_id, claim_a, claim_b, severity, conflict FROM conflicts SEMI JOIN odd USING (report_id) UNION ALL SELECT report_id, claim_a, claim_b, severity, conflict FROM conflicts_again""",
    "conflict_enrich": f"WITH {CONFLICTS}, c AS (SELECT claim_a, CASE WHEN claim_b % 7 = 0 THEN -1 ELSE claim_b END AS claim_b, severity FROM conflicts) SELECT claim_a, claim_b, severity, {_SIDE('a')}, {_SIDE('b')}, a.page_number AS page_a, b.page_number AS page_b FROM c LEFT JOIN claims AS a ON a.claim_id = claim_a LEFT JOIN claims AS b ON b.claim_id = claim_b",
    "review_latest": f"WITH {PLAIN}, {_REVIEWED} SELECT * FROM reviewed",
    "review_queue": f"""WITH {CONFLICTS}, {PLAIN.removeprefix(ENRICH + ', ')}, {_REVIEWED}, items AS (SELECT report_id, CAST(claim_id AS VARCHAR) AS subject_id, flag FROM flagged UNION ALL SELECT report_id, substr(sha1(claim_a || '|' || claim_b || '|' || conflict), 1, 12), 'CONTRADICTION' FROM conflicts UNION ALL SELECT report_id, '__report__', flag FROM structural)
        SELECT report_id, subject_id, flag, verdict, CASE verdict WHEN 'dismissed' THEN 1 WHEN 'confirmed' THEN 2 ELSE 0 END AS queue FROM items LEFT JOIN reviewed USING (report_id, subject_id, flag)""",
    "review_items": f"""WITH {CONFLICTS}, {PLAIN.removeprefix(ENRICH + ', ')}
        SELECT f.report_id, CAST(f.claim_id AS VARCHAR) AS subject_id, flag, 'claim' AS kind, {_CASE(W.CLAIM_FLAGS, 0)} AS title, {_CASE(W.CLAIM_FLAGS, 1)} AS reason, left(source_sentence, 240) AS source_sentence, page_number FROM flagged AS f JOIN enriched AS e ON e.claim_id = f.claim_id
        UNION ALL SELECT report_id, left(sha1(claim_a || '|' || claim_b || '|' || conflict), 12), 'CONTRADICTION', 'contradiction', '{W.INCONSISTENT}', conflict || ' conflict of claims ' || claim_a || ' and ' || claim_b, conflict || ' conflict of claims ' || claim_a || ' and ' || claim_b, NULL FROM conflicts
        UNION ALL SELECT report_id, '__report__', flag, 'report', CASE flag WHEN 'DISCLOSURE_GAP' THEN '{W.NO_SCOPE3}' ELSE '{W.ASPIRING}' END,
            CASE flag WHEN 'DISCLOSURE_GAP' THEN '{W.NO_SCOPE3_REASON}' ELSE CAST(floor(n * 100 / s.total + 0.5) AS INT) || '% of claims are targets/narrative vs. ' || done || ' performance claims.' END, NULL, NULL FROM structural AS s JOIN totals USING (report_id)""",
    "review_scores": f"""WITH {CONFLICTS}, {PLAIN.removeprefix(ENRICH + ', ')}, {_REVIEWED}, gone AS (SELECT report_id, subject_id, flag FROM reviewed WHERE verdict = 'dismissed'),
        kept AS (SELECT f.report_id, f.flag, count(*) AS n FROM flagged AS f ANTI JOIN gone AS g ON g.subject_id = CAST(f.claim_id AS VARCHAR) AND g.flag = f.flag GROUP BY ALL),
        raws AS ({WITH_CONFLICTS}),
        after AS (SELECT k.report_id, CASE WHEN k.flag = 'VAGUE' AND floor(n * 100 / total + 0.5) >= 30 OR k.flag = 'UNSUBSTANTIATED_TARGET' AND n >= 3 OR k.flag = 'NON_GROUNDABLE' AND floor(n * 100 / total + 0.5) >= 40 THEN 'High' ELSE 'Medium' END AS severity, n, total FROM kept AS k JOIN totals USING (report_id)
            UNION ALL SELECT report_id, severity, n, total FROM structural WHERE flag = 'DISCLOSURE_GAP'
            UNION ALL SELECT c.report_id, CASE WHEN bool_or(severity IN ('Critical', 'High')) THEN 'Critical' ELSE 'Medium' END, CAST(sum(pairs) AS BIGINT), any_value(total) FROM conflicts AS c JOIN totals USING (report_id) WHERE conflict <> 'Scope' GROUP BY c.report_id),
        points AS (SELECT side, report_id, sum({_POINTS}) AS points FROM (SELECT 'raw' AS side, report_id, severity, n, total FROM raws UNION ALL SELECT 'after', * FROM after) GROUP BY side, report_id),
        applied AS (SELECT report_id, sum(k) AS k FROM (SELECT report_id, count(*) AS k FROM gone GROUP BY 1 UNION ALL SELECT report_id, count(*) FROM conflicts WHERE conflict = 'Scope' GROUP BY 1 UNION ALL SELECT report_id, count(*) FROM structural WHERE flag = 'ASPIRATIONAL_HEAVY' GROUP BY 1) GROUP BY report_id),
        sc AS (SELECT t.report_id, t.total AS claims, round(greatest(0, least(100, 100 - coalesce(r.points, 0))), 1) AS score_raw, round(greatest(0, least(100, 100 - coalesce(a.points, 0))), 1) AS score, CAST(coalesce(k, 0) AS BIGINT) AS reviews_applied
            FROM totals AS t LEFT JOIN points AS r ON r.report_id = t.report_id AND r.side = 'raw' LEFT JOIN points AS a ON a.report_id = t.report_id AND a.side = 'after' LEFT JOIN applied AS p ON p.report_id = t.report_id)
        SELECT *, {_GRADE} AS grade, CASE WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Moderate' ELSE 'High' END AS risk FROM sc""",
    "flag_details": f"""WITH {PLAIN}, w AS (SELECT f.*, source_sentence, row_number() OVER (PARTITION BY f.report_id, flag ORDER BY f.claim_id) AS r FROM flagged AS f JOIN enriched AS e ON e.claim_id = f.claim_id),
        e5 AS (SELECT report_id, flag, string_agg(claim_id || ' ' || left(source_sentence, 240), ';' ORDER BY r) FILTER (r <= 5) AS evidence FROM w GROUP BY ALL)
        SELECT report_id, flag, severity, n, CAST(floor(n * 100 / total + 0.5) AS BIGINT) AS pct, {_CASE(W.SUMMED, 0)} AS title, replace(replace({_CASE(W.SUMMED, 1)}, '{{n}}', CAST(n AS VARCHAR)), '{{pct}}', CAST(CAST(floor(n * 100 / total + 0.5) AS BIGINT) AS VARCHAR)) AS description, evidence FROM claimed JOIN e5 USING (report_id, flag)""",
    "suggest_questions": f"""WITH {CONFLICTS}, {PLAIN.removeprefix(ENRICH + ', ')}, f AS ({WITH_CONFLICTS}), r AS (SELECT report_id, flag, row_number() OVER (PARTITION BY report_id ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 ELSE 2 END, flag) AS r FROM f)
        SELECT report_id, string_agg(CASE flag WHEN 'VAGUE' THEN 'Which environmental claims lack measurable metrics?' WHEN 'CONTRADICTION' THEN 'Where does this report contradict itself on emissions or targets?' WHEN 'ASPIRATIONAL_HEAVY' THEN 'Which targets have no baseline, deadline, or interim milestones?' ELSE 'What evidence supports the ' || chr(39) || flag || chr(39) || ' flag?' END, ';' ORDER BY r) FILTER (r <= 5) AS questions FROM r GROUP BY report_id""",
    "regions": f"""WITH {WHOLE}, last AS (SELECT company_id, arg_max(report_id, report_year) AS report_id FROM enriched GROUP BY company_id), sc AS (SELECT company_id, score FROM last LEFT JOIN graded USING (report_id)), n AS (SELECT company_id, count(*) AS n FROM enriched GROUP BY company_id),
        r AS (SELECT DISTINCT company_id, CASE WHEN location_text IS NULL THEN 'Global' WHEN lower(location_text) LIKE '%india%' THEN 'Asia Pacific' ELSE 'Other' END AS region FROM enriched)
        SELECT region, count(*) AS companies, CAST(sum(n) AS BIGINT) AS claims, CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score FROM r JOIN n USING (company_id) JOIN sc USING (company_id) GROUP BY region""",
    "ablation": f"WITH {_STAGED} SELECT stage, n, round(node, 6) AS node, round(value, 6) AS value, round(type, 6) AS type, {_COMPOSITE} FROM rated",
    "tradeoff": f"WITH {_STAGED}, c AS (SELECT stage, n, {_COMPOSITE} FROM rated) SELECT a.n AS matched_before, b.n AS matched_after, (SELECT count(*) FROM gated WHERE is_furniture) AS dropped, round(b.composite - a.composite, 1) AS gain FROM c AS a JOIN c AS b ON a.stage = 'S4' AND b.stage = 'S5'",
    "collect_links": """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS text,
            generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) - 1 AS nth FROM pages)
        SELECT page_id, nth, href, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS text, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href ELSE href END AS absolute FROM l""",
    "match_claims": f"WITH {_NEAR('vec_id IS NOT NULL', 'q.label = v.label')} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS place, id, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.2 QUALIFY place <= 10",
    "match_claims_sql": f"WITH {_NEAR('vec_id = (SELECT min(vec_id) FROM embeddings)', 'TRUE')} SELECT label, id AS claim_id, round(similarity, 6) AS similarity FROM s JOIN (SELECT vec_id AS id, label FROM v) USING (id) WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) <= 5",
    "nli_neighbors": f"""WITH {_NEAR('vec_id IS NOT NULL', 'q.label = v.label')}, t AS (SELECT * FROM s WHERE similarity > 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 3)
        SELECT DISTINCT least(query_id, t.id) AS a, greatest(query_id, t.id) AS b, round(similarity, 6) AS similarity FROM t LEFT JOIN documents AS x ON x.doc_id = query_id LEFT JOIN documents AS y ON y.doc_id = t.id WHERE x.text IS NULL OR y.text IS NULL OR x.text <> y.text""",
    "search_claims": f"WITH {_NEAR('vec_id % 100 = 0', 'TRUE')}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS place, max(similarity) OVER (PARTITION BY query_id) < 0.25 AS low_relevance FROM s) SELECT query_id, place, id, round(similarity, 6) AS similarity, low_relevance FROM t WHERE place <= 8",
    "pair_dedup": """WITH p AS (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 60 END AS a, l_suppkey % 60 AS b, l_orderkey * 8 + l_linenumber AS at FROM lineitem)
        SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, FALSE AS open FROM p WHERE a IS NOT NULL AND a <> b UNION ALL SELECT b, b, TRUE FROM p WHERE a IS NULL""",
    "score_join": """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 100 AS INT) AS score FROM supplier WHERE s_suppkey % 3 <> 0) SELECT c.company_id, s.score FROM (SELECT DISTINCT l_suppkey AS company_id FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)) AS c LEFT JOIN s ON s.k = c.company_id""",
    "satellite_relink": f"""WITH {CLAIMS}, k AS (SELECT claim_id, report_id || '|' || normalized_aspect || '|' || coalesce(location_text, '') || '|' || time_bucket AS k FROM claims),
        s AS (SELECT k, max(claim_id) AS at FROM k WHERE claim_id % 6 = 0 GROUP BY k) SELECT max(k.claim_id) AS claim_id, CASE WHEN s.at % 4 = 0 THEN 'supported' ELSE 'inconclusive' END AS verdict, s.at AS "at" FROM s JOIN k USING (k) GROUP BY k, s.at""",
    "page_matched": f"WITH {CLAIMS} SELECT claim_id FROM claims QUALIFY count(*) FILTER (claim_id % 2 = 0) OVER (PARTITION BY report_id, page_number) > 0 AND count(*) FILTER (claim_id % 2 = 1) OVER (PARTITION BY report_id, page_number) > 0",
    "yoy_common": f"""WITH {ENRICH}, f AS (SELECT company_id, metric_key, report_year, arg_min(metric_value, claim_id) AS v FROM enriched WHERE metric_value IS NOT NULL AND metric_key <> 'uncategorized' AND metric_key NOT LIKE '%.unspecified' GROUP BY ALL)
        SELECT a.company_id, a.metric_key, a.report_year, a.v AS value, b.v AS value_next FROM f AS a JOIN f AS b ON a.company_id = b.company_id AND a.metric_key = b.metric_key AND b.report_year = a.report_year + 1""",
    "evidence_quality": f"""WITH {ENRICH}, w AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY groundability, claim_id) AS r FROM enriched)
        SELECT report_id, count(*) AS claims, count(*) FILTER (groundability >= 0.75) AS high, count(*) FILTER (groundability >= 0.5 AND groundability < 0.75) AS medium, count(*) FILTER (groundability < 0.5) AS low,
            floor(count(*) FILTER (metric_value IS NULL) * 1000 / count(*) + 0.5) / 10 AS no_metric, floor(count(*) FILTER (time_bucket = 'unknown_time') * 1000 / count(*) + 0.5) / 10 AS no_time, floor(count(*) FILTER (location_text IS NULL) * 1000 / count(*) + 0.5) / 10 AS no_place,
            count(*) FILTER (claim_type = 'narrative') AS narrative, string_agg(claim_id, ',' ORDER BY r) FILTER (r <= 6) AS weakest FROM w GROUP BY report_id""",
    "evidence_template": f"""WITH {ENRICH} SELECT company_id, metric_key, time_bucket AS year, count(*) AS n, arg_min(metric_value, claim_id) FILTER (metric_value IS NOT NULL) AS example FROM enriched WHERE metric_key <> 'uncategorized' AND time_bucket <> 'unknown_time' GROUP BY ALL ORDER BY n DESC, company_id, metric_key, year LIMIT 40""",
    "system_stats": f"""WITH {ENRICH}, u AS (SELECT *, floor(groundability * 100 + 0.5) AS confidence FROM enriched) SELECT 'total' AS name, count(*) AS n FROM u UNION ALL SELECT 'high', count(*) FROM u WHERE confidence >= 75 UNION ALL SELECT 'medium', count(*) FROM u WHERE confidence >= 50 AND confidence < 75
        UNION ALL SELECT 'low', count(*) FROM u WHERE confidence < 50 UNION ALL SELECT 'with_metric', count(metric_value) FROM u UNION ALL SELECT 'with_location', count(location_text) FROM u
        UNION ALL (SELECT 'aspect ' || normalized_aspect, count(*) AS n FROM u GROUP BY normalized_aspect ORDER BY n DESC, normalized_aspect LIMIT 12) UNION ALL SELECT 'type ' || claim_type, count(*) FROM u GROUP BY claim_type""",
    "ui_risk": f"""WITH {ENRICH}, u AS (SELECT company_id, {STATUS} AS status FROM enriched), c AS (SELECT company_id, count(*) AS n, count(*) FILTER (status = 'gap') AS g, count(*) FILTER (status = 'review') AS r FROM u GROUP BY company_id)
        SELECT company_id, floor((g * 8 + r * 2) / (10 * n) * 1e4 + 0.5) / 1e4 AS risk, CASE WHEN g > n * 0.1 THEN 'High Risk' ELSE 'Moderate Risk' END AS status FROM c""",
    "paired_z": """WITH p AS (SELECT a.vec_id // 2 AS pair, list_transform(list_zip(b.embedding, a.embedding), lambda z: CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) AS d FROM embeddings AS a JOIN embeddings AS b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
        m AS (SELECT pair, len(d) AS n, list_avg(d) AS m, list_stddev_pop(d) AS sd FROM p), z AS (SELECT pair, CAST(n AS INT) AS n, round(m, 4) AS delta, round(m / (CASE WHEN sd = 0 THEN 1e-6 ELSE sd END / sqrt(greatest(1e0, n / 16e0))), 2) AS z FROM m)
        SELECT *, CASE WHEN abs(delta) < 0.05 OR abs(z) < 2 THEN 'inconclusive' WHEN delta > 0 THEN 'supported' ELSE 'not_supported' END AS verdict FROM z""",
    "ndvi_median": """WITH s AS (SELECT label AS place, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 37, vec_id) <= 4),
        p AS (SELECT place, unnest(v[1:32]) AS nir, unnest(v[33:64]) AS red, CAST(generate_subscripts(v[1:32], 1) - 1 AS INT) AS pixel FROM s) SELECT place, pixel, round(median((nir - red) / (nir + red)), 6) AS ndvi FROM p WHERE nir + red > 0 GROUP BY place, pixel""",
    "gold_match": f"WITH {CLAIMS}, {_MATCH.replace('{x}', 'claims')} SELECT claim_id, how, found_id FROM hit",
    "eval_metrics": f"""WITH {CLAIMS}, {_MATCH.replace('{x}', 'claims')}, {_JUDGED.replace('{x}', 'claims')}, r AS (SELECT count(*) AS n, {', '.join(f'{_RATE(r)} AS {r}' for r in [*V.RATES, 'pillar'])} FROM jd)
        SELECT n, {', '.join(f'round({r}, 6) AS {r}' for r in [*V.RATES, 'pillar'])}, {_COMPOSITE} FROM r""",
    "grounding": """WITH p AS (SELECT p_partkey % 10 <> 0 OR p_partkey = 0 AS held, p_partkey % 3 = 0 AS found FROM part)
        SELECT count(*) FILTER (held) AS checked, count(*) FILTER (held AND found) AS grounded, count(*) FILTER (NOT held) AS skipped, floor(count(*) FILTER (held AND found) / count(*) FILTER (held) * 1e4 + 0.5) / 1e4 AS precision FROM p""",
    "frame_describe": f"""WITH {CELLS}, u AS (SELECT CASE WHEN col = 2 THEN 'C_other' WHEN regexp_matches(lower(label || ' ' || "column"), '(^|[^a-z])(emission|waste|water|employee)') THEN 'A_numeral_and_esg' ELSE 'B_numeral_only' END AS stratum FROM cells)
        SELECT stratum, count(*) AS units, floor(count(*) / (SELECT count(*) FROM u) * 1000 + 0.5) / 10 AS share FROM u GROUP BY stratum""",
    "stratified_sample": f"""WITH {CELLS}, u AS (SELECT 'tbl_' || substr(sha1(page_id || '|' || island || '|' || row || '|' || col), 1, 12) AS unit_id, CASE WHEN col = 2 THEN 'C_other' WHEN regexp_matches(lower(label || ' ' || "column"), '(^|[^a-z])(emission|waste|water|employee)') THEN 'A_numeral_and_esg' ELSE 'B_numeral_only' END AS stratum FROM cells),
        n AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS f, row_number() OVER (PARTITION BY stratum ORDER BY sha1('42|' || unit_id), unit_id) AS r FROM u), q AS (SELECT *, least(f, CASE stratum WHEN 'A_numeral_and_esg' THEN 240 WHEN 'B_numeral_only' THEN 100 ELSE 60 END) AS q FROM n)
        SELECT unit_id, stratum, floor(q / f * 1e6 + 0.5) / 1e6 AS inclusion_prob, floor(f / q * 1e4 + 0.5) / 1e4 AS ipw_weight FROM q WHERE r <= q""",
    "gold_diff": f"""WITH {CLAIMS}, {_GOLD}, g AS (SELECT * FROM gold WHERE claim_id > 0), a AS (SELECT claim_id FROM g WHERE claim_id % 19 = 0 AND claim_id % 11 <> 0), r AS (SELECT claim_id FROM g WHERE claim_id % 19 <> 0 AND claim_id % 11 = 0), b AS (SELECT * FROM g WHERE claim_id % 19 <> 0 AND claim_id % 11 <> 0)
        SELECT claim_id, 'ADDED' AS change, NULL AS field FROM a UNION ALL SELECT claim_id, 'REMOVED', NULL FROM r UNION ALL SELECT claim_id, 'CHANGED', 'aspect' FROM b WHERE claim_id % 13 = 0 UNION ALL SELECT claim_id, 'CHANGED', 'value' FROM b WHERE claim_id % 17 = 0 AND value IS NOT NULL""",
    "provenance_check": "SELECT p_partkey AS page_id, p_partkey % 2 = 1 AS found FROM part",
    "interaction": f"""WITH {CLAIMS}, r AS (SELECT CASE WHEN claim_id % 2 = 0 THEN 'recall' ELSE 'grounding' END AS lane, claim_id % 4 >= 2 AS hi, claim_id % 8 >= 4 AS rep, count(*) FILTER (CASE WHEN claim_id % 8 >= 4 THEN claim_id % 3 <> 0 ELSE claim_id % 5 <> 0 END) / count(*) AS rate FROM claims GROUP BY ALL),
        g AS (SELECT lane, max(rate) FILTER (NOT hi AND rep) - max(rate) FILTER (NOT hi AND NOT rep) AS l, max(rate) FILTER (hi AND rep) - max(rate) FILTER (hi AND NOT rep) AS h FROM r GROUP BY lane)
        SELECT lane, round(l, 6) AS gain_low, round(h, 6) AS gain_high, round(h - l, 6) AS interaction, CASE WHEN h > 0.005 AND l > 0.005 THEN CASE WHEN h >= l - 0.005 THEN 'helps at both' ELSE 'helps at both, shrinks' END WHEN h > 0.005 THEN 'helps the stronger only' WHEN l > 0.005 THEN 'helps the weaker only'
            WHEN h < -0.005 AND l < -0.005 THEN 'costs at both' WHEN h < -0.005 THEN 'costs the stronger' WHEN l < -0.005 THEN 'costs the weaker' ELSE 'inert' END AS verdict FROM g""",
    "ingest_replace": f"WITH {CLAIMS} SELECT claim_id, report_id, CASE WHEN report_id LIKE '%_1995' AND report_id IN (SELECT report_id FROM claims WHERE claim_id % 2 = 0) THEN -1e0 ELSE metric_value END AS metric_value FROM claims WHERE NOT (report_id LIKE '%_1995' AND claim_id % 2 = 1 AND report_id IN (SELECT report_id FROM claims WHERE claim_id % 2 = 0))",
    "report_upsert": f"WITH {CLAIMS} SELECT report_id, CASE WHEN company_id % 2 = 0 THEN -count(*) ELSE count(*) END AS claims, company_id FROM claims GROUP BY report_id, company_id UNION ALL SELECT 'r_new', 0, -1",
    "resume_units": f"WITH {CLAIMS} SELECT CAST(claim_id AS VARCHAR) AS unit FROM claims WHERE claim_id % 2 = 1 OR claim_id % 10 = 0",
    "claims_snapshot": f"WITH {CLAIMS} SELECT claim_id, company_name, report_year, aspect, normalized_aspect, action, claim_type, metric_value, metric_unit, time_bucket, location_scope, left(source_sentence, 200) AS source_sentence FROM claims",
    "metadata_backfill": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'kept' WHEN lower(text) LIKE '%the%' OR lower(source) LIKE '%the%' THEN 'The Company' WHEN lower(text) LIKE '%web%' OR lower(source) LIKE '%web%' THEN 'Web Company' WHEN lower(text) LIKE '%de%' OR lower(source) LIKE '%de%' THEN 'De Company' END AS company FROM documents",
    "infer_metadata": """SELECT s_suppkey, y AS report_year, n AS company_name, lower(replace(n, ' ', '_')) AS company_id, lower(replace(n, ' ', '_')) || '_' || y AS report_id FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 2024 WHEN 1 THEN 2000 + s_suppkey % 30 WHEN 4 THEN 2019 ELSE 2024 END AS y,
        CASE s_suppkey % 5 WHEN 0 THEN 'Tata Power' || CASE WHEN s_suppkey > 9 THEN ' ' || s_suppkey ELSE '' END WHEN 1 THEN 'Shell' WHEN 2 THEN 'Esg' WHEN 3 THEN 'Acme Things' ELSE 'X 2019' END AS n FROM supplier)""",
    "page_ranges": "WITH p AS (SELECT DISTINCT l_suppkey AS doc, l_partkey % 50 AS page FROM lineitem), i AS (SELECT *, page - dense_rank() OVER (PARTITION BY doc ORDER BY page) AS g FROM p) SELECT doc, min(page) AS first, max(page) AS last FROM i GROUP BY doc, g",
    "audit_counts": f"WITH {CLAIMS} SELECT count(*) AS claims, count(DISTINCT report_id) AS reports, count(DISTINCT company_id) AS companies, count(*) - count(metric_value) AS no_metric_value, count(*) - count(location_text) AS no_location_text, count(*) - count(metric_direction) AS no_metric_direction, 0 AS no_time_bucket FROM claims",
}
