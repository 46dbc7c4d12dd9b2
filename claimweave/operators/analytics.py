"""Comparisons, conflicts and scores over enriched claims."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import expressions as X
from claimweave.operators.ordering import running_sums
from claimweave.sources.tables import in_parts, settled

MEANINGFUL = "metric_key <> 'uncategorized' AND metric_key NOT LIKE '%.unspecified'"
#: What a sentence says, figures and signs aside; one that has nothing else is ``#``, only a blank one counts as missing.
STATEMENT = r"CASE WHEN trim(source_sentence) <> '' THEN coalesce(nullif(trim(regexp_replace(regexp_replace(lower(source_sentence), '[0-9[^\\p{L}\\p{N}\\s]]+', ''), '\\s+', ' ')), ''), '#') END"
#: Points by severity, and the prevalence of a flag about the whole report.
WEIGHTS = {"Critical": 50.0, "High": 30.0, "Medium": 16.0, "Low": 6.0}
WHOLE_REPORT = 0.5


def reported(claims: DataFrame) -> DataFrame:
    """Claims that report a figure: plausible, not narrative, no zero that stands for a gap; with the year
    that the figure describes."""
    year = F.expr("CASE WHEN time_bucket RLIKE '^[0-9]{4}$' THEN CAST(time_bucket AS INT) ELSE report_year END")
    kept = claims.where(f"metric_value IS NOT NULL AND claim_type <> 'narrative' AND value_plausible AND NOT {X.artefact_zero('metric_key', 'metric_value')}")
    return kept.withColumn("metric_year", year).withColumn("unit", F.coalesce("canonical_unit", F.lit("")))


def representative(claims: DataFrame) -> DataFrame:
    """One figure for each company, metric and year: the median of the values in the commonest unit, the
    alphabetically first unit among equals."""
    groups = reported(claims).groupBy("company_id", "metric_key", "metric_year", "unit")
    by_unit = groups.agg(F.count("*").alias("n"), F.median("canonical_value").alias("value"))
    modal = Window.partitionBy("company_id", "metric_key", "metric_year").orderBy(F.desc("n"), "unit")
    return by_unit.withColumn("r", F.row_number().over(modal)).where("r = 1").select("company_id", "metric_key", "metric_year", "unit", F.round("value", 4).alias("value"))


def cross_company(claims: DataFrame, year: int | None = None) -> DataFrame:
    """Each company's latest figure of each metric among its peers in the commonest unit: rank by polarity,
    percentile, distance from the median, and whether there are enough peers."""
    rep = representative(claims)
    if year is not None:
        rep = rep.where(F.col("metric_year") <= year)
    latest = rep.groupBy("company_id", "metric_key").agg(F.max_by(F.struct("metric_year", "unit", "value"), "metric_year").alias("l")).select("company_id", "metric_key", "l.*")
    units = latest.groupBy("metric_key", "unit").agg(F.count("*").alias("n"))
    unit = units.groupBy("metric_key").agg(F.max_by("unit", F.struct("n", "unit")).alias("unit"))
    peers = latest.join(unit, ["metric_key", "unit"]).withColumn("polarity", F.expr(X.polarity("metric_key")))
    goodness = F.when(F.col("polarity") == "higher_better", F.col("value")).otherwise(-F.col("value"))
    key = Window.partitionBy("metric_key")
    order = key.orderBy(F.desc("good"), "company_id")
    worse = F.count("*").over(key.orderBy("good").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count("*").over(Window.partitionBy("metric_key", "good"))
    ranked = peers.withColumn("good", goodness).withColumns({"n": F.count("*").over(key), "rank": F.row_number().over(order), "worse": worse, "tenk": F.round(F.col("value") * 10000).cast("long")})
    # twice the median in ten-thousandths, a whole number, so that no rounding tie decides
    ranked = ranked.withColumn("median", (2 * F.median("tenk").over(key)).cast("long"))
    return ranked.select(
        "metric_key", "company_id", "metric_year", "unit", "value", "polarity", "rank",
        F.when(F.col("n") == 1, F.lit(100)).otherwise(F.floor(F.col("worse") * 100 / (F.col("n") - 1) + 0.5)).cast("int").alias("percentile"),
        (F.floor((2 * F.col("tenk") - F.col("median") + 1) / 2) / 1e4).alias("vs_median"), (F.floor((F.col("median") + 1) / 2) / 1e4).alias("median"), F.col("n").alias("peers"),
        F.when(F.col("n") < 3, "low").otherwise("ok").alias("confidence"),
    )


def scorecard(claims: DataFrame, min_peers: int = 2) -> DataFrame:
    """Where each company stands in the metrics it shares with enough peers."""
    verdict = F.when(F.col("percentile") >= 66, "leading").when(F.col("percentile") <= 33, "lagging").otherwise("mid-pack")
    return cross_company(claims).where((F.col("peers") >= min_peers) & F.expr(MEANINGFUL)).select("company_id", "metric_key", "rank", "peers", "percentile", verdict.alias("verdict"))


def trajectory(claims: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """First and last year of each company's metric: change, share, yearly rate, compound rate and trend.

    With ``targets`` (company_id, metric_key, target_value, target_year): the gap to the target, the yearly
    change that it asks for, and whether the change so far is enough, by the metric's polarity.
    """
    rep = representative(claims)
    ends = rep.groupBy("company_id", "metric_key").agg(
        F.min("metric_year").alias("first_year"), F.max("metric_year").alias("last_year"), F.min_by("value", "metric_year").alias("first_value"), F.max_by("value", "metric_year").alias("last_value"), F.count("*").alias("points")
    )
    span = F.col("last_year") - F.col("first_year")
    change = F.col("last_value") - F.col("first_value")
    growth = F.when((F.col("first_value") > 0) & (F.col("last_value") > 0), F.pow(F.col("last_value") / F.col("first_value"), 1 / span) - 1)
    trend = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    moved = ends.where("points > 1").select(
        "company_id", "metric_key", "first_year", "last_year", "points", "last_value", F.round(change, 4).alias("change"),
        F.round(F.try_divide(change * 100, F.abs("first_value")), 1).alias("change_pct"), F.round(change / span, 4).alias("per_year"), F.round(growth, 4).alias("cagr"), trend.alias("trend"),
    )
    if targets is None:
        return moved.drop("last_value")
    aimed = moved.join(targets, ["company_id", "metric_key"])
    gap = F.col("target_value") - F.col("last_value")
    need = F.try_divide(gap, F.col("target_year") - F.col("last_year"))
    polarity = F.expr(X.polarity("metric_key"))
    on_track = F.when(polarity == "lower_better", F.col("per_year") <= need).when(polarity == "higher_better", F.col("per_year") >= need)
    return aimed.select("company_id", "metric_key", "trend", "per_year", (F.floor(gap * 1e4 + 0.5) / 1e4).alias("gap"), (F.floor(need * 1e4 + 0.5) / 1e4).alias("required_per_year"), on_track.alias("on_track"))


CLASS = ["report_id", "metric_key", "time_bucket", "location_scope", "statement", "value", "unit", "direction"]


def conflict_classes(claims: DataFrame) -> DataFrame:
    """Claims that can be compared, those alike in all that decides a conflict as one class: ``claim_id``, the
    least of its members, and how many there are."""
    base = claims.where(f"{MEANINGFUL} AND value_plausible AND coalesce(lower(trim(time_bucket)), '') NOT IN ('', 'unknown_time', 'unknown', 'null', 'none', 'n/a')")
    base = base.withColumns({"statement": F.expr(f"coalesce({STATEMENT}, '')"), "value": F.col("canonical_value"), "unit": F.expr("coalesce(lower(trim(canonical_unit)), '')"), "direction": F.lower("metric_direction")})
    return base.groupBy(*CLASS).agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("members"))


def numeric_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of a report's claim classes that cannot both hold, each pair once, with the members of both.

    Claims of one metric and year in one unit (or an unknown one) are compared. Values over 5 % apart in the
    same statement (digits and signs aside; a missing one counts as the same) conflict in the metric (same
    scope) or by scope; unlike statements report unlike things, and the pair is passed over.
    Where the values do not differ, opposite directions in the same scope are a hard conflict.
    """
    c = settled(conflict_classes(claims))  # read by every join below; statements are made once
    a, b = c.alias("a"), c.alias("b")
    key = "a.report_id = b.report_id AND a.metric_key = b.metric_key AND a.time_bucket = b.time_bucket"
    unit = "(a.unit = '' OR b.unit = '' OR a.unit = b.unit)"
    apart = "coalesce(abs(a.value) > 1e-9 AND abs(b.value) > 1e-9 AND abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) > 0.05, false)"
    pair = [F.col("a.report_id").alias("report_id"), F.least("a.claim_id", "b.claim_id").alias("claim_a"), F.greatest("a.claim_id", "b.claim_id").alias("claim_b")]
    pair += [F.when(F.col("a.claim_id") < F.col("b.claim_id"), F.col(f"{x}.members")).otherwise(F.col(f"{y}.members")).alias(f"members_{x}") for x, y in ("ab", "ba")]
    scope = F.expr("CASE WHEN a.location_scope <=> b.location_scope THEN 'Metric' WHEN a.location_scope <> '' AND b.location_scope <> '' THEN 'Scope' END")
    said = a.join(b, F.expr(f"{key} AND a.statement = b.statement AND a.statement <> '' AND a.claim_id < b.claim_id AND {unit} AND {apart}"))
    unsaid = a.where("statement = ''").join(b, F.expr(f"{key} AND (b.statement <> '' OR a.claim_id < b.claim_id) AND {unit} AND {apart}"))
    turned = a.where("direction = 'increase'").join(b.where("direction = 'decrease'"), F.expr(f"{key} AND a.location_scope <=> b.location_scope AND {unit} AND NOT {apart}"))
    found = said.select(*pair, scope.alias("conflict")).unionByName(unsaid.select(*pair, scope.alias("conflict"))).unionByName(turned.select(*pair, F.lit("Hard").alias("conflict")))
    severity = F.when(F.col("conflict") == "Metric", "High").when(F.col("conflict") == "Scope", "Low").otherwise("Critical")
    return found.where("conflict IS NOT NULL").withColumn("severity", severity)


def _reach(value: str, up: bool) -> Column:
    """The greatest (or least) value that is not over 30 % from ``value``: the difference over the larger of both, or of 1."""
    a = F.col(value) if up else -F.col(value)
    end = F.when(a >= 0.7, a / 0.7).when(a >= -1, a + 0.3).otherwise(a * 0.7)
    end = end + 1e-9 * F.greatest(F.abs(end), F.lit(1.0))
    return end if up else -end


def _within(classes: DataFrame, group: list[str]) -> DataFrame:
    """(cid, n, turned_n): members of a class's group whose value is not apart from its own, and those of them with the
    opposite direction: running sums of members in order of values, at both ends of what is near."""
    valued = classes.where("metric_value IS NOT NULL")
    point = valued.select(*group, F.col("metric_value").alias("at"), F.lit(1).alias("kind"), "cid", "way", F.col("members").alias("n"), F.expr("CASE WHEN way > 0 THEN members ELSE 0 END").alias("n_up"), F.expr("CASE WHEN way < 0 THEN members ELSE 0 END").alias("n_down"))
    ask = lambda kind: valued.select(*group, _reach("metric_value", kind == 2).alias("at"), F.lit(kind).alias("kind"), "cid", "way", *(F.lit(0).cast("long").alias(n) for n in ("n", "n_up", "n_down")))
    events = point.unionByName(ask(0)).unionByName(ask(2))
    summed = running_sums(events, [*(F.asc(g) for g in group), F.asc("at"), F.asc("kind"), F.asc("cid")], {"all": "n", "ups": "n_up", "downs": "n_down"})
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    turned = F.when(F.col("way") > 0, F.col("downs")).when(F.col("way") < 0, F.col("ups")).otherwise(0)
    return summed.where("kind <> 1").groupBy("cid").agg(F.sum(sign * F.col("all")).alias("n"), F.sum(sign * turned).alias("turned_n"))


#: Values of a group up to which they meet each other; more are summed in order.
FEW = 32


def _within_few(classes: DataFrame, group: list[str]) -> DataFrame:
    """As ``_within``, for groups of few values."""
    valued = classes.where("metric_value IS NOT NULL").withColumns({"__low": _reach("metric_value", False), "__high": _reach("metric_value", True)})
    other = valued.select(*group, F.col("metric_value").alias("__value"), F.col("way").alias("__way"), F.col("members").alias("__members"))
    met = valued.join(other, group).where("__value BETWEEN __low AND __high")
    return met.groupBy("cid").agg(F.sum("__members").alias("n"), F.sum(F.expr("CASE WHEN way * __way = -1 THEN __members ELSE 0 END")).alias("turned_n"))


def signature_conflicts(claims: DataFrame) -> DataFrame:
    """For every class of claims of one signature, report, value and direction: how many claims of that signature
    in other reports have the opposite direction, a value over 30 % apart, or either.

    Values near a value are an interval, so the members in it are the difference of two running sums over the values of a
    signature in order; the same within the report is taken off. Running sums are spread over tasks, however many values a
    signature has. Over all reports equal values of one direction stand together; up to FEW values meet each other instead. Ends of an interval count as near, to nine digits.
    """
    ways = F.expr("CASE WHEN metric_direction IN ('increase', 'increased') THEN 1 WHEN metric_direction IN ('decrease', 'decreased') THEN -1 ELSE 0 END")
    value = F.expr("CASE WHEN NOT isnan(metric_value) THEN metric_value END")
    base = claims.where("claim_signature <> ''").select("claim_signature", "report_id", value.alias("metric_value"), ways.alias("way"))
    own = base.groupBy("claim_signature", "report_id", "metric_value", "way").agg(F.count("*").alias("members"))
    own = settled(own.withColumn("cid", F.monotonically_increasing_id()))
    found = own
    for name, group in (("all", ["claim_signature"]), ("own", ["claim_signature", "report_id"])):
        same = [*group, "metric_value", "way"]
        classes = own
        if name == "all":
            classes = settled(own.groupBy(*same).agg(F.sum("members").alias("members")).withColumn("cid", F.monotonically_increasing_id()))
        sums = classes.groupBy(*group).agg(
            F.count("metric_value").alias("several"), F.sum(F.expr("CASE WHEN metric_value IS NOT NULL THEN members ELSE 0 END")).alias("valued"),
            *(F.sum(F.expr(f"CASE WHEN {c} THEN members ELSE 0 END")).alias(n) for n, c in (("ups", "way > 0"), ("downs", "way < 0"), ("valued_ups", "way > 0 AND metric_value IS NOT NULL"), ("valued_downs", "way < 0 AND metric_value IS NOT NULL"))),
        )
        opposite = lambda prefix: F.when(F.col("way") > 0, F.col(f"{prefix}downs")).when(F.col("way") < 0, F.col(f"{prefix}ups")).otherwise(0)
        has = F.col("metric_value").isNotNull()
        classes = settled(classes.join(sums, group))
        near = _within(classes.where(F.col("several") > FEW), group).unionByName(_within_few(classes.where(F.col("several").between(2, FEW)), group))
        met = classes.join(near, "cid", "left")
        met = met.withColumns({"n": F.coalesce("n", "members"), "turned_n": F.coalesce("turned_n", F.lit(0))})
        turned, apart = opposite(""), F.when(has, F.col("valued") - F.col("n")).otherwise(0)
        both = F.when(has, opposite("valued_") - F.col("turned_n")).otherwise(0)
        met = met.select(*(F.col(c).alias(f"__{c}") for c in same), *(c.cast("long").alias(f"{k}_{name}") for k, c in (("turned", turned), ("apart", apart), ("links", turned + apart - both))))
        on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same))
        found = found.join(met, on).drop(*(f"__{c}" for c in same))
    left = [(F.col(f"{n}_all") - F.col(f"{n}_own")).alias(n) for n in ("turned", "apart", "links")]
    return found.select("claim_signature", "report_id", "metric_value", "way", "members", *left).where("links > 0")


def timeline_anomalies(claims: DataFrame) -> DataFrame:
    """Report years in which a company's first value for an aspect moved against the direction it states; a
    zero on either side is passed over."""
    valued = claims.where("metric_value IS NOT NULL AND company_id IS NOT NULL AND report_year IS NOT NULL AND normalized_aspect <> ''")
    first = valued.groupBy("company_id", "normalized_aspect", "report_year").agg(F.min_by(F.struct("metric_value", "metric_direction"), "claim_id").alias("f"))
    years = Window.partitionBy("company_id", "normalized_aspect").orderBy("report_year")
    moved = first.select("company_id", "normalized_aspect", "report_year", "f.*").withColumns({"before": F.lag("metric_value").over(years), "year_from": F.lag("report_year").over(years)})
    against = "(metric_direction IN ('increase', 'increased') AND metric_value < before) OR (metric_direction IN ('decrease', 'decreased', 'reduced') AND metric_value > before)"
    kept = moved.where(f"before <> 0 AND metric_value <> 0 AND ({against})")
    return kept.select("company_id", "normalized_aspect", "year_from", F.col("report_year").alias("year_to"), F.col("before").alias("value_from"), F.col("metric_value").alias("value_to"), "metric_direction")


def claim_flags(claims: DataFrame) -> DataFrame:
    """(claim_id, report_id, flag) of each warning that a claim gives."""
    timed = "time_bucket NOT IN ('unknown_time', 'none', 'null', '')"
    flags = {
        "VAGUE": "vagueness >= 0.6",
        "UNSUBSTANTIATED_TARGET": f"claim_type = 'target' AND (metric_value IS NULL OR NOT {timed})",
        "MISSING_BASELINE": f"claim_type = 'performance' AND metric_direction IN ('increase', 'decrease') AND NOT {timed}",
        "NON_GROUNDABLE": "groundability < 0.4",
        "SELECTIVE_SCOPE": "metric_value IS NOT NULL AND location_scope NOT IN ('global', '', 'group', 'company')",
    }
    found = F.array(*(F.when(F.expr(c), F.lit(f)) for f, c in flags.items()))
    return claims.select("claim_id", "report_id", F.explode(found).alias("flag")).where("flag IS NOT NULL")


def report_flags(claims: DataFrame, dismissed: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """(report_id, flag, severity, n, total): the flags of each report with how many claims raise them;
    dismissed ones (claim_id, flag) are left out, structural flags have n = 0."""
    flagged = claim_flags(claims)
    if dismissed is not None:
        flagged = flagged.join(dismissed, ["claim_id", "flag"], "left_anti")
    totals = claims.groupBy("report_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("claim_type") == "performance").alias("done"),
        F.count_if(F.col("claim_type").isin("target", "narrative")).alias("promised"),
        F.bool_or(F.col("metric_family").startswith("emissions")).alias("emits"),
        F.bool_or(F.col("normalized_aspect").startswith("emissions.scope3") | F.lower("source_sentence").contains("scope 3")).alias("scope3"),
    )
    counted = flagged.groupBy("report_id", "flag").agg(F.count("*").alias("n")).join(totals.select("report_id", "total"), "report_id")
    pct = F.floor(F.col("n") * 100 / F.col("total") + 0.5)
    severity = (
        F.when(F.col("flag") == "VAGUE", F.when(pct >= 30, "High").otherwise("Medium"))
        .when(F.col("flag") == "UNSUBSTANTIATED_TARGET", F.when(F.col("n") >= 3, "High").otherwise("Medium"))
        .when(F.col("flag") == "NON_GROUNDABLE", F.when(pct >= 40, "High").otherwise("Medium"))
        .otherwise("Medium")
    )
    out = counted.select("report_id", "flag", severity.alias("severity"), "n", "total")
    gap = totals.where("emits AND NOT scope3").select("report_id", F.lit("DISCLOSURE_GAP").alias("flag"), F.lit("High").alias("severity"), F.lit(0).cast("long").alias("n"), "total")
    heavy = totals.where("total >= 10 AND done > 0 AND promised / done >= 2").select("report_id", F.lit("ASPIRATIONAL_HEAVY").alias("flag"), F.lit("Medium").alias("severity"), F.col("promised").alias("n"), "total")
    out = out.unionByName(gap).unionByName(heavy)
    if conflicts is not None:
        bad = conflicts.groupBy("report_id").agg(F.sum(F.col("members_a") * F.col("members_b")).alias("n"), F.bool_or(F.col("severity").isin("Critical", "High")).alias("grave"))
        bad = bad.join(totals.select("report_id", "total"), "report_id")
        out = out.unionByName(bad.select("report_id", F.lit("CONTRADICTION").alias("flag"), F.when(F.col("grave"), "Critical").otherwise("Medium").alias("severity"), "n", "total"))
    return out


def integrity_score(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """100 less each flag's severity points times its prevalence, clamped; grade and risk."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("severity")]
    share = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") / F.col("total"))).otherwise(WHOLE_REPORT)
    points = flags.select("report_id", F.round(weight * share, 1).alias("points")).groupBy("report_id").agg(F.sum("points").alias("points"))
    every = claims.groupBy("report_id").agg(F.count("*").alias("claims"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.coalesce("points", F.lit(0.0))))
    scored = every.join(points, "report_id", "left").withColumn("score", F.round(score, 1))
    risk = F.when(F.col("score") >= 70, "Low").when(F.col("score") >= 50, "Moderate").otherwise("High")
    return scored.select("report_id", "claims", "score", F.expr(X.grade("score")).alias("grade"), risk.alias("risk"))


def conflicting_scores(claims: DataFrame, dismiss: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``integrity_score`` with the conflicts of each report, less the flags that ``dismiss`` finds among claims; in parts, by report."""

    def score(c: DataFrame) -> DataFrame:
        return integrity_score(c, report_flags(c, dismiss(c) if dismiss else None, numeric_conflicts(c)))

    return in_parts(score, "report_id", claims)


def risk_score(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """0 to 1 for each report: vague, conflicting, narrative and unmeasured claims, weighted."""
    shares = claims.groupBy("report_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("vagueness") >= 0.4).alias("vague"), F.count_if(F.col("claim_type") == "narrative").alias("narrative"), F.count_if(F.col("metric_value").isNull()).alias("missing")
    )
    joined = shares.join(conflicts.groupBy("report_id").agg(F.sum(F.col("members_a") * F.col("members_b")).alias("conflicts")), "report_id", "left").fillna(0, ["conflicts"])
    risk = F.least(F.lit(1.0), (4 * F.col("vague") + 3 * F.col("conflicts") + 2 * F.col("narrative") + F.col("missing")) / (10 * F.col("n")))
    status = F.when(F.col("risk") > 0.6, "High Risk").when(F.col("risk") > 0.3, "Moderate Risk").otherwise("Low Risk")
    return joined.withColumn("risk", risk).select("report_id", "vague", "narrative", "missing", "conflicts", "risk", status.alias("status"))


def portfolio(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """The latest report of each company with its score; order by score, best first and nulls last, to show it."""
    reports = claims.groupBy("company_id", "report_id").agg(F.max("report_year").alias("report_year"), F.count("*").alias("claims"))
    latest = reports.groupBy("company_id").agg(F.max_by(F.struct("report_id", "claims"), F.struct("report_year", "report_id")).alias("r"), F.max("report_year").alias("report_year"))
    return latest.select("company_id", "r.report_id", "report_year", "r.claims").join(scores.drop("claims"), "report_id", "left")
