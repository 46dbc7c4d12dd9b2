"""What reviewers see and decide: every item with its reason, flags with evidence, scores before and after review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators import analytics as A

# Titles and reasons of a claim's flags, and of a report's; titles and descriptions of flags in sum.
CLAIM_FLAGS = {
    "VAGUE": ("Vague, unsubstantiated environmental claim", "Vague language with no measurable metric — a primary greenwashing signal."),
    "UNSUBSTANTIATED_TARGET": ("Target without baseline, metric, or deadline", "A target/pledge with no measurable metric or deadline — not verifiable as written."),
    "MISSING_BASELINE": ("Performance claim with no baseline period", "An increase/decrease claim with no time period, so the change cannot be judged."),
    "NON_GROUNDABLE": ("Claim cannot be verified against evidence", "Groundability score below threshold — no observable basis to verify it."),
    "SELECTIVE_SCOPE": ("Selective scope (potential cherry-picking)", "A quantified claim reporting only a narrow geography/scope rather than group-wide."),
}
SUMMED = {
    "VAGUE": ("Vague, unsubstantiated environmental claims", "{n} claims ({pct}%) are vague with no measurable metric — a primary greenwashing signal."),
    "UNSUBSTANTIATED_TARGET": ("Targets without baseline, metric, or deadline", "{n} target/pledge claims lack a measurable metric or a deadline — not verifiable."),
    "MISSING_BASELINE": ("Performance claims with no baseline period", "{n} 'increase/decrease' claims have no time period, so the change cannot be judged."),
    "NON_GROUNDABLE": ("Claims that cannot be verified against evidence", "{n} claims ({pct}%) score below the groundability threshold — no observable basis."),
    "SELECTIVE_SCOPE": ("Selective scope (potential cherry-picking)", "{n} quantified claims report only a narrow geography/scope rather than group-wide figures."),
}
INCONSISTENT, NO_SCOPE3, ASPIRING = "Internally inconsistent figures", "No Scope 3 emissions disclosure", "Aspiration outweighs delivered performance"
NO_SCOPE3_REASON = "Emissions are disclosed but there is no Scope 3 (value-chain) figure."
#: Letters of a sentence that are shown, pieces of evidence of a flag, and the subject of a report's own flags.
SHOWN, EVIDENCE, REPORT = 240, 5, "__report__"


def _of(texts: dict[str, tuple[str, str]], which: int) -> Column:
    return F.create_map(*(F.lit(x) for k, v in texts.items() for x in (k, v[which])))[F.col("flag")]


def conflict_subject() -> Column:
    """The name of a conflict for review: of its pair and kind, so it stays while the claims do."""
    return F.expr("left(sha1(concat_ws('|', claim_a, claim_b, conflict)), 12)")


def review_items(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row an item that can be reviewed: report_id, subject_id, flag, kind (claim, contradiction or report), title, reason,
    source_sentence (its beginning) and page_number. Claims' flags and those of reports fire as in ``report_flags``."""
    page = F.col("page_number") if "page_number" in claims.columns else F.lit(None).cast("int")
    told = claims.select("claim_id", F.left(F.coalesce("source_sentence", F.lit("")), F.lit(SHOWN)).alias("source_sentence"), page.cast("int").alias("page_number"))
    flagged = A.claim_flags(claims).join(told, "claim_id")
    of_claims = flagged.select("report_id", F.col("claim_id").cast("string").alias("subject_id"), "flag", F.lit("claim").alias("kind"), _of(CLAIM_FLAGS, 0).alias("title"), _of(CLAIM_FLAGS, 1).alias("reason"), "source_sentence", "page_number")
    reason = F.format_string("%s conflict of claims %d and %d", "conflict", "claim_a", "claim_b")
    none = F.lit(None).cast("int").alias("page_number")
    of_pairs = conflicts.select("report_id", conflict_subject().alias("subject_id"), F.lit("CONTRADICTION").alias("flag"), F.lit("contradiction").alias("kind"), F.lit(INCONSISTENT).alias("title"), reason.alias("reason"), F.left(reason, F.lit(SHOWN)).alias("source_sentence"), none)
    whole = A.report_flags(claims).where("flag IN ('DISCLOSURE_GAP', 'ASPIRATIONAL_HEAVY')")
    done = claims.groupBy("report_id").agg(F.count_if(F.col("claim_type") == "performance").alias("done"))
    heavy = F.format_string("%d%% of claims are targets/narrative vs. %d performance claims.", F.floor(F.col("n") * 100 / F.col("total") + 0.5), "done")
    gap = F.col("flag") == "DISCLOSURE_GAP"
    of_reports = whole.join(done, "report_id").select(
        "report_id", F.lit(REPORT).alias("subject_id"), "flag", F.lit("report").alias("kind"), F.when(gap, NO_SCOPE3).otherwise(ASPIRING).alias("title"),
        F.when(gap, NO_SCOPE3_REASON).otherwise(heavy).alias("reason"), F.lit(None).cast("string").alias("source_sentence"), none,
    )
    return of_claims.unionByName(of_pairs).unionByName(of_reports)


def dismissed(reviews: DataFrame, at: str = "at") -> DataFrame:
    """(report_id, subject_id, flag) of the items whose last review (report_id, subject_id, flag, verdict, ``at``) dismisses them."""
    last = reviews.groupBy("report_id", "subject_id", "flag").agg(F.max_by("verdict", at).alias("verdict"))
    return last.where("verdict = 'dismissed'").select("report_id", "subject_id", "flag")


def reviewed_flags(claims: DataFrame, conflicts: DataFrame, gone: DataFrame) -> DataFrame:
    """``report_flags`` without the items in ``gone``: a claim's flag and a conflict count no more, and a report's own flag goes."""
    of_claims = gone.where(f"flag <> 'CONTRADICTION' AND subject_id <> '{REPORT}'").select(F.expr("try_cast(subject_id AS BIGINT)").alias("claim_id"), "flag")
    left = conflicts.withColumn("subject_id", conflict_subject()).join(gone.where("flag = 'CONTRADICTION'").select("report_id", "subject_id"), ["report_id", "subject_id"], "left_anti")
    flags = A.report_flags(claims, of_claims, left.drop("subject_id"))
    own = gone.where(f"subject_id = '{REPORT}' AND flag IN ('DISCLOSURE_GAP', 'ASPIRATIONAL_HEAVY')").select("report_id", "flag")
    return flags.join(own, ["report_id", "flag"], "left_anti")


def reviewed_scores(claims: DataFrame, conflicts: DataFrame, gone: DataFrame) -> DataFrame:
    """(report_id, claims, score_raw, score, grade, risk, reviews_applied): scores as the rules have them, and after review.
    Only dismissals of items that are there count as applied; confirmations change nothing."""
    raw = A.integrity_score(claims, A.report_flags(claims, None, conflicts)).select("report_id", F.col("score").alias("score_raw"))
    score = A.integrity_score(claims, reviewed_flags(claims, conflicts, gone))
    items = review_items(claims, conflicts).select("report_id", "subject_id", "flag").distinct()
    applied = items.join(gone, ["report_id", "subject_id", "flag"], "left_semi").groupBy("report_id").agg(F.count("*").alias("reviews_applied"))
    met = score.join(raw, "report_id").join(applied, "report_id", "left")
    return met.select("report_id", "claims", "score_raw", "score", "grade", "risk", F.coalesce("reviews_applied", F.lit(0).cast("long")).alias("reviews_applied"))


def flag_details(claims: DataFrame) -> DataFrame:
    """Each claim flag of a report: severity, n, pct (of its claims), title, description, and ``evidence``: its first five claims by id."""
    flagged = A.claim_flags(claims)
    first = Window.partitionBy("report_id", "flag").orderBy("claim_id")
    some = flagged.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= EVIDENCE).join(claims.select("claim_id", "source_sentence"), "claim_id")
    shown = F.struct("claim_id", F.left(F.coalesce("source_sentence", F.lit("")), F.lit(SHOWN)).alias("source_sentence"))
    evidence = some.groupBy("report_id", "flag").agg(F.array_sort(F.collect_list(shown)).alias("evidence"))
    flags = A.report_flags(claims).where(F.col("flag").isin(*SUMMED)).withColumn("pct", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("long"))
    text = F.replace(F.replace(_of(SUMMED, 1), F.lit("{n}"), F.col("n").cast("string")), F.lit("{pct}"), F.col("pct").cast("string"))
    return flags.join(evidence, ["report_id", "flag"]).select("report_id", "flag", "severity", "n", "pct", _of(SUMMED, 0).alias("title"), text.alias("description"), "evidence")
