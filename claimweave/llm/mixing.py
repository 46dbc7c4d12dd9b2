"""Mixing by soft membership: nonnegative document rates that meet domain token targets."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small, text_key

#: Bounds of the classifier: labelled rows it is fitted on, and features it keeps.
TRAIN_ROWS, FEATURES = 20_000, 4096
#: A feature needs this many labelled documents.
LEAST_ROWS = 8
#: A domain's share of documents with a feature is drawn to the overall share, as by so many documents.
SHRINK = 10.0
#: Steps of the fit at most, the gap that counts as none, and the least share that a step must take off the gap.
STEPS, TOLERANCE, PROGRESS = 30, 1e-7, 1e-4
_SPAN = 1 << 20


def label_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a labelled document: toxic, low or high; null where the labels decide nothing."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "high")


def _words(text: str) -> str:
    return f"filter(split(`{text}`, '\\\\s+'), w -> w <> '')"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, n_tokens, feature): the distinct words of each row's text, how repetitive it is, and
    the empty feature once a row."""
    rows = docs.select(text_key(text).alias("text_key"), F.expr(f"coalesce({_words(text)}, array())").alias("words"))
    rows = rows.select("text_key", F.size("words").cast("long").alias("n_tokens"), F.array_distinct("words").alias("words"))
    repeats = "concat('\n', CAST(floor(log2(n_tokens + 1)) AS STRING), '/', CAST(floor(10D * size(words) / greatest(n_tokens, 1)) AS STRING))"
    return rows.select("text_key", "n_tokens", F.explode(F.expr(f"concat(words, array({repeats}, ''))")).alias("feature"))


@dataclass
class Classifier:
    """Naive Bayes over the presence of features: ``weights`` has (feature, w0, w1, ...), by domain."""

    domains: list[str]
    weights: DataFrame


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text: str = "text") -> Classifier:
    """Fit on up to about TRAIN_ROWS labelled documents, the same ones however rows are partitioned.

    ``labels`` has (id_col, domain); rows of other domains or null ids are passed over. The FEATURES
    features whose counts differ most between domains (chi-square) are kept.
    """
    known = labels.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "domain").distinct()
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("id"), F.lit(_SPAN)) < int(_SPAN * min(1.0, TRAIN_ROWS / max(n, 1))) + 1)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = texts.join(small(part), "id")
    of_key = rows.select(text_key("text").alias("text_key"), "domain")
    counts = [F.count(F.when(F.col("domain") == d, 1)) for d in domains]
    by_text = of_key.groupBy("text_key").agg(*(c.alias(f"c{k}") for k, c in enumerate(counts)))
    seen = features(rows).select("text_key", "feature").distinct().join(by_text, "text_key")
    tally = cut(seen.groupBy("feature").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(len(domains)))))
    total = tally.where("feature = ''").first()
    sizes = [int(total[f"c{k}"]) if total else 0 for k in range(len(domains))]
    everything = max(sum(sizes), 1)
    df = " + ".join(f"c{k}" for k in range(len(domains)))
    odd = " + ".join(f"pow(c{k} - ({df}) * {s / everything!r}D, 2) / (({df}) * {max(s / everything, 1e-9)!r}D)" for k, s in enumerate(sizes))
    chosen = tally.where(f"feature <> '' AND {df} >= {LEAST_ROWS}").orderBy(F.expr(odd).desc(), "feature").limit(FEATURES)
    share = F.expr(f"{SHRINK}D * ({df}) / {everything}D")
    weigh = [F.log((F.col(f"c{k}") + share) / F.lit(s + SHRINK)).alias(f"w{k}") for k, s in enumerate(sizes)]
    prior = [F.lit(float(np.log((s + 1) / (everything + len(domains))))).alias(f"w{k}") for k, s in enumerate(sizes)]
    base = docs.sparkSession.range(1).select(F.lit("").alias("feature"), *prior)
    return Classifier(domains, cut(chosen.select("feature", *weigh).unionByName(base)))


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """(text_key, rows, n_tokens, p0, p1, ...) of each distinct text: how many rows have it, its words
    (runs of anything but white space) and its domain probabilities, which add up to 1."""
    k = range(len(model.domains))
    joined = features(docs, text).join(F.broadcast(model.weights), "feature")  # FEATURES + 1 rows at most
    sums = joined.groupBy("text_key").agg(
        F.sum(F.when(F.col("feature") == "", 1).otherwise(0)).alias("rows"), F.max("n_tokens").alias("n_tokens"), *(F.sum(f"w{i}").alias(f"s{i}") for i in k)
    )
    logits = sums.select("text_key", "rows", "n_tokens", *((F.col(f"s{i}") / F.col("rows")).alias(f"l{i}") for i in k))
    most = F.greatest(*(F.col(f"l{i}") for i in k)) if len(model.domains) > 1 else F.col("l0")
    grown = logits.select("text_key", "rows", "n_tokens", *(F.exp(F.col(f"l{i}") - most).alias(f"e{i}") for i in k))
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return grown.select("text_key", "rows", "n_tokens", *((F.col(f"e{i}") / total).alias(f"p{i}") for i in k))


def fit_rates(members: DataFrame, targets: list[float], least: Column | None = None) -> Column:
    """The rate column for ``members`` (rows, n_tokens, p0, ...): projected gradient steps from 1.

    The least-squares gap between expected domain tokens (rows x tokens x probability x rate, summed)
    and ``targets`` is reduced; each step moves a rate along its probabilities and is cut off at zero (or at
    ``least``, the rate that a text may not fall below). A step is first scaled by the Gram matrix of the
    texts that can still move, as Newton's method would (with floors, of all texts); where that did not lower the gap, the plain gradient step
    from the same place follows, short enough (the Gram matrix's largest eigenvalue) to be sure to.
    The fit ends where nothing is left of the gap or no sure step lowers it, which then is the least
    possible. A step is one aggregation over the data; the driver sees the few sums only. Where a fit does
    not end within STEPS, the best rates so far are returned and a warning says how far off they are.
    """
    k = range(len(targets))
    goal = np.array(targets)
    floor = F.lit(0.0) if least is None else least
    rate, best, sure = F.lit(1.0), None, False
    for _ in range(STEPS):
        at = members.withColumn("rate", rate).withColumn("floor", floor).withColumn("mass", F.col("rows") * F.col("n_tokens"))
        live = F.when(F.col("rate") > 0, F.col("mass")).otherwise(0.0) if least is None else F.col("mass")
        sums = [F.sum(F.col("mass") * F.col(f"p{i}") * F.col("rate")).alias(f"t{i}") for i in k]
        gram = [F.sum(m * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"{n}{i}_{j}") for n, m in (("g", live), ("h", F.col("mass"))) for i in k for j in k]
        row = at.agg(*sums, *gram).first()
        gap = np.array([row[f"t{i}"] or 0.0 for i in k]) - goal
        if np.abs(gap).max() <= TOLERANCE * max(goal.sum(), 1.0):
            return rate
        free, whole = (np.array([[row[f"{n}{i}_{j}"] or 0.0 for j in k] for i in k]) for n in "gh")
        if best is not None and gap @ gap >= best[1] @ best[1] * (1 - PROGRESS):
            if sure:
                return best[0]
            rate, gap, whole = best
            sure = True
        else:
            best, sure = (rate, gap, whole), False
        if sure:
            step = gap / max(np.linalg.eigvalsh(whole)[-1], 1e-9)
        else:
            step = np.linalg.solve(free + np.eye(len(targets)) * max(1e-9 * np.trace(whole), 1e-9), gap)
        rate = F.greatest(floor, rate - sum((F.col(f"p{i}") * F.lit(float(step[i])) for i in k), F.lit(0.0)))
    left = np.abs(best[1]).max() / max(goal.sum(), 1.0)
    warnings.warn(f"the rates did not settle in {STEPS} steps: a domain misses its target by {left:.2%} of all tokens", stacklevel=2)
    return best[0]


def mix(
    docs: DataFrame, model: Classifier, weights: dict[str, float], total_tokens: float | None = None, id_col: str = "doc_id", text: str = "text", seed: int = 7,
    keep: str | None = None,
) -> DataFrame:
    """``docs`` with ``__n_tokens``, ``__p_<domain>``, ``__rate`` (expected copies) and ``__copies``.

    ``weights`` are each domain's share of the tokens, ``total_tokens`` their sum (as many as there are
    if none is given). Copies are the rate rounded down, plus one with the probability of what is left,
    decided by a hash of the id and ``seed``. Equal texts have equal probabilities and rates. A null or
    empty text has no tokens and the domain of the prior; repeated rows are copied alike; null ids take
    part. Rows are not dropped here and an empty table stays empty. A domain that no text belongs to
    misses its target.

    With ``keep``, that domain's target is what it has, each other one's its share against it but no more
    than it has, and no text that is likeliest of that domain gets a rate under one.
    """
    if set(weights) != set(model.domains):
        raise ValueError("weights must name the domains of the classifier")
    members = cut(posteriors(docs, model, text))
    k = range(len(model.domains))
    if keep is not None and total_tokens is not None:
        raise ValueError("with keep the targets follow from the texts")
    if keep is None and total_tokens is None:
        total_tokens = float(members.agg(F.sum(F.col("rows") * F.col("n_tokens"))).first()[0] or 0)
    if keep is None:
        scale = total_tokens / (sum(weights.values()) or 1.0)
        rate = fit_rates(members, [weights[d] * scale for d in model.domains])
    else:
        row = members.agg(*(F.sum(F.col("rows") * F.col("n_tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in k)).first()
        had = {d: row[f"t{i}"] or 0.0 for i, d in enumerate(model.domains)}
        scale = had[keep] / weights[keep]
        mine = F.col(f"p{model.domains.index(keep)}") >= F.greatest(*(F.col(f"p{i}") for i in k), F.lit(0.0))
        rate = fit_rates(members, [min(had[d], weights[d] * scale) for d in model.domains], F.when(mine, 1.0).otherwise(0.0))
    rated = members.select(
        F.col("text_key").alias("__key"), F.col("n_tokens").alias("__n_tokens"), *(F.col(f"p{i}").alias(f"__p_{d}") for i, d in enumerate(model.domains)), rate.alias("__rate")
    )
    joined = docs.join(rated, text_key(docs[text]) == rated["__key"]).drop("__key")
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_SPAN)) / F.lit(float(_SPAN))
    return joined.withColumn("__copies", (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long"))
