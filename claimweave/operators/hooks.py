"""Models at the places where rules do not decide: asked in batches, only there, and only believed within bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

VERDICT = StructType([StructField("label", StringType()), StructField("score", DoubleType())])
#: A function that makes a model is called once in a worker; the model maps arrays of texts to what is described at each hook.
MakeModel = Callable[[], Callable]


def _label(label: str) -> Column:
    """One of three verdicts from a model's label, whatever its case and prefix."""
    low = F.lower(label)
    found = F.when(low.contains("contradict"), "contradiction").when(low.contains("entail"), "entailment")
    return found.when(low.contains("neutral"), "neutral").otherwise(low)


def textual_verdicts(pairs: DataFrame, make_model: MakeModel, at_least: float = 0.6, batch_size: int = 64) -> DataFrame:
    """``pairs`` (text_a, text_b, conflict: what the rules found, else null) with conflict, severity, label and confidence.

    Only pairs without a conflict by rule, both of whose texts have letters or figures, are put to the model (premises, hypotheses
    -> labels, scores). A contradiction with a score over ``at_least`` becomes the conflict ``Textual`` of severity High; any
    other verdict, a score that is null or not a number, and what is no probability are none. Where the model was not
    asked the label is ``skipped`` (by rule) or ``neutral`` (no text) and the confidence 1 or 0.
    """

    def make() -> Callable:
        model = make_model()

        def predict(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
            labels, scores = model([str(x) for x in a], [str(x) for x in b])
            return {"label": np.array([str(x) for x in labels], dtype=object), "score": np.array([np.nan if s is None else float(s) for s in scores])}

        return predict

    told = predict_batch_udf(make, return_type=VERDICT, batch_size=batch_size)
    ruled, texts = F.col("conflict").isNotNull(), F.coalesce((F.trim("text_a") != "") & (F.trim("text_b") != ""), F.lit(False))
    open_, severity = ~ruled & texts, F.lit(None).cast("string")
    closed = pairs.where(~open_).select(*pairs.columns, severity.alias("severity"), F.when(ruled, "skipped").otherwise("neutral").alias("label"), F.when(ruled, 1.0).otherwise(0.0).alias("confidence"))
    asked = pairs.where(open_).withColumn("__told", told(F.trim("text_a"), F.trim("text_b")))
    label, score = _label("__told.label"), F.col("__told.score")
    sound = score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
    against = sound & (label == "contradiction") & (score > at_least)
    judged = asked.withColumn("conflict", F.when(against, "Textual")).withColumn("severity", F.when(against, "High"))
    judged = judged.withColumn("label", F.when(sound, label).otherwise("neutral")).withColumn("confidence", F.when(sound, score).otherwise(0.0))
    return closed.unionByName(judged.select(closed.columns))


def extracted(units: DataFrame, make_model: MakeModel, signal: Column, batch_size: int = 16) -> DataFrame:
    """``units`` (text and others) with ``reply``: what the model says to the texts that have a ``signal``; null for the others, which it never sees.

    A text that several units share is put to it once. A reply is read by ``extraction.reply_claims``.
    """

    def make() -> Callable:
        model = make_model()
        return lambda texts: np.array([str(r) for r in model([str(t) for t in texts])], dtype=object)

    said = predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)
    open_ = F.coalesce(signal, F.lit(False)) & F.coalesce(F.trim("text") != "", F.lit(False))
    texts = units.where(open_).select("text").distinct()
    replies = texts.withColumn("reply", said("text"))
    asked = units.where(open_).join(replies, "text").select(*units.columns, "reply")
    return asked.unionByName(units.where(~open_).withColumn("reply", F.lit(None).cast("string")))


def explained(verdicts: DataFrame, make_model: MakeModel, allowed: tuple[str, ...] = ("supported", "contradicted", "inconclusive"), batch_size: int = 32) -> DataFrame:
    """``verdicts`` (claim, evidence, verdict by rule) with the model's second opinion where there is evidence and the rule
    is inconclusive. It may say ``allowed`` words only; anything else leaves the rule's. No evidence, no call, no change."""

    def make() -> Callable:
        model = make_model()
        return lambda claims, evidence: np.array([str(r) for r in model([str(c) for c in claims], [str(e) for e in evidence])], dtype=object)

    said = predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)
    open_ = F.coalesce((F.trim("evidence") != "") & (F.trim("claim") != ""), F.lit(False)) & F.coalesce(F.col("verdict") == "inconclusive", F.lit(True))
    asked = verdicts.where(open_).withColumn("__said", F.lower(F.trim(said("claim", "evidence"))))
    judged = asked.withColumn("verdict", F.when(F.col("__said").isin(*allowed), F.col("__said")).otherwise(F.col("verdict")))
    return judged.withColumn("by", F.when(F.col("__said").isin(*allowed), "model").otherwise("rule")).drop("__said").unionByName(verdicts.where(~open_).withColumn("by", F.lit("rule")))
