"""Bootstrap intervals of rates and of their differences, from sums over resamples; rows are not multiplied."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Claims whose weights in all resamples are made at a time, few enough for the caches of a core, and profiles (what
#: the rows of a claim say) whose sums a task holds at a time.
CLAIMS, PROFILES = 16, 256


def _steps() -> np.ndarray:
    """The least 53-bit draws at which a Poisson variable of mean one is above 0, above 1 and so on."""
    out, term, cumulative = [], math.exp(-1.0), 0.0
    for n in range(18):
        cumulative += term
        out.append(math.ceil(cumulative * (1 << 53)))
        term /= n + 1
    return np.array(out, np.uint64)


_STEPS = _steps()
#: The Poisson variable by the leading 16 bits of a draw; 255 for the few in which a step lies.
_LEADING = np.searchsorted(_STEPS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), side="right").astype(np.uint8)
_LEADING[(_STEPS >> np.uint64(37)).astype(np.int64)] = 255


def weights(claim_ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each claim is in each resample: a Poisson draw of mean one from a hash of claim, resample and seed.

    A claim has the same weights wherever it is met, in every group and task; that is what pairs the resamples.
    """
    with np.errstate(over="ignore"):
        z = claim_ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        z = z ^ (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed) * np.uint64(0x8CB92BA72F3D8DD7))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
    out = _LEADING[z >> np.uint64(48)]
    open_ = np.nonzero(out == 255)
    out[open_] = np.searchsorted(_STEPS, z[open_] >> np.uint64(11), side="right")
    return out


def profiles(rows: DataFrame, rates: list[str], by: str) -> DataFrame:
    """(claim_id, profile): what all rows of a claim say, as JSON of its groups and marks; one row a claim."""
    marks = F.concat(*(F.expr(f"CASE WHEN {r} THEN '1' WHEN NOT {r} THEN '0' ELSE '-' END") for r in rates))
    known = rows.where(f"claim_id IS NOT NULL AND {by} IS NOT NULL").select("claim_id", F.struct(F.col(by).cast("string").alias("g"), marks.alias("marks")).alias("row"))
    return known.groupBy("claim_id").agg(F.to_json(F.array_sort(F.collect_list("row"))).alias("profile"))


def resampled(rows: DataFrame, rates: list[str], by: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(by, draw, a column a rate): every rate in every resample of ``rows`` (claim_id, ``by``, rates that are true,
    false or null where they do not apply).

    The rows of a claim are its profile, so its weights are made once for all groups. A task adds up the weights of
    claims of one profile, then weighted numerators and denominators of each group; the arrays of tasks are added.
    So what is held and sent depends on groups, rates and resamples, not on rows.
    """
    columns = [f"{kind}_{r}" for r in rates for kind in ("num", "den")]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, np.ndarray] = {}

        def settle() -> None:
            for profile, total in held.items():
                for row in json.loads(profile):
                    marks = np.array([x for m in row["marks"] for x in (m == "1", m != "-")], np.int64)
                    mine = sums.setdefault(row["g"], np.zeros((len(columns), draws), np.int64))
                    mine[marks > 0] += total
            held.clear()

        for batch in batches:
            for profile, ids in batch.groupby("profile", sort=False)["claim_id"]:
                if profile not in held and len(held) >= PROFILES:
                    settle()
                total = held.setdefault(profile, np.zeros(draws, np.int64))
                found = ids.to_numpy()
                for at in range(0, len(found), CLAIMS):
                    total += weights(found[at : at + CLAIMS], draws, seed).sum(axis=0, dtype=np.int64)
        settle()
        for g, total in sums.items():
            yield pd.DataFrame(total.T, columns=columns).assign(**{by: g, "draw": np.arange(1, draws + 1)})[[by, "draw", *columns]]

    schema = f"{by} string, draw int, " + ", ".join(f"{c} long" for c in columns)
    parts = profiles(rows, rates, by).mapInPandas(add, schema)
    total = parts.groupBy(by, "draw").agg(*(F.sum(c).alias(c) for c in columns))
    return total.select(by, "draw", *(F.expr(f"num_{r} / nullif(den_{r}, 0)").alias(r) for r in rates))


def composite(rates: list[str]) -> Column:
    """The mean of the rates that exist, in percent, one digit."""
    parts = F.array_compact(F.array(*rates))
    return F.when(F.size(parts) > 0, F.floor(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts) * 1000 + 0.5) / 10)


def _interval(value: str) -> list[Column]:
    """Ends of the middle 95 % of the values of a group, at the nearest rank (halves to even)."""
    ordered = F.array_sort(F.collect_list(value))
    rank = lambda p: F.get(ordered, F.rint(p / 100 * (F.size(ordered) - 1)).cast("int"))
    return [rank(2.5).alias("low"), rank(97.5).alias("high")]


def intervals(rows: DataFrame, rates: list[str], by: str, draws: int = 2000, extra: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """(by, rate, low, high, mean) of each rate, of those in ``extra`` too, and of the composite of ``rates``."""
    found = resampled(rows, [*rates, *extra], by, draws, seed).withColumn("composite", composite(rates))
    names = [*rates, *extra, "composite"]
    long = found.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), F.col(n).cast("double").alias("value")) for n in names))).alias("r")).select(by, "r.*")
    return long.where("value IS NOT NULL").groupBy(by, "rate").agg(*_interval("value"), F.avg("value").alias("mean"))


def stage_pairs(stages: list[str]) -> list[tuple[str, str]]:
    """Each stage with the next, the second with the last, and the first with the last."""
    return list(dict.fromkeys([*zip(stages, stages[1:]), (stages[1], stages[-1]), (stages[0], stages[-1])]))


def paired_deltas(rows: DataFrame, rates: list[str], by: str, pairs: list[tuple[str, str]], draws: int = 2000, seed: int = 42) -> DataFrame:
    """(before, after, low, high, excludes_zero): the interval of what the composite gains from one group to another,
    in resamples that have the same claims in both."""
    spark = rows.sparkSession
    found = resampled(rows, rates, by, draws, seed).select(by, "draw", composite(rates).alias("c")).where("c IS NOT NULL")
    names = F.broadcast(spark.createDataFrame(pairs, "before string, after string"))
    a = found.select(F.col(by).alias("before"), "draw", F.col("c").alias("a")).join(names, "before")
    gains = a.join(found.select(F.col(by).alias("after"), "draw", F.col("c").alias("b")), ["after", "draw"]).select("before", "after", F.round(F.col("b") - F.col("a"), 1).alias("gain"))
    return gains.groupBy("before", "after").agg(*_interval("gain")).withColumn("excludes_zero", F.expr("low > 0 OR high < 0"))
