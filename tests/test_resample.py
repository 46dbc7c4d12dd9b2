from __future__ import annotations

import random

import numpy as np

from claimweave.operators import resample as R

RATES = ["prec", "node", "value"]
SCHEMA = "claim_id long, stage string, prec boolean, node boolean, value boolean"


def rows(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        for stage, good in (("a", 0.6), ("b", 0.6), ("c", 0.9)):
            if stage == "c" and i % 10 == 0:
                continue
            out.append((i - 5, stage, *(None if rng.random() < 0.2 else rng.random() < good for _ in RATES)))
    return out


def plain(data, draws, seed):
    """Composites of every stage and resample by loops over the same weights."""
    ids = sorted({r[0] for r in data})
    w = dict(zip(ids, R.weights(np.array(ids), draws, seed).tolist()))
    out = {}
    for stage in {r[1] for r in data}:
        for d in range(draws):
            parts = []
            for k in range(len(RATES)):
                den = sum(w[r[0]][d] for r in data if r[1] == stage and r[2 + k] is not None)
                num = sum(w[r[0]][d] for r in data if r[1] == stage and r[2 + k])
                if den:
                    parts.append(num / den)
            out[stage, d + 1] = int(sum(parts) / len(parts) * 1000 + 0.5) / 10 if parts else None
    return out


def nearest(values):
    values = sorted(values)
    return [values[round(p / 100 * (len(values) - 1))] for p in (2.5, 97.5)]


def test_equals_a_plain_loop(spark):
    data, draws = rows(1), 120
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = plain(data, draws, 42)
    found = R.resampled(df, RATES, "stage", draws).withColumn("c", R.composite(RATES)).collect()
    assert {(r.stage, r.draw): r.c for r in found} == want
    got = {r.stage: r for r in R.intervals(df, RATES, "stage", draws).where("rate = 'composite'").collect()}
    assert all([got[s].low, got[s].high] == nearest([want[s, d] for d in range(1, draws + 1)]) for s in "abc")
    pairs = R.stage_pairs(["a", "b", "c"])
    assert pairs == [("a", "b"), ("b", "c"), ("a", "c")] and len(R.stage_pairs([f"S{i}" for i in range(6)])) == 7
    for r in R.paired_deltas(df, RATES, "stage", pairs, draws).collect():
        low, high = nearest([round(want[r.after, d] - want[r.before, d], 1) for d in range(1, draws + 1)])
        assert (r.low, r.high, r.excludes_zero) == (low, high, low > 0 or high < 0)


def test_weights_have_the_law_and_equal_stages_differ_by_nothing(spark):
    w = R.weights(np.arange(-50, 50), 2000, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[3], w[4])[0, 1]) < 0.08 and (R.weights(np.array([7]), 5, 1) != R.weights(np.array([7]), 5, 2)).any()
    data = rows(2, 40)
    twin = [(i, s, *rest) for i, _, *rest in [r for r in data if r[1] == "a"] for s in "xy"]
    got = R.paired_deltas(spark.createDataFrame(twin, SCHEMA), RATES, "stage", [("x", "y")], 200).first()
    assert (got.low, got.high, got.excludes_zero) == (0.0, 0.0, False)
    assert R.intervals(spark.createDataFrame([], SCHEMA), RATES, "stage").count() == 0
    assert R.resampled(spark.createDataFrame([(1, "a", None, None, None), (None, "a", True, True, True)], SCHEMA), RATES, "stage", 3).where("prec IS NOT NULL").count() == 0
