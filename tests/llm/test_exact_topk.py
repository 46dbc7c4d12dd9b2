from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import exact_topk as E


def slow(rows, k, is_query):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, [math.floor(1024 * x) for x in v]), [math.floor(1024 * x) for x in v])
    out = []
    for q in ok:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k, n):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    return sorted(map(tuple, E.exact_topk(df, F.col("id") % n == 0, k).collect()))


@pytest.mark.parametrize("kind", ["random", "clustered", "tied"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(E, "CANDIDATES", 60)
    monkeypatch.setattr(E, "QUERIES", 7)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 20))
    v = {"random": rng.normal(size=(400, 20)), "clustered": base[rng.integers(0, 5, 400)] + 0.1 * rng.normal(size=(400, 20)), "tied": rng.integers(-1, 2, (400, 20)).astype(float)}[kind]
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(400)]
    assert run(spark, rows, 10, 10) == slow(rows, 10, lambda q: q % 10 == 0)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(6)] + [(6, None), (7, [1.0, None, 2.0]), (8, [float("nan")] * 3), (9, [float("inf")] * 3), (None, [1.0] * 3)]
    rows += [(10, [0.0] * 3), (11, [1.0, 2.0]), (12, [2.0, 2.0]), (13, []), (0, rows[0][1])]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, 4, 1) == slow(rows, 4, lambda q: True)
    assert run(spark, [(1, [1.0])], 4, 1) == [] == run(spark, rows[:0] or [(3, None)], 4, 1)


def test_bounds_never_exclude():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(1, 30)), rng.normal(size=(50, 30))
    last = -1.0
    for (size, qm, qd), (_, xm, xd) in zip(E.summaries(a), E.summaries(b), strict=True):
        low = E.least_distance(size, (qm[0], qd[0]), (xm, xd))
        assert (low <= ((a - b) ** 2).sum(axis=1) + 1e-9).all() and low.mean() > last
        last = low.mean()
