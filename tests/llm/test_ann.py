from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import ann as A


def slow(ids, v, k, queries):
    out = {}
    for q in queries:
        scores = v @ v[list(ids).index(q)]
        out[q] = [(i, s) for s, i in sorted((-float(s), i) for i, s in zip(ids, scores, strict=True) if i != q)[:k]]
    return out


def run(spark, rows, k, n):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    out = {}
    for r in sorted(A.nearest(df, F.col("id") % n == 0, k).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["clustered", "lengths"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 32))[rng.integers(0, 20, 4000)] + 0.5 * rng.normal(size=(4000, 32))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if kind == "clustered" else v * rng.uniform(0.2, 3, (4000, 1))
    v = v.astype(np.float32).astype(np.float64)
    got = run(spark, [(i, [float(x) for x in v[i]]) for i in range(4000)], 20, 20)
    want = slow(range(4000), v, 20, range(0, 4000, 20))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert all(math.isclose(s, float(v[q] @ v[i]), rel_tol=1e-12, abs_tol=1e-14) for q in got for i, s in got[q])
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_a_large_group_of_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).astype(np.float32).astype(np.float64)
    v[100:400] = v[100]
    got = run(spark, [(i, [float(x) for x in v[i]]) for i in range(600)], 20, 50)
    want = slow(range(600), v, 20, range(0, 600, 50))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_real_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    v = np.array([r.embedding for r in rows], np.float64)
    want = slow([r.vec_id for r in rows], v, 20, [r.vec_id for r in rows if r.vec_id % 20 == 0])
    found = {}
    for r in A.nearest(df, F.col("id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    got = run(spark, rows, 3, 1)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [6], 6: [0]}
    assert run(spark, [(1, None)], 3, 1) == {}
