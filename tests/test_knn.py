from __future__ import annotations

import numpy as np
import pytest

from claimweave.operators import knn


def plain(rows, k, at_least):
    """All pairs by loops."""
    held = {}
    for i, family, v in rows:
        if i is None or family is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(np.array(v)):
            continue
        u = np.array(v, float)
        u = u / np.sqrt(sum(x * x for x in u))
        key = (family, len(v), i)
        held[key] = min(held[key], u.tolist()) if key in held else u.tolist()
    out = set()
    for (family, dim, i), u in held.items():
        near = [(-round(float(np.dot(u, w)), 9), j) for (f, n, j), w in held.items() if f == family and n == dim and j != i]
        out |= {(i, j, place) for place, (s, j) in enumerate(sorted(x for x in near if -x[0] > at_least)[:k], 1)}
    return out


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, 6))
    rows = [(int(i), ["a", "a", "a", "b"][i % 4], (middles[rng.integers(8)] + 0.15 * rng.normal(size=6)).tolist()) for i in range(n)]
    rows += [(1000 + i, "a", middles[0].tolist()) for i in range(40)]  # one vector many times
    rows += [(2000, None, [1.0] * 6), (2001, "a", None), (2002, "a", [0.0] * 6), (2003, "a", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, "a", [float("nan")] * 6)]
    rows += [(None, "a", [1.0] * 6), (2005, "a", [1.0, 2.0]), (2006, "a", [1.0, 2.1]), (2007, "a", [float("inf")] * 6)]
    return rows + rows[:3]


@pytest.mark.parametrize("at_least, sizes", [(0.85, (8, 16, 50, 2)), (-1.0, (8, 4, 1000, 3)), (0.2, (1024, 256, 20_000, 64))])
def test_equals_all_pairs(spark, monkeypatch, at_least, sizes):
    """Small cells, rings and lanes, and the sizes in use; ties, repeated vectors, rows that take no part."""
    for name, size in zip(("BLOCK_ROWS", "PIVOTS", "LANE_ROWS", "LANE_BLOCKS"), sizes):
        monkeypatch.setattr(knn, name, size)
    rows = corpus(sizes[0])
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, family string, vector array<double>, pivot int").repartition(4)
    got = knn.nearest_of_all(df.withColumnRenamed("family", "label"), 5, at_least, "label")
    assert {(r.query_id, r.id, r.place) for r in got.collect()} == plain(rows, 5, at_least)


def test_rings_far_away_are_not_read(spark, monkeypatch):
    """With tight clusters most pairs of blocks are dropped by their bounds."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    met = []
    meet = knn.settled
    monkeypatch.setattr(knn, "settled", lambda df: met.append(df.count()) or meet(df) if "lane" in df.columns and "asks" in df.columns else meet(df))
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 8))
    rows = [(i, "a", (middles[i % 20] + 0.01 * rng.normal(size=8)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    assert {(r.query_id, r.id, r.place) for r in knn.nearest_of_all(df, 3, 0.85, "label").collect()} == plain(rows, 3, 0.85)
    assert met[0] < 0.5 * 50 * 50


def test_empty(spark):
    assert knn.nearest_of_all(spark.createDataFrame([], "id long, label string, vector array<double>"), 3, 0.85, "label").count() == 0


def test_pairs_of_one_sentence_go(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.9), (4, 3, 0.8)], "query_id long, id long, similarity double")
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, sentence string")
    assert {(r.a, r.b) for r in knn.contrary_pairs(near, texts).collect()} == {(1, 3), (3, 4)}
