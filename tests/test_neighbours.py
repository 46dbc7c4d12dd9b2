from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import vectors as N


def plain(rows, asked, k, at_least):
    """All queries against all vectors, sums in order, one after another."""
    unit = {}
    for i, label, v in rows:
        norm = sum((x * x for x in v), 0.0) ** 0.5 if v else 0
        if norm:
            unit[i] = label, [x / norm for x in v]
    out = []
    for i in asked:
        if i in unit:
            met = []
            for j, (label, v) in unit.items():
                if j != i and label == unit[i][0] and label is not None and len(v) == len(unit[i][1]):
                    s = 0.0
                    for x, y in zip(unit[i][1], v):
                        s += x * y
                    if round(s, 9) > at_least:
                        met.append((-round(s, 9), j))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(met)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2]), [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, 1, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0]) for i in range(400, 1900)]  # more copies than a block holds
    return rows + [(2000, 1, None), (2001, 1, [0.0] * 6), (2002, None, [1.0] * 6), (2003, 2, [1.0] * 3), (2004, 2, [2.0, 2.0, 1.0])]


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_every_query_meets_all_of_its_block(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(N, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(N, "HELD_BLOCKS", 1)
    v = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(3)
    got = N.neighbours(v, v.where("id % 50 IN (0, 3)"), 8, 0.1, "label")
    asked = [r[0] for r in rows if r[0] % 50 in (0, 3)]
    assert sorted((r.query_id, r.place, r.id, r.similarity) for r in got.select("query_id", "place", "id", "similarity").collect()) == plain(rows, asked, 8, 0.1)


def test_pairs_meet_as_blocks(spark, rows):
    """No row a pair of a query and a vector leaves a join: 2,000 vectors are a few blocks."""
    v = spark.createDataFrame(rows, "id long, label int, vector array<double>").coalesce(1)
    found = N.neighbours(v, v, 3, -1.0)
    assert found.select("query_id").distinct().count() == 1903 and "Join" not in found._jdf.queryExecution().toString()


def test_no_number_is_above_all_and_the_null_takes_no_part(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, 1.0]), (4, [1.0, None]), (None, [1.0, 0.0])], "id long, vector array<double>")
    got = N.neighbours(v, v.where("id = 1"), 2, -1.0).orderBy("place").select("id", F.isnan("similarity").alias("odd")).collect()
    assert [tuple(r) for r in got] == [(2, True), (3, False)]
