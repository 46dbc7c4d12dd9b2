"""Steps whose rows meet by a key, made in parts one after another."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from claimweave.sources import tables as S

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["score_factcheck", "contradiction_replace", "portfolio"])
def test_queries_in_parts_are_alike(spark, monkeypatch, name):
    want = rows(queries()[name](spark, SMALL))
    monkeypatch.setattr(S, "PART_ROWS", 1000)
    made = []
    before = S.settled
    monkeypatch.setattr(S, "settled", lambda df: made.append(1) or before(df))
    assert rows(queries()[name](spark, SMALL)) == want and want
    assert len(made) >= S.PARTS / 2


def test_a_part_takes_what_it_worked_with_along(spark, monkeypatch):
    """Every row is made once, null keys too; of the tables only the results stay; keys of unlike types are not dealt."""
    monkeypatch.setattr(S, "PART_ROWS", 10)
    df = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("k"), "id")
    seen = []

    def make(x):
        y = S.settled(x)
        seen.append((y.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").removeprefix("//"), y.select("k").distinct().count()))
        return y.join(y.groupBy("k").agg(F.count("*").alias("n")), "k", "left")

    got = S.in_parts(make, "k", df)
    assert len(seen) == S.PARTS and sum(n for _, n in seen) == 8
    assert not any(os.path.exists(path) for path, _ in seen)
    assert sorted(r.id for r in got.collect()) == list(range(100))
    seen.clear()
    S.in_parts(lambda x, y: make(x), "k", df, df.select(F.col("k").cast("string").alias("k")))
    assert len(seen) == 1
