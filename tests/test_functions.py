from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators.knn import nearest_of_all
from claimweave.sources.functions import register


@pytest.fixture
def claims(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), f"d{i % 3}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)]
    rows += [(100, "a", "d0", None), (101, "a", "d0", [0.0] * 5), (102, "a", "d1", [1.0] * 3), (103, "a", None, [float("nan")] * 5), (104, "b", "d1", rows[1][3])]
    register(spark)
    spark.createDataFrame(rows, "claim_id long, metric_family string, doc_id string, embedding array<double>").repartition(4).createOrReplaceTempView("held_claims")
    return rows


def array(v):
    return f"array({', '.join(f'{x!r}D' for x in v)})"


def test_match_claims_equals_the_join(spark, claims):
    joined = nearest_of_all(spark.table("held_claims").select(F.col("claim_id").alias("id"), F.col("embedding").alias("vector"), "metric_family"), 6, 0.1, "metric_family")
    want = {}
    for r in joined.collect():
        want.setdefault(r.query_id, []).append((r.place, r.id, round(r.similarity, 6)))
    for claim, family, _, vector in claims[:6]:
        found = spark.sql(f"SELECT * FROM match_claims(TABLE(SELECT * FROM held_claims WHERE metric_family = '{family}') PARTITION BY (metric_family) ORDER BY (claim_id), {array(vector)}, 0.1D, 6, {claim}L)")
        assert found.columns == ["claim_id", "metric_family", "doc_id", "similarity"]
        got = sorted(((-r.similarity, r.claim_id) for r in found.collect()))
        assert [(i + 1, c, round(-s, 6)) for i, (s, c) in enumerate(got)] == sorted(want.get(claim, []))


def test_search_claims_by_document(spark, claims):
    query = claims[3][3]
    every = spark.sql(f"SELECT doc_id, count(*) AS n FROM search_claims(TABLE(SELECT * FROM held_claims WHERE doc_id IS NOT NULL) PARTITION BY (doc_id), {array(query)}, 4) GROUP BY doc_id")
    assert {(r.doc_id, r.n) for r in every.collect()} == {("d0", 4), ("d1", 4), ("d2", 4)}
    best = spark.sql(f"SELECT claim_id FROM search_claims(TABLE(held_claims) WITH SINGLE PARTITION, {array(query)}, 1)").first()
    assert best.claim_id == 3
    none = spark.sql(f"SELECT * FROM match_claims(TABLE(SELECT * FROM held_claims WHERE false) PARTITION BY (doc_id), {array(query)}, 0.0D, 5, NULL)")
    assert none.count() == 0
    assert spark.sql(f"SELECT * FROM search_claims(TABLE(held_claims) PARTITION BY (doc_id), {array(query)}, 0)").count() == 0


def test_arguments_are_checked(spark, claims):
    with pytest.raises(Exception, match="no column embedding"):
        spark.sql("SELECT * FROM search_claims(TABLE(SELECT 1 AS claim_id), array(1D), 3)").collect()
