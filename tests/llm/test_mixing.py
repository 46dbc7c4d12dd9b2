from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import mixing as M

DATA = "/root/testdata/sf0.01"
DOMAINS = ["high", "low", "toxic"]


def model_and_docs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", M.label_domain().alias("domain"))
    return M.train(docs, labels, DOMAINS), docs, labels


def test_expected_tokens_meet_the_targets(spark):
    model, docs, labels = model_and_docs(spark)
    weights = {"high": 0.6, "low": 0.3, "toxic": 0.1}
    rows = M.mix(docs, model, weights).select("__n_tokens", "__p_high", "__p_low", "__p_toxic", "__rate", "__copies").collect()
    total = sum(r[0] for r in rows)
    for i, d in enumerate(DOMAINS, 1):
        assert math.isclose(sum(r[0] * r[i] * r[4] for r in rows), weights[d] * total, rel_tol=1e-4)
    assert all(abs(r[1] + r[2] + r[3] - 1) < 1e-9 and r[4] >= 0 and abs(r[5] - r[4]) < 1 for r in rows)


def test_rates_equal_a_plain_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 100, 200)
    members = spark.createDataFrame([(1, int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "rows long, n_tokens long, p0 double, p1 double, p2 double")
    goal = n.sum() * np.array([0.9, 0.08, 0.02])
    r = np.array([x[0] for x in members.select(M.fit_rates(members, goal.tolist())).collect()])
    assert (r >= 0).all() and (r == 0).any() and np.allclose((n * r) @ p, goal, rtol=1e-4)
    slow = np.ones(200)
    gram = (p * n[:, None]).T @ p
    for _ in range(20000):
        slow = np.maximum(0, slow - p @ ((n * slow) @ p - goal) / np.linalg.eigvalsh(gram)[-1])
    assert np.allclose((n * slow) @ p, goal, rtol=1e-3)


def test_domains_are_told_apart_on_unseen_documents(spark):
    _, docs, labels = model_and_docs(spark)
    seen = labels.where(F.pmod("doc_id", F.lit(3)) != 0)
    model = M.train(docs, seen, DOMAINS)
    keyed = docs.select("doc_id", M.text_key().alias("text_key"))
    p = M.posteriors(docs, model).join(keyed, "text_key").join(labels.where(F.pmod("doc_id", F.lit(3)) == 0), "doc_id")
    got = p.select("domain", F.expr("CASE greatest(p0, p1, p2) WHEN p0 THEN 'high' WHEN p1 THEN 'low' ELSE 'toxic' END")).collect()
    assert sum(a == b for a, b in got) >= 0.85 * len(got) > 50


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "good fine text"), (3, "bad bad bad"), (4, "word " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"feature": F.lit(1), "rows": F.lit("x")})
    labels = spark.createDataFrame([(3, "b"), (4, "a"), (None, "a"), (9, "z")], "doc_id long, domain string")
    model = M.train(docs, labels, ["a", "b"])
    got = M.mix(docs, model, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == 6 and all(r["__rate"] >= 0 and r["__copies"] >= 0 for r in got)
    assert sorted(r["__n_tokens"] for r in got) == [0, 0, 0, 3, 3, 60000]
    assert M.mix(docs.where("doc_id > 9"), M.train(docs, labels.where("false"), ["a", "b"]), {"a": 1, "b": 1}).count() == 0


def test_a_target_out_of_reach_is_met_as_far_as_it_goes(spark, monkeypatch):
    """All texts lean to one domain, so the other's target cannot be met: the fit ends at the least gap, which a
    plain projected gradient finds too; with too few steps a warning says so."""
    p = np.array([[0.9, 0.1], [0.8, 0.2], [0.7, 0.3]])
    n = np.array([10, 20, 30])
    members = spark.createDataFrame([(1, int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "rows long, n_tokens long, p0 double, p1 double")
    goal = np.array([5.0, 60.0])
    r = np.array([x[0] for x in members.select(M.fit_rates(members, goal.tolist())).collect()])
    slow = np.ones(3)
    gram = (p * n[:, None]).T @ p
    for _ in range(50000):
        slow = np.maximum(0, slow - p @ ((n * slow) @ p - goal) / np.linalg.eigvalsh(gram)[-1])
    gap = lambda x: np.linalg.norm((n * x) @ p - goal)
    assert gap(r) <= gap(slow) * 1.01 + 1e-9
    monkeypatch.setattr(M, "STEPS", 1)
    with pytest.warns(UserWarning, match="misses its target"):
        M.fit_rates(members, goal.tolist())
