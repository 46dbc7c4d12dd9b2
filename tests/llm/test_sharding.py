from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import sharding as S


def test_matrix_has_exact_margins_and_the_right_law():
    rows, out = [5, 0, 9, 2], S.shard_sizes(16, 3)
    assert out == [6, 5, 5]
    first = []
    for seed in range(3000):
        m = S.communication_matrix(rows, out, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == out and (m >= 0).all()
        first.append(m[2, 0])
    rng = np.random.default_rng(0)
    assert abs(np.mean(first) - 9 * 6 / 16) < 0.08
    assert abs(np.var(first) - np.var(rng.hypergeometric(6, 10, 9, 100000))) < 0.1


def test_wide_draws_have_the_exact_law():
    """Counts of many draws against binomial coefficients, and moments of a population beyond numpy's bound."""
    from math import comb

    rng = np.random.default_rng(3)
    good, bad, n = 9, 14, 11
    seen = Counter(S._wide_draw(rng, good, bad, n) for _ in range(40000))
    law = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)}
    assert set(seen) <= set(law) and sum((seen[k] - 40000 * p) ** 2 / (40000 * p) for k, p in law.items()) < 30
    good, bad, n = 3 * 10**11, 7 * 10**11, 10**10
    draws = np.array([S._wide_draw(rng, good, bad, n) for _ in range(100)], float)
    spread = (n * 0.3 * 0.7 * (1 - n / (good + bad))) ** 0.5
    assert abs(draws.mean() - 0.3 * n) < 4 * spread / 100**0.5 and abs(draws.std() / spread - 1) < 0.3


def test_large_populations():
    m = S.communication_matrix([4 * 10**9, 6 * 10**9], S.shard_sizes(10**10, 7), 1)
    assert m.sum(axis=1).tolist() == [4 * 10**9, 6 * 10**9] and m.sum(axis=0).tolist() == S.shard_sizes(10**10, 7)


def test_shards_and_slots_are_exact_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(S, "BIN_ROWS", 7)
    for n in (0, 1, 15, 100, 333):
        got = S.shuffle_to_shards(spark.range(0, n, 1, 5), 16).collect()
        assert sorted(r.id for r in got) == list(range(n))
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(16)), default=0) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)


def test_places_are_uniform(spark):
    df = spark.range(0, 40, 1, 3)
    at = np.zeros((4, 40))
    for seed in range(60):
        for r in S.shuffle_to_shards(df, 4, seed).collect():
            at[r.shard, r.id] += 1
    assert (at.sum(axis=1) == 600).all() and ((at - 15) ** 2 / 15).sum() < 220


def test_same_seed_same_result_and_odd_columns(spark):
    df = spark.createDataFrame([(None, None, 1)] * 3 + [(1, "x" * 200000, 2)], "doc_id long, text string, shard int").withColumn("slot", F.lit("z"))
    got = S.shuffle_to_shards(df, 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert S.shuffle_to_shards(df, 2).collect() == got
