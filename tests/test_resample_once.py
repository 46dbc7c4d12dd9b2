from __future__ import annotations

import math

import numpy as np

from claimweave.operators import resample as R


def plain_weight(draw):
    """The number of steps of the Poisson law at or below a draw, one by one."""
    u, term, cumulative, out = draw / (1 << 53), math.exp(-1.0), 0.0, 0
    for n in range(18):
        cumulative += term
        out += u >= cumulative
        term /= n + 1
    return out


def test_a_claim_is_weighed_once_for_all_groups(spark):
    rows = [(i, g, i % 2 == 0, None) for i in range(10) for g in "abc"] + [(None, "a", True, True)]
    found = R.profiles(spark.createDataFrame(rows, "claim_id long, g string, x boolean, y boolean"), ["x", "y"], "g").collect()
    assert len(found) == 10 and len({r.profile for r in found}) == 2


def test_the_table_of_starts_equals_the_law():
    edges = [int(s) + d for s in R._STEPS for d in (-1, 0, 1) if int(s) + d < 1 << 53]
    draws = np.array([*edges, *range(0, 1 << 53, (1 << 53) // 997)], np.uint64)
    out = R._LEADING[draws >> np.uint64(37)].astype(int)
    out = np.where(out == 255, np.searchsorted(R._STEPS, draws, side="right"), out)
    assert out.tolist() == [plain_weight(int(d)) for d in draws]


def test_sums_of_one_task_equal_plain_sums(spark):
    rows = [(i, "a", i % 3 == 0, None if i % 5 else True) for i in range(30)]
    df = spark.createDataFrame(rows, "claim_id long, g string, x boolean, y boolean").coalesce(1)
    w = R.weights(np.arange(30), 4, 7)
    for r in R.resampled(df, ["x", "y"], "g", 4, 7).collect():
        assert r.x == sum(w[i][r.draw - 1] for i in range(0, 30, 3)) / w[:, r.draw - 1].sum()
