from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import documents as D
from claimweave.operators.analytics import signature_conflicts
from claimweave.operators.ordering import in_order, page, running_sums


def test_places_and_pages(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.5, float(rng.randint(-9, 9))])) for i in range(500)]
    df = spark.createDataFrame(rows, "claim_id long, v double").repartition(7)
    for descending in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
        ordered = in_order(df, "v", descending)
        got = {r.place: r.claim_id for r in ordered.collect()}
        assert [got[i] for i in range(1, 501)] == [r[0] for r in want]
        assert sorted(r.claim_id for r in page(ordered, 3, 40).collect()) == sorted(r[0] for r in want[80:120])
    assert in_order(df.limit(0), "v").count() == 0
    plan = in_order(df, "v")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_running_sums(spark):
    rows = [(i, (i * 7) % 11 if i % 5 else None) for i in range(100)]
    got = running_sums(spark.createDataFrame(rows, "k int, n long").repartition(3), [F.asc("k")], {"upto": "n"}).collect()
    total, want = 0, {}
    for k, n in rows:
        total += n or 0
        want[k] = total
    assert {r.k: r.upto for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_signature_conflicts_equal_all_pairs(spark, seed):
    """Values of all sizes and signs, ends of the range, nulls, both directions and none, reports that repeat values."""
    rng = random.Random(seed)
    values = [None, 0.0, 0.5, 0.7, 1.0, 1.2, 7.0, 10.0, 70.0, 100.0, 143.0, -1.0, -0.9, -10.0, -7.0, 13.0]
    rows = [(i, rng.choice("st"), rng.choice("abc"), rng.choice(values), rng.choice(["increase", "decreased", None, "absolute"])) for i in range(150)]
    df = spark.createDataFrame(rows, "claim_id long, claim_signature string, report_id string, metric_value double, metric_direction string").repartition(5)
    way = {"increase": 1, "decreased": -1}
    want = {}
    for _, s, r, v, d in rows:
        w = way.get(d, 0)
        key = (s, r, v, w)
        turned = apart = links = 0
        for _, s2, r2, v2, d2 in rows:
            if s2 == s and r2 != r:
                t = w * way.get(d2, 0) == -1
                a = v is not None and v2 is not None and abs(v - v2) / max(abs(v), abs(v2), 1.0) * 100 > 30 + 1e-7
                turned, apart, links = turned + t, apart + a, links + (t or a)
        if links:
            members = sum((s2, r2, v2, way.get(d2, 0)) == key for _, s2, r2, v2, d2 in rows)
            want[key] = (members, turned, apart, links)
    got = {(r.claim_signature, r.report_id, r.metric_value, r.way): (r.members, r.turned, r.apart, r.links) for r in signature_conflicts(df).collect()}
    assert got == want


def test_a_signature_of_very_many_values_ends(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id AS claim_id", "'s' AS claim_signature", "concat('r', id % 2) AS report_id", "double(id) AS metric_value", "CAST(NULL AS STRING) AS metric_direction")
    found = signature_conflicts(df)
    one = found.where("metric_value = 100000").first()
    near = sum(1 for b in range(70_000, 142_858) if b % 2 == 1)
    assert one.apart == one.links == n // 2 - near and found.count() == n


def test_subtrees(spark):
    """Parents that cross the order of reading, missing levels, and blocks under a section."""
    rng = random.Random(3)
    rows, want_under = [], {}
    for doc in range(6):
        last, parents, levels = {}, {}, {}
        for s in range(1, 30):
            level = rng.choice([1, 2, 2, 3, 4] if s > 1 or doc % 2 else [3])
            parent = next((last[k] for k in range(level - 1, 0, -1) if k in last), None)
            last[level] = s
            parents[s], levels[s] = parent, level
            rows.append((doc, s * 10, 1, float(s), s, level, f"t{s}", parent))
        for top in parents:
            under = {top}
            for s in parents:
                x = s
                while x is not None and x != top:
                    x = parents[x]
                if x == top:
                    under.add(s)
            want_under[doc, top] = under
    headed = spark.createDataFrame(rows, "doc_id int, block_id int, page_number int, y0 double, section int, level int, title string, parent int")
    tree = D.section_tree(headed).persist()
    got = {(r.doc_id, r.section): r for r in tree.collect()}
    for (doc, top), under in want_under.items():
        inside = {s for (d, s), r in got.items() if d == doc and got[doc, top].enter <= r.enter <= got[doc, top].leave}
        assert inside == under
        assert got[doc, top].children == sorted(s for d, _, _, _, s, _, _, p in rows if d == doc and p == top)
    placed = spark.createDataFrame([(d, b, s) for d in range(6) for s in range(1, 30) for b in range(s % 3)], "doc_id int, block_id int, section int")
    counts = {(r.doc_id, r.section): r.blocks_under for r in D.subtree_counts(placed, tree).collect()}
    assert counts == {k: sum(s % 3 for s in under) for k, under in want_under.items()}
    assert D.under_section(placed, tree, 2).count() == sum(sum(s % 3 for s in u) for (_, top), u in want_under.items() if top == 2)
