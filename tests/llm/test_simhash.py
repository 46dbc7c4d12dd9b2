from __future__ import annotations

import random

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from claimweave.llm.components import connected_components
from claimweave.llm.simhash import chain_budgets, fingerprint, near_duplicates, near_links


def slow_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\t\n ß", max_size=60))
def test_fingerprint_is_the_bitwise_majority(text):
    assert fingerprint(text) == slow_fingerprint(text)


def slow_components(values, max_diff):
    left, found = set(values), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin((x ^ y) & (2**64 - 1)).count("1") <= max_diff}
            left -= near
            group |= near
            todo += near
        found |= {x: min(group) for x in group}
    return found


def planted(rng, n, radius):
    center = rng.getrandbits(64)
    out = set()
    for _ in range(n):
        x = center
        for b in rng.sample(range(64), rng.randint(0, radius)):
            x ^= 1 << b
        out.add(x)
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def check_links(spark, values, max_diff, segments):
    fps = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    links = near_links(fps, max_diff, segments)
    found = {r.node: r.component for r in connected_components(links).collect()}
    want = slow_components([signed(x) for x in values], max_diff)
    assert {x: found.get(x, x) for x in want} == want


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(30):
        values |= planted(rng, 6, 3)
    check_links(spark, values, 2, 5)


def test_a_crowded_block_loses_no_link(spark):
    rng = random.Random(6)
    check_links(spark, planted(rng, 400, 4) | {0, 2**63, 2**64 - 1}, 2, 5)


def test_wider_distance(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(10):
        values |= planted(rng, 8, 4)
    check_links(spark, values | planted(rng, 60, 4), 4, 9)


def test_some_ring_start_keeps_within_every_budget():
    rng = random.Random(8)
    budgets = chain_budgets(2, 5)
    assert budgets == [0, 0, 1, 1, 2]
    for _ in range(500):
        diff = [0] * 5
        for _ in range(2):
            diff[rng.randrange(5)] += 1
        assert any(all(sum(diff[(i + j) % 5] for j in range(k + 1)) <= budgets[k] for k in range(5)) for i in range(5))


def test_components_of_a_long_path_and_an_empty_table(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(path).collect()}
    assert found == {i: 0 for i in range(101)} | {500: 500, 501: 500}
    assert connected_components(path.where("a < 0")).count() == 0


def test_odd_documents(spark):
    base = "one two three four five six seven eight nine ten " * 5
    rows = [
        (3, None, "x"), (1, "", "x"), (2, " \n\t", None), (4, base, "x"), (5, base.upper(), "x"), (5, base.upper(), "x"),
        (None, base, "x"), (6, "w " * 50000, "x"), (7, "lone", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.id if r.id is not None else -1, r.fp, r.component) for r in near_duplicates(docs).collect())
    assert len(got) == len(rows)
    assert [(i, c) for i, _, c in got] == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7)]
    assert near_duplicates(docs.where("doc_id < 0")).count() == 0
