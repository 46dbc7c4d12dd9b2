from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimweave.llm import lexical
from claimweave.llm.lexical import best_documents, build_index, compress, expand, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [] if text is None else TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, k=10):
    """Every document scored for every item by loops."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    out = []
    for item, text in set(items):
        scores = []
        for doc, tf, size in held:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed: int):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "été", "日本", "x1", "rare%d", "a_b", "İ", "\x85"]
    docs = [(None, "the of rare1"), (None, None), (4, ""), (4, " .!_ "), (5, "the"), (5, "the"), (-3, "the of")]
    for i in range(120):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 12, 60])))
        docs.append((rng.randint(0, 80), re.sub("%d", lambda _: str(rng.randint(0, 30)), text)))
    docs.append((500, "the été " * 5000))
    items = [(1, "the of rare1 rare2 rare2 the"), (1, "the of rare1 rare2 rare2 the"), (2, None), (3, ""), (4, "nowhere"), (5, "The"), (None, "x1 İ"), (6, "rare7 a_b 日本 \x85 été")]
    return docs, items


@pytest.mark.parametrize("terms, block", [(2_000_000, 128), (40, 2), (1, 1)])
def test_equals_plain_scores(spark, monkeypatch, terms, block):
    """One shard or one a document, one block or many; null, empty, repeated, very long; extra and clashing columns."""
    monkeypatch.setattr(lexical, "SHARD_TERMS", terms)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = corpus(terms)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    got = search(build_index(d), q)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(0)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search(build_index(d.limit(0)), q).count() == 0
    assert search(build_index(d), q.limit(0)).count() == 0
    assert search(build_index(d.where("text IS NULL")), q).count() == 0


def test_compressed_values_come_back():
    rng = np.random.default_rng(0)
    values = np.concatenate([np.arange(300), rng.integers(0, 1 << 40, 500), [127, 128, 16383, 16384, (1 << 62) - 1, 0]])
    data, at = compress(values)
    assert expand(data.tobytes()).tolist() == values.tolist() and at[-1] == len(data)
    assert [expand(data[a:b].tobytes()).tolist() for a, b in zip(at[:5], at[1:6])] == [[v] for v in values[:5]]
    assert expand(b"").tolist() == []


def test_merge_equals_full_scores():
    """Ties, few places and all lengths of lists; terms leave the merge without losing a document."""
    rng = random.Random(2)
    for _ in range(300):
        terms = []
        for _ in range(rng.randint(1, 8)):
            places = sorted(rng.sample(range(60), rng.randint(1, 60)))
            scores = [rng.choice([1, 5, 5, 40, 300]) for _ in places]
            terms.append((places, scores, max(scores)))
        total = Counter()
        for places, scores, _ in terms:
            for p, s in zip(places, scores):
                total[p] += s
        k = rng.choice([1, 3, 10])
        want = sorted(((s, p) for p, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]
        assert best_documents(terms, k) == want
