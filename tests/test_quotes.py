"""Quotes back to the sentences of their blocks."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from claimweave.operators import extraction as X


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def slow(source, sentences):
    held = [i for i, s in sentences if source.lower() in s.lower() or s.lower() in source.lower()]
    ratios = [(SequenceMatcher(None, source.lower(), s.lower()).ratio(), -i) for i, s in sentences]
    return min(held) if held else -max(ratios)[1] if max(ratios)[0] >= 0.5 else None


def test_a_quote_is_compared_with_few_sentences(monkeypatch):
    calls = []
    monkeypatch.setattr(X, "SequenceMatcher", lambda *a: calls.append(a) or SequenceMatcher(*a))
    rng = random.Random(1)
    for _ in range(40):
        sentences = [words(rng, 12) for _ in range(30)]
        at = rng.randrange(30)
        source = sentences[at].replace(" ", " x ", 1).upper()
        ratio, number = X.likest(source, sentences, range(30))
        assert number == at and ratio == SequenceMatcher(None, source.lower(), sentences[at]).ratio()
    assert len(calls) <= 80


def test_likest_is_that_of_all_comparisons():
    rng = random.Random(2)
    for _ in range(300):
        sentences = ["".join(rng.choices("abc ", k=rng.randrange(9))) for _ in range(rng.randrange(8))]
        numbers = rng.sample(range(20), len(sentences))
        source = "".join(rng.choices("abc ", k=rng.randrange(9)))
        every = [(-SequenceMatcher(None, source, s).ratio(), i) for s, i in zip(sentences, numbers, strict=True)]
        best = min((x for x in every if x[0] <= -0.5), default=None)
        assert X.likest(source, sentences, numbers) == ((None, None) if best is None else (-best[0], best[1]))


def test_blocks_of_more_sentences_than_a_row_has(spark, monkeypatch):
    monkeypatch.setattr(X, "SOME", 4)
    rng = random.Random(3)
    found = [(d, b, i, words(rng, 6)) for d in range(3) for b in range(2) for i in range(rng.randint(1, 30))] + [(5, 0, 0, None), (None, 0, 0, "no document")]
    quotes = [(d, b, q, rng.choice([s[3:20], s.replace(" ", " x ", 1).upper(), "zzzz qqqq", s[: len(s) // 2] + words(rng, 3)])) for q, (d, b, _, s) in enumerate(found) if s] + [(0, 0, 98, None), (9, 9, 99, "no block")]
    got = X.match_sentences(spark.createDataFrame(quotes, "doc_id int, block_id int, quote int, source string"), spark.createDataFrame(found, "doc_id int, block_id int, idx int, sentence string"))
    assert got.dtypes == [("doc_id", "int"), ("block_id", "int"), ("quote", "int"), ("idx", "int")]
    blocks = {}
    for d, b, i, s in found:
        blocks.setdefault((d, b), []).append((i, s))
    want = {q: slow(s, blocks[d, b]) if s and d is not None and (d, b) in blocks else None for d, b, q, s in quotes}
    assert {r.quote: r.idx for r in got.collect()} == want
