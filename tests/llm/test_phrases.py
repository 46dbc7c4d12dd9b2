from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from claimweave.llm import phrases
from claimweave.llm.phrases import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, longest=3, least=10, cover=50, top=2000):
    """Counts of all n-grams in dictionaries, cuts and containment by loops."""
    counts: dict[str, Counter] = {}
    total: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed: int):
    rng = random.Random(seed)
    words = ["The", "of", "naïve", "x\x01", "x", "été", "A", "日本", "\x1c"]
    rows = [(None, "en"), ("", "en"), (None, None), ("only", None), (" \t ", "fr"), ("the of.the", "a\tb"), ("the of the", "a")]
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " - "]) for _ in range(rng.randint(1, 30)))
        rows.append((text, rng.choice(["en", "en", "de", None, "a\tb", "a"])))
    return rows + rows[20:60]


@pytest.mark.parametrize("hot_part, held, block", [(256, 400_000, 1 << 20), (5, 40, 8), (1, 40, 1)])
def test_equals_plain_counts(spark, monkeypatch, hot_part, held, block):
    """With no, some and all words hot, with many small flushes and texts split at each word; extra and clashing columns."""
    monkeypatch.setattr(phrases, "HOT_PART", hot_part)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rows = corpus(hot_part)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, n int, key string").repartition(5)
    for longest in (3, 4) if hot_part == 5 else (3,):
        got = collocations(df, longest=longest)
        assert got.columns == list(COLUMNS)
        want = plain(rows, longest=longest)
        assert sorted(map(tuple, got.collect())) == want and want


def test_ties_top_and_empty(spark):
    rows = [("b c. a b. a b c", "en")] * 12
    got = collocations(spark.createDataFrame(rows, "text string, lang string"), top=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, top=2)
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_stack_over_batches():
    """Beginnings that go on over the ends of batches are counted once."""
    import numpy as np
    import pyarrow as pa

    rows = sorted([("en\ta\tb", 2), ("en\ta\tc", 1), ("en\ta\t", 4), ("en\tb\ta", 5), ("fr\ta\tb", 7), ("en\ta\x01\tb", 3)], reverse=True)
    for size in (1, 2, 3, 6):
        batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + size]]), pa.array([n for _, n in rows[i : i + size]], pa.int64())], names=["key", "n"]) for i in range(0, len(rows), size)]
        got = Counter()
        for batch in phrases.count_beginnings(iter(batches), 2, lambda level, words, counts: np.ones(len(counts), bool)):
            for r in batch.to_pylist():
                assert (r["key"], r["words"]) not in got
                got[r["key"], r["words"]] = r["n"]
        assert got == {("fr\ta", 1): 7, ("fr\ta\tb", 2): 7, ("en\tb", 1): 5, ("en\tb\ta", 2): 5, ("en\ta\x01", 1): 3, ("en\ta\x01\tb", 2): 3, ("en\ta", 1): 7, ("en\ta\tc", 2): 1, ("en\ta\tb", 2): 2}
