from __future__ import annotations

import random
import re

from hypothesis import given
from hypothesis import strategies as st

from claimweave.llm.langid import CrossParser, held_out, identify, labelled_sample, suffix_automaton


def reads(steps, word):
    state = 0
    for c in word:
        if c not in steps[state]:
            return False
        state = steps[state][c]
    return True


@given(st.text("ab", max_size=14), st.text("ab", max_size=6))
def test_automaton_reads_exactly_the_substrings(text, word):
    assert reads(suffix_automaton([ord(c) for c in text]), [ord(c) for c in word]) == (word in text)


def slow_phrases(text, sample):
    total = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        total, i = total + 1, j
    return total


def test_phrase_counts_equal_a_plain_greedy_parse():
    rng = random.Random(1)
    samples = {k: "".join(rng.choice(a) for _ in range(300)) for k, a in (("x", "abc "), ("y", "bcd "))}
    parser = CrossParser(samples)
    texts = ["".join(rng.choice("abcdz") for _ in range(n)) for n in (1, 5, 511, 512, 513, 5000)] + ["abc" * 900, None, "", "123"]
    cost, lettered = parser.entropies(texts)
    for i, t in enumerate(texts[:7]):
        for k, name in enumerate(parser.langs):
            plain = re.sub(" +", " ", samples[name])
            assert round(cost[i, k] * len(t) / parser.bits[k]) == slow_phrases(t, plain)
    assert lettered.tolist() == [True] * 7 + [False] * 3


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify(docs, labelled_sample(docs)).where(held_out()).select("lang", "__lang.lang_pred").collect()
    assert sum(a == b for a, b in got) >= 0.97 * len(got) > 20


def test_held_out_labels_have_no_influence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert labelled_sample(docs) == labelled_sample(other)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% \n", None), (4, "привет мир", "en"), (None, "the and of", "en"), (5, "the " * 40000, "de"), (5, "the " * 40000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS lang_pred")
    got = identify(docs, {"en": "the and of the and of", "de": "der die das und"}).select("doc_id", "__lang.*").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r[0] for r in identify(docs, {}).select("__lang.lang_pred").collect()] == ["und"] * 7
    assert labelled_sample(docs.where("doc_id > 9")) == {}


def test_phrases_that_never_meet_are_parsed_whole():
    """A period of seven against blocks of 512: phrases of the next block begin elsewhere for ever."""
    parser = CrossParser({"x": "abcdefg" * 30})
    for text in ("abcdefg" * 400, "gfedcba" * 400, "abcdefg" * 400 + "zz" + "cdefgab" * 300):
        assert round(parser.entropies([text])[0][0, 0] * len(text) / parser.bits[0]) == slow_phrases(text, "abcdefg" * 30)
