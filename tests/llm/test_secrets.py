from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from claimweave.llm import secrets as S


@pytest.fixture(scope="module")
def forest(spark):
    return S.train(S.example_findings(spark))


def test_unseen_findings_are_told_apart(spark):
    rows = S.example_findings(spark, 4000).withColumn("i", F.xxhash64("word") % 4 == 0)
    forest = S.train(rows.where("NOT i"))
    got = forest.transform(S.with_features(rows.where("i"))).select("secret", F.col("prediction") == 1).collect()
    assert len(got) > 500 and sum(a == b for a, b in got) >= 0.97 * len(got)


def test_planted_secrets_are_found_and_plain_words_left_alone(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = r"AKIA[0-9A-Z]{16}\b|password=[0-9a-f]{18}\b|\"[0-9a-f]{40}\""
    want = {(r.doc_id, m.strip('"').split("=")[-1]) for r in docs.collect() for m in re.findall(known, r.text)}
    found = S.scan(docs, forest).collect()
    hit = {(r.id, r.candidate) for r in found if r.secret}
    assert len(want) > 10 and len(want & hit) >= 0.97 * len(want)
    assert sum(1 for x in hit if x not in want) <= 0.1 * len(want) + 2


def slow_findings(text):
    words = re.split(r"[ \t\n\x0b\f\r]+", text)
    key = re.compile(f"(?i)({S.KEYS})[^=:]{{0,12}}[=:].{{6,}}")
    return [(i, w) for i, w in enumerate(words) if len(w) >= 10 and (re.search(S.RUN, w) or key.search(w))]


def test_findings_equal_a_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.id, r.nth, r.word) for r in S.findings(docs).collect())
    assert got == sorted((r.doc_id, i, w) for r in docs.collect() for i, w in slow_findings(r.text))


def test_odd_rows(spark, forest):
    rows = [(1, None, "a"), (2, "", None), (None, "password=0123456789abcdef01", None), (3, "x " * 30000 + "token = \"d6248c7e0803eef8ea89a4f70d9c91f951eb59ab\"", "s"), (4, "password=a8c9479e0b1f224c7d", "s"), (4, "password=a8c9479e0b1f224c7d", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"word": F.lit(1), "size": F.lit("z")})
    got = sorted((r.id or 0, r.nth, r.secret) for r in S.scan(docs, forest).collect())
    assert got == [(0, 0, True), (3, 30002, True), (4, 0, True), (4, 0, True)]
    assert S.scan(docs.where("doc_id > 9"), forest).count() == 0
