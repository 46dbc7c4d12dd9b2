from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from claimweave.llm import urls as U

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None), ("http://A.Net", "a.net", "", None), ("http://net/", "net", "/", "net/"),
    ("https://X.Example.NET/en/1?q#f", "x.example.net", "/en/1", "example.net/en/"), ("https://example.net/de/1", "example.net", "/de/1", "net/"),
    ("ftp://badexample.com/de/", "badexample.com", "/de/", None), ("http://example.com/de/x://y", "example.com", "/de/x://y", "example.com/de/"),
    ("a://b.org/fr/", "b.org", "/fr/", "org/fr/"), ("a://b.org/fr", "b.org", "/fr", None), ("x://h?p=/en/", "h", "", None), ("x://h#a?b", "h", "", None), ("://ÄB.net/ü", "Äb.net", "/ü", "net/"),
    ("http://example.net:80/en/", "example.net:80", "/en/", None), ("http://a\n.net/x\ny", "a\n.net", "/x\ny", "net/"),
]


def test_hosts_paths_and_fixed_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")
    empty = U.RuleIndex(spark.createDataFrame([], "token string, need array<string>, verdict string, confidence double"), 0)
    got = {r.page_id: r for r in U.judge(df, empty).collect()}
    verdicts = {a + b: v for a, b, v in U.RULES}
    for i, (_, host, path, rule) in enumerate(CASES):
        r = got[i]
        assert (r["__host"], r["__path"], r["__rule"]) == (host, path, rule)
        assert r["__verdict"] == verdicts.get(rule, "allow")


def slow_rules(rows, support, confidence, lift):
    """All token sets of all sizes by counting, for both labels, pruned as documented."""
    from itertools import combinations

    out = {}
    for verdict, label in (("block", True), ("allow", False)):
        n, k = len(rows), sum(b == label for _, b in rows)
        seen = {}
        for tokens, blocked in rows:
            for size in range(1, len(tokens) + 1):
                for c in combinations(sorted(tokens), size):
                    a, b = seen.get(c, (0, 0))
                    seen[c] = (a + 1, b + (blocked == label))
        ok = {c: b / a for c, (a, b) in seen.items() if b and b >= support * n and b / a >= confidence and b / a / (k / n) >= lift}
        out |= {(c, verdict): p for c, p in ok.items() if not any(set(d) < set(c) and q >= p for d, q in ok.items())}
    return out


def test_mined_rules_and_matches_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for _ in range(400):
        tokens = rng.sample(pool, rng.randint(1, 4))
        rows.append((tokens, rng.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.8 if "f" in tokens else 0.1)))
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    index = U.mine(df, 0.01, 0.6, 1.2, 1)
    want = slow_rules(rows, 0.01, 0.6, 1.2)
    got = {(tuple(r.need), r.verdict): r.confidence for r in index.rules.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want) and len(want) > 2
    assert all(r.token in r.need for r in index.rules.collect()) and {v for _, v in want} == {"block", "allow"}


def test_verdicts_follow_the_rules(spark):
    urls = [f"https://{h}.site.com/{p}/{i}" for i, (h, p) in enumerate([("ads", "x"), ("ads", "y"), ("www", "x"), ("m", "z")] * 40)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    tokens = U.tokens_of(F.col("url"), U.host_of(F.col("url")), U.path_of(F.col("url")))
    labelled = pages.select(tokens.alias("tokens"), F.col("url").contains("//ads").alias("blocked"))
    got = U.judge(pages.withColumn("token", F.lit("t")), U.mine(labelled, 0.05, 0.9, 1.1, 2)).collect()
    assert len(got) == 160 and all((r["__verdict"] == "block") == bool(re.search("//ads", r.url)) for r in got)


def test_no_labels_no_rules(spark):
    none = spark.createDataFrame([(["a"], None), (["b"], False), ([], True)], "tokens array<string>, blocked boolean")
    assert U.mine(none).count == 0
    pages = spark.createDataFrame([(1, "http://a.b/" + "x" * 50000), (1, "http://a.b/" + "x" * 50000), (None, None)], "page_id long, url string")
    assert [r["__verdict"] for r in U.judge(pages, U.mine(none)).collect()] == ["allow"] * 3
    assert U.judge(pages.where("page_id > 5"), U.mine(none)).count() == 0


def test_held_out_precision_and_no_rules_from_noise(spark):
    """Planted habits of bad hosts are found and hold on unseen urls; labels that say nothing give no rule."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        sub, path = rng.choice(["www", "m", "ads", "cdn", "blog"]), rng.choice(["en", "fr", "shop", "win", "news"])
        bad = rng.random() < (0.95 if sub == "ads" or path == "win" else 0.05)
        rows.append((i, f"https://{sub}.h{'abcdefgh'[i % 8]}.com/{path}/{rng.randrange(9999)}", bad, rng.random() < 0.3))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, coin boolean")
    tokens = U.tokens_of(F.col("url"), U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("tokens")
    seen = pages.where("page_id % 3 <> 0")
    got = U.judge(pages.where("page_id % 3 = 0"), U.mine(seen.select(tokens, F.col("bad").alias("blocked")))).collect()
    blocked = [r.bad for r in got if r["__verdict"] == "block"]
    assert sum(blocked) / len(blocked) >= 0.9 and sum(blocked) >= 0.85 * sum(r.bad for r in got)
    assert U.mine(seen.select(tokens, F.col("coin").alias("blocked"))).count == 0
