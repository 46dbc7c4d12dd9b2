from __future__ import annotations

import pytest

from claimweave.llm import secrets as S

GHP = "ghp_9aK3bX7mQ2wE5rT8yU1iO4pL6sD0fG3hJ2kZ"
HEX = "a8c9479e0b1f224c7d"
FORMS = [
    (f'{{"id":1,"token":"{GHP}"}}', {GHP}),
    (f"https://h/cb?api_key={GHP}", {GHP}),
    (f"https://h/cb?api_key={GHP}&password={HEX}", {GHP, HEX}),
    (f"Server=db1;Password={HEX};Timeout=5", {HEX}),
    (f"f({GHP})", {GHP}),
    (f"token={GHP},secret={HEX}", {GHP, HEX}),
    ("password=$Tr0ub4dor#2024xyz", {"$Tr0ub4dor#2024xyz"}),
    ('{"password":"Ab,3$kQ9!zT4","n":1}', {"Ab,3$kQ9!zT4"}),
    ("postgres://me:q8Zt5Lw2Xv@db:5432/x", {"q8Zt5Lw2Xv"}),
    ("password = hunter2", {"hunter2"}),
    ("password: 'correcthorse'", {"correcthorse"}),
    ("secret = Ab$3k#9Q", {"Ab$3k#9Q"}),
]


@pytest.mark.parametrize("text,want", FORMS)
def test_every_candidate_of_a_form(spark, text, want):
    docs = spark.createDataFrame([(1, f"see {text} here", "src")], "doc_id long, text string, source string")
    got = [r.candidate for r in S.candidates(S.findings(docs, after_key=True)).collect()]
    assert want <= set(got) and len(got) == len(set(got))


def test_forms_are_scored(spark):
    docs = spark.createDataFrame([(i, f"see {t} here", "src") for i, (t, _) in enumerate(FORMS[:6])], "doc_id long, text string, source string")
    found = {(r.id, r.candidate) for r in S.scan(docs, S.train(S.example_findings(spark))).collect() if r.secret}
    assert {(i, x) for i, (_, want) in enumerate(FORMS[:6]) for x in want} <= found
