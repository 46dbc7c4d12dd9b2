from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import hooks
from claimweave.operators.extraction import reply_claims


def nli():
    def fake_nli():
        said = {"fell": ("LABEL: CONTRADICTION", 0.91), "maybe": ("contradiction", 0.6), "same": ("NEUTRAL", 0.99), "wild": ("contradiction", 7.0), "none": ("contradiction", None)}

        def model(a, b):
            assert not any("ruled" in x or not x.strip() for x in [*a, *b]), "the rules had decided"
            found = [said[x.split()[0]] for x in a]
            return [f[0] for f in found], [f[1] for f in found]

        return model

    return fake_nli


def test_model_is_asked_only_where_rules_are_silent(spark):
    rows = [(1, "fell sharply", "rose", None), (2, "maybe", "b", None), (3, "same", "b", None), (4, "ruled", "b", "Hard"), (5, " ", "b", None), (6, None, "b", None), (7, "wild", "b", None), (8, "none", "b", None)]
    got = {r.id: r for r in hooks.textual_verdicts(spark.createDataFrame(rows, "id int, text_a string, text_b string, conflict string"), nli(), batch_size=2).collect()}
    assert len(got) == 8
    assert (got[1].conflict, got[1].severity, got[1].label, got[1].confidence) == ("Textual", "High", "contradiction", 0.91)
    assert all(got[i].conflict is None for i in (2, 3, 5, 6, 7, 8)) and got[4].conflict == "Hard"
    assert [got[i].label for i in (2, 3, 4, 5, 6, 7, 8)] == ["contradiction", "neutral", "skipped", "neutral", "neutral", "neutral", "neutral"]
    assert [got[i].confidence for i in (4, 5, 7)] == [1.0, 0.0, 0.0]
    assert hooks.textual_verdicts(spark.createDataFrame([], "id int, text_a string, text_b string, conflict string"), nli()).count() == 0


def extractor():
    def fake_extractor():
        def model(texts):
            assert all("emissions" in t for t in texts) and len(set(texts)) == len(texts)
            return ['```json\n{"claims": [{"aspect": "emissions", "action": "cut"}]}\n```' if "cut" in t else "I cannot say" for t in texts]

        return model

    return fake_extractor


def test_extractor_sees_only_texts_with_a_signal(spark):
    rows = [(1, "we cut emissions"), (2, "we cut emissions"), (3, "hello"), (4, None), (5, "emissions, well")]
    units = spark.createDataFrame(rows, "u int, text string").repartition(1)
    got = hooks.extracted(units, extractor(), F.contains("text", F.lit("emissions"))).persist()
    assert {r.u for r in got.collect()} == {1, 2, 3, 4, 5} and {r.u for r in got.where("reply IS NOT NULL").collect()} == {1, 2, 5}
    assert sorted(r.u for r in reply_claims(got).select("u").collect()) == [1, 2]


def judge():
    def fake_judge():
        def model(claims, evidence):
            assert all(e.strip() for e in evidence)
            return [" Supported " if "yes" in e else "perhaps" for e in evidence]

        return model

    return fake_judge


def test_no_call_without_evidence(spark):
    rows = [(1, "c", "yes", "inconclusive"), (2, "c", "no", "inconclusive"), (3, "c", None, "inconclusive"), (4, "c", " ", None), (5, "c", "yes", "contradicted"), (6, "c", "yes", None)]
    got = {r.id: (r.verdict, r.by) for r in hooks.explained(spark.createDataFrame(rows, "id int, claim string, evidence string, verdict string"), judge()).collect()}
    assert got == {1: ("supported", "model"), 2: ("inconclusive", "rule"), 3: ("inconclusive", "rule"), 4: (None, "rule"), 5: ("contradicted", "rule"), 6: ("supported", "model")}
