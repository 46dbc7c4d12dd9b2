from __future__ import annotations

import pytest

from claimweave.operators import places

NAMES = [
    ("York", "GPE", "city", "UK"), ("New York", "GPE", "city", "USA"), ("India", "GPE", "country", "India"), ("Indiana", "GPE", "region", None), ("Asia", "LOC", "region", None),
    ("Trombay plant", "FAC", "facility", None), ("İzmir", "GPE", "city", "Turkey"), ("St. John's", "GPE", "city", "Canada"), ("", "GPE", "city", None), (None, "GPE", "city", None), ("São Paulo", "GPE", "city", "Brazil"),
]
TEXTS = [
    (1, "From New York to York, then Asia"), (2, "Indianapolis and INDIA."), (3, "Asia and the trombay PLANT in India"), (4, "the Trombay plants, Yorkshire"), (5, None), (6, ""), (7, "İ İzmir office"),
    (8, "At St. John's, Asia"), (9, "our refinery runs"), (10, "nothing here"), (11, "São Paulo; Indiana, india"), (12, "Asia only"), (13, "York " * 3),
]


@pytest.mark.parametrize("letters", [8_000_000, 0])
def test_spans_and_places(spark, monkeypatch, letters):
    """Overlaps, ends of words, letters whose lower case is longer; by automaton and by join."""
    monkeypatch.setattr(places, "BROADCAST_LETTERS", letters)
    g = spark.createDataFrame(NAMES, "name string, kind string, sort string, country string")
    t = spark.createDataFrame(TEXTS, "id int, text string")
    got = {}
    for r in places.spans(t, g).collect():
        got.setdefault(r.id, set()).add((r.start, r.end, r.name))
    assert got[1] == {(5, 13, "new york"), (9, 13, "york"), (17, 21, "york"), (28, 32, "asia")}
    assert got[2] == {(17, 22, "india")} and 4 not in got and len(got[13]) == 3
    assert {n for *_, n in got[11]} == {"são paulo", "indiana", "india"} and got[8] == {(3, 13, "st. john's"), (15, 19, "asia")}
    found = {r.id: (r.raw_text, r.specificity, r.country) for r in places.resolve(t, g, "id").collect()}
    assert found[1] == ("New York", "city", "USA") and found[2] == ("INDIA", "country", "India")
    assert found[3] == ("trombay PLANT", "facility", "India") and found[9] == ("Company facility", "facility", None)
    assert found[11] == ("São Paulo", "city", "Brazil") and found[12] == ("Asia", "region", None) and found[8] == ("St. John's", "city", "Canada")
    assert not {5, 6, 10} & set(found)


def test_built_in_names_and_empty_tables(spark):
    g = places.gazetteer(spark)
    t = spark.createDataFrame([(1, "Mumbai offices"), (2, "across India")], "id int, text string")
    assert {r.id: (r.specificity, r.country) for r in places.resolve(t, g, "id").collect()} == {1: ("city", "India"), 2: ("country", "India")}
    assert places.resolve(t.limit(0), g, "id").count() == 0 and places.spans(t, g.limit(0)).count() == 0
