"""Places named in texts: all spans of a gazetteer in one pass, then the most specific one and its country."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.expressions import text
from claimweave.functions.scalars import CITIES, COUNTRIES, FACILITY

#: Letters and rows of a gazetteer up to which its automaton is broadcast; beyond that words are joined.
BROADCAST_LETTERS, BROADCAST_NAMES = 8_000_000, 200_000


def gazetteer(spark: SparkSession) -> DataFrame:
    """The countries and cities that are built in: (name, kind, sort, country)."""
    rows = [(c, "GPE", "country", c.title()) for c in COUNTRIES] + [(c, "GPE", "city", country) for country, cs in CITIES.items() for c in cs]
    return spark.createDataFrame(rows, "name string, kind string, sort string, country string")


def _lower(s: str) -> str:
    """Lower case, letter by letter, so that places in the text stay."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _ends(s: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of the span."""
    return not (start and s[start - 1].isalnum() and s[start].isalnum()) and not (end < len(s) and s[end].isalnum() and s[end - 1].isalnum())


def _spans_of(s: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    low = _lower(s)
    found = [(end + 1 - len(name), end + 1, name) for end, name in automaton.iter(low)] if len(automaton) else []
    return sorted(f for f in found if _ends(low, f[0], f[1]))


def _word_spans(s: str, longest: int) -> list[tuple[int, int, str]]:
    """All spans of up to ``longest`` letters that begin and end at ends of words."""
    low = _lower(s)
    starts = [i for i in range(len(low)) if not (i and low[i - 1].isalnum() and low[i].isalnum()) and not low[i].isspace()]
    return [(i, j, low[i:j]) for i in starts for j in range(i + 1, min(len(low), i + longest) + 1) if not low[j - 1].isspace() and _ends(low, i, j)]


def spans(texts: DataFrame, places: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with a row a span of a place's name in ``column``: start, end, name, kind (FAC, GPE or LOC), sort, country.

    Names match whole words, in any case; spans may overlap. The automaton of all names is broadcast if the gazetteer has been
    measured to be small enough; else the spans of words in the texts are joined to it. Null and empty
    texts and names have none; of names in the gazetteer twice each counts.
    """
    spark = texts.sparkSession
    known = places.where("trim(name) <> ''").withColumn("name", F.lower(F.trim("name"))).distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("letters"), F.coalesce(F.max(F.length("name")), F.lit(0)).alias("longest")).first()
    small = size.n <= BROADCAST_NAMES and size.letters <= BROADCAST_LETTERS
    held = spark.sparkContext.broadcast([r.name for r in known.select("name").distinct().collect()] if small else None)
    longest = size.longest

    @F.pandas_udf("array<struct<start: int, end: int, name: string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for name in held.value or []:
            automaton.add_word(name, name)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            yield pd.Series([[] if s is None else [{"start": a, "end": b, "name": n} for a, b, n in (_spans_of(s, automaton) if small else _word_spans(s, longest))] for s in batch])

    each = texts.withColumn("__s", F.explode(found(column))).select(*texts.columns, "__s.start", "__s.end", "__s.name")
    return each.join(F.broadcast(known) if small else known, "name").select(*texts.columns, "start", "end", "name", "kind", "sort", "country")


def resolve(texts: DataFrame, places: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, raw_text, specificity, country): the place a text is about, for texts that name one.

    Of overlapping spans the one that begins first counts, of those the longest. The first facility comes before the first
    country, city or other GPE, and that before the first LOC; a text that only speaks of a plant or site has the
    facility ``Company facility``. The country is the place's own, else that of the first country named beside it (none for a LOC).
    """
    found = spans(texts.select(key, F.col(column).alias("__text")), places, "__text")
    one = found.groupBy(key, "__text", "start", "end").agg(F.min(F.struct(F.expr("CASE kind WHEN 'FAC' THEN 0 WHEN 'GPE' THEN 1 ELSE 2 END").alias("o"), "kind", "sort", "country")).alias("p"))
    all_ = one.groupBy(key, "__text").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "p"))).alias("s"))
    kept = "aggregate(s, named_struct('at', 0, 'kept', slice(s, 1, 0)), (a, x) -> CASE WHEN x.start >= a.at THEN named_struct('at', -x.back, 'kept', concat(a.kept, array(x))) ELSE a END).kept"
    apart = all_.withColumn("s", F.expr(kept))
    chosen = apart.withColumn("c", F.expr("array_min(transform(s, x -> named_struct('o', x.p.o, 'x', x)))").getField("x"))
    nation = F.expr("get(filter(s, x -> x.p.kind = 'GPE' AND x.p.sort = 'country'), 0).p.country")
    raw = F.expr("substr(__text, c.start + 1, -c.back - c.start)")
    named = chosen.select(
        key, raw.alias("raw_text"), F.expr("CASE WHEN c.p.kind = 'FAC' THEN 'facility' WHEN c.p.kind = 'GPE' AND c.p.sort IN ('country', 'city') THEN c.p.sort ELSE 'region' END").alias("specificity"),
        F.when(F.col("c.p.kind") != "LOC", F.coalesce("c.p.country", nation)).alias("country"),
    )
    hinted = texts.join(named.select(key), key, "left_anti").where(F.expr(f"regexp_like(lower({column}), {text(FACILITY)})"))
    return named.unionByName(hinted.select(key, F.lit("Company facility").alias("raw_text"), F.lit("facility").alias("specificity"), F.lit(None).cast("string").alias("country")))
