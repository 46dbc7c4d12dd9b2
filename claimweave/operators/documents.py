"""Documents into blocks, sections, sentences, candidates and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.expressions import first, text

# Words that name a section, the first that a heading contains decides.
SECTIONS = [
    *((w, "Environmental Performance") for w in "environmental emissions carbon climate energy water waste biodiversity pollution".split()),
    *((w, "Social Initiatives") for w in ("social", "employee", "workforce", "health", "safety", "human rights", "community", "diversity")),
    *((w, "Governance") for w in ("governance", "board", "ethics", "compliance", "risk management", "anti-corruption")),
    ("gri", "GRI Index"), ("sasb", "SASB Disclosure"), ("tcfd", "TCFD Alignment"), ("sdg", "SDG Mapping"), ("appendix", "Appendix"), ("methodology", "Methodology"), ("assurance", "Assurance Statement"),
    ("about this report", "Report Overview"), ("ceo", "Executive Summary"), ("chairman", "Executive Summary"), ("stakeholder", "Executive Summary"),
]
RELEVANT = ["Environmental Performance", "Social Initiatives", "GRI Index", "SASB Disclosure", "TCFD Alignment"]
# Signals of a claim in a sentence, and their tenths of the score; from KEEP on it is a candidate.
SIGNALS = {
    "has_number": (r"\b\d[\d,]*\.?\d*\s*(%|percent)?\b", 3),
    "has_unit": (r"(?i)\b(tonnes?|mt|co2e?|hectares?|ha|kwh|mwh|gwh|litres?|liters?|gallons?|cubic\s*m|m3|percent|%|MW|GW)\b", 2),
    "has_action_verb": (r"(?i)\b(reduced?|increased?|achieved?|maintained|eliminated?|planted|restored|protected|offset|diverted|recycled|conserved|invested|deployed|installed|generated|sourced|committed|certified|decreased|improved|expanded)\b", 2),
    "has_esg_keyword": (r"(?i)\b(carbon|emission|renewable|solar|wind|biodiversity|deforestation|reforestation|water|waste|energy|recycl|sustainab|ESG|climate|net.?zero|scope\s*[123]|greenhouse|GHG|pollution|circular\s*economy)\b", 2),
}
KEEP = 4
#: Terms that, with a digit, make a window worth reading.
WINDOW_TERMS = r"(?i)\b(emission|carbon|co2|ghg|scope\s*[123]|energy|renewable|solar|wind|water|waste|recycl|biodiversity|safety|ltifr|injur|fatal|diversity|gender|women|employee|workforce|training|governance|board|tonne|mwh|gwh|kwh|hectare|percent)\b|%"
#: Sentences end after a stop, question or exclamation mark before white space; shorter ones are dropped.
SENTENCE_END, SHORTEST = r"(?<=[.!?])\s+", 10


def triage(pages: DataFrame, sample: int = 5, digital: int = 100) -> DataFrame:
    """By document (doc_id, page_number, text): pages, mean characters of the first ones, and whether that is
    text or a scan."""
    some = F.col("page_number") <= sample
    avg = F.avg(F.when(some, F.length(F.trim("text"))))
    path = F.when(F.col("avg_chars") >= digital, "digital").otherwise("scanned")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(avg, 1).alias("avg_chars")).withColumn("path", path)


def classify(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``kind``, by place on the page, by size against the document's median, and by text."""
    sizes = blocks.where("font_size > 0").groupBy("doc_id").agg(F.median("font_size").alias("median"))
    joined = blocks.join(sizes, "doc_id", "left").withColumn("median", F.coalesce("median", F.lit(10.0)))
    t = "trim(text)"
    caption = " OR ".join(f"contains(lower({t}), '{w}')" for w in ("figure", "chart", "graph", "source:", "note:"))
    kind = first(
        [
            ("y0 < 60", "'page_header'"), ("y1 > 750", "'page_footer'"), ("font_size < median * 0.75 AND y1 > 650", "'footnote'"),
            (f"(font_size > median * 1.2 OR is_bold) AND length({t}) < 200 AND line_count <= 3", "'heading'"),
            (f"font_size < median * 0.85 AND length({t}) < 150 AND ({caption})", "'caption'"), (rf"regexp_like({t}, r'^\s*[•\-–—*\d]+[.)]\s')", "'list'"),
        ],
        "'paragraph'",
    )
    return joined.withColumn("kind", F.expr(kind)).drop("median")


def drop_repeating(classified: DataFrame) -> DataFrame:
    """Without headers and footers whose beginning is on three pages and three of five or more; of a text
    that is both, the count as a footer decides."""
    ends = classified.where("kind IN ('page_header', 'page_footer')").withColumn("key", F.expr("left(trim(text), 50)"))
    counts = ends.groupBy("doc_id", "key").agg(F.count_if(F.col("kind") == "page_footer").alias("f"), F.count("*").alias("n"))
    pages = classified.groupBy("doc_id").agg(F.max("page_number").alias("pages"))
    often = counts.join(pages, "doc_id").where("CASE WHEN f > 0 THEN f ELSE n END >= greatest(3, pages * 0.6)").select("doc_id", "key")
    keyed = classified.withColumn("key", F.expr("CASE WHEN kind IN ('page_header', 'page_footer') THEN left(trim(text), 50) END"))
    return keyed.join(often, ["doc_id", "key"], "left_anti").drop("key")


def sections(classified: DataFrame) -> DataFrame:
    """One row a heading: its number in the document, level by size (1 to 4, the rest 3), title, and the
    nearest heading before it of a lower level."""
    heads = classified.where("kind = 'heading'")
    by_size = Window.partitionBy("doc_id").orderBy(F.desc("font_size"))
    in_order = Window.partitionBy("doc_id").orderBy("page_number", "y0", "block_id")
    title = first([(f"contains(lower(text), {text(w)})", text(t)) for w, t in SECTIONS], "left(trim(text), 100)")
    level = F.when(F.dense_rank().over(by_size) <= 4, F.dense_rank().over(by_size)).otherwise(3)
    out = heads.withColumns({"level": level, "section": F.row_number().over(in_order), "title": F.expr(title)})
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("section")), ignorenulls=True).over(before) for k in (1, 2, 3)]
    parent = F.when(F.col("level") == 2, last[0]).when(F.col("level") == 3, F.coalesce(last[1], last[0])).when(F.col("level") == 4, F.coalesce(last[2], last[1], last[0]))
    return out.select("doc_id", "block_id", "page_number", "y0", "section", "level", "title", parent.alias("parent"))


def section_tree(headed: DataFrame) -> DataFrame:
    """``sections`` with nested intervals: ``enter``, a section's number when each is followed by all under it, and ``leave``,
    the last number under it; and ``children``, its sections by number.

    What is under a section is then a range: those whose ``enter`` lies from its own to its ``leave``; its
    ancestors are those whose ranges hold it. No recursion: levels end at four, so a section has three ancestors at
    most, and each is that of the last heading of the parent's level, found in one pass over the headings.
    """
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("level") == 2, F.lit(1))
    seen = [F.last(F.when(F.col("level") == k, F.lit(k)), ignorenulls=True).over(before) for k in (1, 2, 3)]
    at = at.when(F.col("level") == 3, F.coalesce(seen[1], seen[0])).when(F.col("level") == 4, F.coalesce(seen[2], seen[1], seen[0]))

    def above(column: str) -> Column:
        """The parent's own value of a column."""
        out = F.lit(None)
        for k in (1, 2, 3):
            out = F.when(F.col("__at") == k, F.last(F.when(F.col("level") == k, F.struct(column)), ignorenulls=True).over(before)[column]).otherwise(out)
        return F.when(F.col("parent").isNotNull(), out)

    out = headed.withColumn("__at", at).withColumn("__second", above("parent")).withColumn("__third", above("__second"))
    out = out.withColumn("__path", F.array_compact(F.array("__third", "__second", "parent", "section")))
    in_depth = Window.partitionBy("doc_id").orderBy("__path")
    out = out.withColumn("enter", F.row_number().over(in_depth))
    under = out.select("doc_id", F.explode("__path").alias("section")).groupBy("doc_id", "section").agg(F.count("*").alias("__under"))
    children = headed.where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("section")).agg(F.array_sort(F.collect_list("section")).alias("children"))
    met = out.join(under, ["doc_id", "section"]).join(children, ["doc_id", "section"], "left")
    met = met.withColumn("leave", (F.col("enter") + F.col("__under") - 1).cast("int")).withColumn("children", F.coalesce("children", F.array().cast("array<int>")))
    return met.drop("__at", "__second", "__third", "__path", "__under")


def under_section(placed: DataFrame, tree: DataFrame, section: int) -> DataFrame:
    """The blocks of ``placed`` (as of ``in_sections``) in a section of each document or in one under it."""
    top = tree.where(F.col("section") == section).select("doc_id", F.col("enter").alias("__low"), F.col("leave").alias("__high"))
    inside = tree.join(top, "doc_id").where("enter BETWEEN __low AND __high").select("doc_id", "section")
    return placed.join(inside, ["doc_id", "section"], "left_semi")


def subtree_counts(placed: DataFrame, tree: DataFrame) -> DataFrame:
    """``tree`` with ``blocks_under``: how many blocks are in each section and all under it, as the difference of
    running counts at both ends of its range."""
    own = placed.groupBy("doc_id", "section").agg(F.count("*").alias("__own"))
    counted = tree.join(own, ["doc_id", "section"], "left").withColumn("__own", F.coalesce("__own", F.lit(0)))
    counted = counted.withColumn("__upto", F.sum("__own").over(Window.partitionBy("doc_id").orderBy("enter")))
    ends = counted.select("doc_id", F.col("enter").alias("leave"), F.col("__upto").alias("__end"))
    met = counted.join(ends, ["doc_id", "leave"])
    return met.withColumn("blocks_under", F.col("__end") - F.col("__upto") + F.col("__own")).drop("__own", "__upto", "__end")


def in_sections(classified: DataFrame, headed: DataFrame) -> DataFrame:
    """``classified`` with the section and title of the heading that a block is or that comes last before it by
    page and height; blocks before the first heading belong to the first section."""
    marked = classified.join(headed.select("doc_id", "block_id", "section", "title"), ["doc_id", "block_id"], "left")
    reading = Window.partitionBy("doc_id").orderBy("page_number", "y0", "block_id")
    later = reading.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(reading), F.first(c, ignorenulls=True).over(later))
    return marked.withColumns({"section": near("section"), "title": near("title")})


def sentences(blocks: DataFrame) -> DataFrame:
    """The sentences of paragraph and list blocks with their place in the block, from 0."""
    parts = F.filter(F.transform(F.split("text", SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= SHORTEST)
    keep = [c for c in ("doc_id", "block_id", "page_number", "section", "title") if c in blocks.columns]
    return blocks.where("kind IN ('paragraph', 'list')").select(*keep, F.posexplode(parts).alias("idx", "sentence"))


def score(found: DataFrame) -> DataFrame:
    """``found`` with the signals of each sentence and their score in tenths, whole numbers so that no sum of
    fractions decides."""
    signals = {k: F.col("sentence").rlike(p) for k, (p, _) in SIGNALS.items()}
    out = found.withColumns({**signals, "in_section": F.coalesce(F.col("title").isin(RELEVANT), F.lit(False))})
    tenths = sum((F.col(k).cast("int") * w for k, (_, w) in SIGNALS.items()), F.col("in_section").cast("int"))
    return out.withColumn("tenths", tenths)


def context(scored: DataFrame) -> DataFrame:
    """Every candidate with the sentence before and after it in its block, and the text of the three."""
    order = Window.partitionBy("doc_id", "block_id").orderBy("idx")
    near = scored.withColumns({"before": F.coalesce(F.lag("sentence").over(order), F.lit("")), "after": F.coalesce(F.lead("sentence").over(order), F.lit(""))})
    head = F.concat(F.lit("[Section: "), F.coalesce("title", F.lit("Unknown Section")), F.lit("]"))
    lines = F.filter(F.array(head, "before", "sentence", "after"), lambda x: x != "")
    return near.where(F.col("tenths") >= KEEP).withColumn("chunk", F.trim(F.array_join(lines, "\n")))


def provenance(chunks: DataFrame, scored: DataFrame, found: DataFrame) -> DataFrame:
    """Chunk to candidate to sentence by id; chunks whose candidate or sentence is missing go."""
    key = ["doc_id", "block_id", "idx"]
    named = found.select(*key, "page_number", "section", "title")
    return chunks.select(*key).join(scored.where(F.col("tenths") >= KEEP).select(*key), key).join(named, key)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pack(lengths: pd.Series, budget: pd.Series) -> pd.Series:
    """The window of each sentence, filled one after another."""
    out = []
    for sizes, most in zip(lengths, budget, strict=True):
        window, held, numbers = 0, 0, []
        for n in sizes.tolist():
            if held and held + n > most:
                window, held = window + 1, 0
            held += n + 1
            numbers.append(window)
        out.append(numbers)
    return pd.Series(out, dtype=object)


def windows(found: DataFrame, budget: int = 3500) -> DataFrame:
    """``found`` with the number of its window in the document: sentences in reading order fill a window
    until the next one would exceed the budget of characters, a line end counted after each.

    The fill is sequential within a document, which no window function expresses: one pass over the lengths
    of its sentences (their texts stay where they are).
    """
    order = F.struct("page_number", "block_id", "idx")
    lengths = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.length("sentence").alias("n")))).alias("all"))
    packed = lengths.select("doc_id", F.col("all.at").alias("at"), _pack(F.col("all.n"), F.lit(budget)).alias("window"))
    numbered = packed.select("doc_id", F.explode(F.arrays_zip("at", "window")).alias("z")).select("doc_id", "z.at.page_number", "z.at.block_id", "z.at.idx", "z.window")
    return found.join(numbered, ["doc_id", "page_number", "block_id", "idx"])


def window_summary(windowed: DataFrame) -> DataFrame:
    """Sentences, characters, commonest title (the first by name among equals), and whether a window has both a
    digit and a term worth reading."""
    titled = windowed.withColumn("signal_digit", F.col("sentence").rlike(r"\d")).withColumn("signal_term", F.col("sentence").rlike(WINDOW_TERMS))
    by_title = titled.groupBy("doc_id", "window", "title").agg(F.count("*").alias("n"), F.sum(F.length("sentence") + 1).alias("size"), F.bool_or("signal_digit").alias("d"), F.bool_or("signal_term").alias("t"))
    best = F.min_by("title", F.when(F.col("title").isNotNull(), F.struct(-F.col("n"), "title")))
    return by_title.groupBy("doc_id", "window").agg(F.sum("n").alias("sentences"), F.sum("size").alias("chars"), F.coalesce(best, F.lit("Document")).alias("title"), (F.bool_or("d") & F.bool_or("t")).alias("signal"))
