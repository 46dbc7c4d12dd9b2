"""Queries over documents and tables, with adapters that lay out the given tables as blocks and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import scalars as S
from claimweave.operators import documents as D
from claimweave.operators import extraction as X
from claimweave.operators import tables as B
from claimweave.operators.claims import normalize_aspects
from claimweave.plans.dialect import CLAIMS, PHRASES
from claimweave.sources.tables import claims, settled, table

#: A part's page of markdown: prose, a table of years, a row on its own and a form.
PAGES_SQL = """SELECT p_partkey AS page_id, concat('Some prose', chr(10), '| Metric | FY22 | FY23 | Unit |', chr(10), '|---|---|---|---|', chr(10),
    '| Scope 1 emissions FY22 | ', CAST(p_size AS STRING), ' | ', CAST(p_size + p_partkey % 3 - 1 AS STRING), ' | tonnes |', chr(10), '| Year | 2022 | 1,234.5 kg | |', chr(10), '| 12 | 3 | 4 | |', chr(10),
    '|  |  |', chr(10), '| Waste recycled | - | ', CAST(p_partkey % 97 AS STRING), ' % | |', chr(10), 'More prose', chr(10), '| lone row | 5 |', chr(10), 'And more', chr(10),
    '| Item | Frequency (annually) | Total 2021 | Total 2020 |', chr(10), '| Subject for review | 1 | 2 | 3 |', chr(10), '| Water consumption | 9 | ', CAST(p_size * 10 AS STRING), ' | 0 |', chr(10), '| Total employees | 7 | 2,000 | 1,000 | 8 |') AS markdown FROM {part}"""


def pages(spark, d):
    return spark.sql(PAGES_SQL, part=table(spark, d, "part"))


def blocks(spark, d):
    """The lines of each document as blocks, twelve to a page, with sizes that vary by length."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    n = "length(text)"
    return docs.where(f"{n} >= 3").selectExpr(
        "doc_id", "block_id", "text", "CAST(block_id div 12 + 1 AS INT) AS page_number", "40 + (block_id % 12) * 62 AS y0", "70 + (block_id % 12) * 62 AS y1",
        f"CASE {n} % 7 WHEN 0 THEN 16e0 WHEN 1 THEN 7e0 WHEN 2 THEN 14e0 ELSE 10e0 END AS font_size", "block_id % 11 = 3 AS is_bold", f"CAST(1 + {n} div 120 AS INT) AS line_count",
    )


def _classified(spark, d):
    return settled(D.classify(blocks(spark, d)))


def _placed(spark, d):
    c = _classified(spark, d)
    return D.in_sections(c, D.sections(c))


def _sentences(spark, d):
    return D.sentences(_placed(spark, d))


def _story(spark, d):
    """The sentences of a company's claims as its document: one block a page and year."""
    order = Window.partitionBy("company_id", "report_year", "page_number").orderBy("claim_id")
    c = claims(spark, d).withColumn("idx", F.row_number().over(order) - 1)
    title = "CASE page_number % 3 WHEN 0 THEN 'Environmental Performance' WHEN 1 THEN 'Governance' END AS title"
    return c.selectExpr("company_id AS doc_id", "report_year * 100 + page_number AS block_id", "page_number", "report_year AS section", title, "source_sentence AS sentence", "idx")


def _key(df, *columns):
    return df.select("doc_id", "block_id", *columns)


def section_subtrees(spark, d):
    """The sections under each section, and the blocks in it and in them."""
    c = _classified(spark, d)
    headed = settled(D.sections(c))
    found = D.subtree_counts(D.in_sections(c, headed), D.section_tree(headed))
    return found.select("doc_id", "section", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), (F.col("leave") - F.col("enter")).cast("long").alias("sections_under"), "blocks_under")


def context_window(spark, d):
    found = D.context(settled(D.score(_story(spark, d))))
    return _key(found, "idx", F.length("before").alias("before"), F.length("after").alias("after"), F.sha2("chunk", 256).alias("chunk"))


def provenance_join(spark, d):
    found = settled(_story(spark, d))
    scored = D.score(found)
    return _key(D.provenance(D.context(scored), scored, found), "idx", "page_number", "section", "title")


def char_budget_windows(spark, d):
    return D.window_summary(D.windows(settled(_story(spark, d)))).drop("signal")


def section_signal(spark, d):
    return D.window_summary(D.windows(settled(_story(spark, d)), 600)).select("doc_id", "window", "signal")


def triage_profile(spark, d):
    lines = blocks(spark, d).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return D.triage(lines)


def _rows(spark, d):
    return B.tables(pages(spark, d))


def _cells(spark, d):
    return B.table_cells(_rows(spark, d))


def rule_floor(spark, d):
    cells = _cells(spark, d).where("NOT is_form")
    node = normalize_aspects(cells.select(F.col("label").alias("aspect")), spark)
    unit = F.expr(S.unit_hint("concat(label, ' ', column)"))
    return cells.join(F.broadcast(node), cells.label == node.aspect, "left").select("page_id", "island", "row", "col", F.coalesce("node", F.lit("uncategorized")).alias("node"), unit.alias("unit"), "value")


def table_recall(spark, d):
    cells = settled(_cells(spark, d))
    claims = cells.where("page_id % 3 <> 0 AND col <> 2").select("page_id", (F.col("value") * 1.005).alias("value"))
    return B.recall(cells, claims)


def _pairs(spark, d):
    """Rows of the first table of each page as header and value pairs in column order."""
    raw = _rows(spark, d).select(F.concat_ws("_", "page_id", "island").alias("table_id"), "row", "cells")
    return raw


def table_rows(spark, d):
    found = B.named_rows(_pairs(spark, d))
    return found.select("table_id", F.col("row").cast("long").alias("row"), F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cells"))


def table_claims_legacy(spark, d):
    raw = _pairs(spark, d)
    head = raw.where("row = 0").select("table_id", F.col("cells").alias("header"))
    pairs = F.expr("filter(transform(slice(header, 1, least(size(header), size(cells))), (h, i) -> struct(h AS key, cells[i] AS value)), p -> p.value <> '')")
    rows = raw.where("row > 0").join(head, "table_id").select("table_id", (F.col("row") - 1).alias("row"), pairs.alias("pairs"))
    return B.legacy_claims(rows).select("table_id", F.col("row").cast("long").alias("row"), "aspect", "column", "value", "unit", "start_date", "end_date")


def table_claims_yoy(spark, d):
    found = B.yearly_claims(_rows(spark, d))
    return found.select("page_id", "island", "row", "col", "aspect", "year", "value", "unit", "direction", "year_from", "value_from", "pct")


def fy_repair(spark, d):
    p = pages(spark, d)
    claims = table(spark, d, "part").selectExpr("p_partkey AS claim_id", "p_partkey AS page_id", "CASE p_partkey % 4 WHEN 0 THEN 'Scope 1 in FY2022' WHEN 1 THEN 'FY 23 scope 1' WHEN 2 THEN 'FY22 and FY23' ELSE 'Scope 1' END AS label", "CAST(p_size + p_partkey % 3 - 1 AS DOUBLE) AS value")
    return B.repair_years(claims, p).select("claim_id", "value", "fy_column_fixed")


def rule_extract(spark, d):
    return X.rule_claims(_story(spark, d).select("doc_id", "block_id", "idx", "sentence")).drop("sentence")


def sentence_match(spark, d):
    found = settled(_sentences(spark, d).select("doc_id", "block_id", "idx", "sentence"))
    return X.match_sentences(X.quoted(found), found)


QUERIES = {
    "triage_profile": triage_profile,
    "layout_classify": lambda s, d: _key(D.classify(blocks(s, d)), "kind"),
    "repeat_filter": lambda s, d: _key(D.drop_repeating(_classified(s, d)), "kind"),
    "section_levels": lambda s, d: _key(D.sections(_classified(s, d)), "section", "level", "title", "parent"),
    "section_subtrees": section_subtrees,
    "block_section_asof": lambda s, d: _key(_placed(s, d), "section", "title"),
    "sentences": lambda s, d: _key(_sentences(s, d), "idx", "sentence"),
    "candidate_score": lambda s, d: _key(D.score(_story(s, d)).where(F.col("tenths") >= D.KEEP), "idx", "tenths"),
    "context_window": context_window,
    "provenance_join": provenance_join,
    "char_budget_windows": char_budget_windows,
    "section_signal": section_signal,
    "rule_extract": rule_extract,
    "gfm_tables": lambda s, d: _rows(s, d).select("page_id", "island", "row", F.concat_ws("|", "cells").alias("cells")),
    "gfm_cells": _cells,
    "rule_floor": rule_floor,
    "table_recall": table_recall,
    "table_rows": table_rows,
    "table_claims_legacy": table_claims_legacy,
    "table_claims_yoy": table_claims_yoy,
    "fy_repair": fy_repair,
    "sentence_match": sentence_match,
}

_W = r"[\p{L}\p{Nd}_]"
#: A pattern between two word ends, as alternatives of the comparison engine.
_word = lambda p: rf"(?i)(^|[^\p{{L}}\p{{Nd}}_])({p})($|[^\p{{L}}\p{{Nd}}_])"
BLOCKS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS block_id FROM documents),
    blocks AS (SELECT doc_id, block_id, text, CAST(block_id // 12 + 1 AS INT) AS page_number, 40 + (block_id % 12) * 62 AS y0, 70 + (block_id % 12) * 62 AS y1,
        CASE length(text) % 7 WHEN 0 THEN 16e0 WHEN 1 THEN 7e0 WHEN 2 THEN 14e0 ELSE 10e0 END AS font_size, block_id % 11 = 3 AS is_bold, 1 + length(text) // 120 AS line_count FROM lines WHERE length(text) >= 3)"""
CLASSIFIED = f"""{BLOCKS}, medians AS (SELECT doc_id, median(font_size) AS m FROM blocks GROUP BY doc_id),
    kinds AS (SELECT b.*, CASE WHEN y0 < 60 THEN 'page_header' WHEN y1 > 750 THEN 'page_footer' WHEN font_size < 0.75 * m AND y1 > 650 THEN 'footnote'
        WHEN (font_size > 1.2 * m OR is_bold) AND length(trim(text)) < 200 AND line_count <= 3 THEN 'heading'
        WHEN font_size < 0.85 * m AND length(trim(text)) < 150 AND regexp_matches(lower(text), 'figure|chart|graph|source:|note:') THEN 'caption'
        WHEN regexp_matches(trim(text), '^\\s*[•\\-–—*0-9]+[.)]\\s') THEN 'list' ELSE 'paragraph' END AS kind FROM blocks AS b JOIN medians USING (doc_id))"""
_TITLE = "CASE " + " ".join(f"WHEN lower(text) LIKE '%{w}%' THEN '{t}'" for w, t in D.SECTIONS) + " ELSE left(trim(text), 100) END"
HEADED = f"""{CLASSIFIED}, sizes AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS l FROM (SELECT DISTINCT doc_id, font_size FROM kinds WHERE kind = 'heading')),
    heads AS (SELECT k.*, CASE WHEN l <= 4 THEN l ELSE 3 END AS level, row_number() OVER (PARTITION BY k.doc_id ORDER BY page_number, y0, block_id) AS section, {_TITLE} AS title FROM kinds AS k JOIN sizes AS s ON k.doc_id = s.doc_id AND k.font_size = s.font_size WHERE kind = 'heading')"""
PLACED = f"""{HEADED}, placed AS (SELECT k.*, h.section, coalesce(h.title, f.title) AS title, coalesce(h.section, f.section) AS sec FROM kinds AS k ASOF LEFT JOIN heads AS h ON k.doc_id = h.doc_id AND k.block_id >= h.block_id LEFT JOIN heads AS f ON f.doc_id = k.doc_id AND f.section = 1)"""
SENTENCES = f"""{PLACED}, parts AS (SELECT doc_id, block_id, page_number, sec AS section, title, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 10) AS p FROM placed WHERE kind IN ('paragraph', 'list')),
    found AS (SELECT doc_id, block_id, page_number, section, title, unnest(p) AS sentence, CAST(generate_subscripts(p, 1) - 1 AS INT) AS idx FROM parts)"""
_UNIT = r"tonnes?|mt|co2e?|hectares?|ha|kwh|mwh|gwh|litres?|liters?|gallons?|cubic\s*m|m3|percent|MW|GW"
_VERB = D.SIGNALS["has_action_verb"][0].removeprefix(r"(?i)\b(").removesuffix(r")\b")
_TERM = D.SIGNALS["has_esg_keyword"][0].removeprefix(r"(?i)\b(").removesuffix(r")\b")
STORY = f"""{CLAIMS}, found AS (SELECT company_id AS doc_id, report_year * 100 + page_number AS block_id, page_number, report_year AS section, CASE page_number % 3 WHEN 0 THEN 'Environmental Performance' WHEN 1 THEN 'Governance' END AS title, source_sentence AS sentence,
        CAST(row_number() OVER (PARTITION BY company_id, report_year, page_number ORDER BY claim_id) - 1 AS INT) AS idx FROM claims)"""
SCORED = f"""{STORY}, scored AS (SELECT *, 3 * CAST(regexp_matches(sentence, '(^|[^\\p{{L}}\\p{{Nd}}_])[0-9]+($|[^\\p{{L}}\\p{{Nd}}_])') AS INT) + 2 * CAST(regexp_matches(sentence, '{_word(_UNIT)}') OR regexp_matches(sentence, '{_W}%{_W}') AS INT)
        + 2 * CAST(regexp_matches(sentence, '{_word(_VERB)}') AS INT) + 2 * CAST(regexp_matches(sentence, '{_word(_TERM)}') AS INT) + CAST(coalesce(title, '') IN ('Environmental Performance', 'Social Initiatives', 'GRI Index', 'SASB Disclosure', 'TCFD Alignment') AS INT) AS tenths FROM found)"""
_MD = f"pages_md AS ({PAGES_SQL.replace('{part}', 'part')})"
GFM = f"""{_MD}, ln AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM pages_md),
    pipes AS (SELECT *, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS is_row FROM ln), isl AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM pipes),
    body AS (SELECT page_id, CAST(island AS BIGINT) AS island, pos, list_transform(string_split(trim(trim(line), '|'), '|'), lambda c: trim(c)) AS cells FROM isl WHERE is_row),
    kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, island ORDER BY pos) - 1 AS row, count(*) OVER (PARTITION BY page_id, island) AS n FROM body WHERE len(list_filter(cells, lambda c: NOT regexp_full_match(c, '[-: ]*'))) > 0),
    gfm AS (SELECT page_id, island, CAST(row AS INT) AS row, cells FROM kept WHERE n >= 2)"""
CELLS = f"""{GFM}, cell AS (SELECT b.page_id, b.island, b.row, b.cells[1] AS label, h.cells AS header, unnest(b.cells) AS cell, CAST(generate_subscripts(b.cells, 1) - 1 AS INT) AS col FROM gfm AS b JOIN gfm AS h ON h.page_id = b.page_id AND h.island = b.island AND h.row = 0 WHERE b.row > 0 AND regexp_matches(b.cells[1], '[A-Za-z]{{3}}')),
    num AS (SELECT *, replace(regexp_extract(cell, '^[^0-9+-]*([-+]?[0-9][0-9,]*[.]?[0-9]*)\\s*[%a-zA-Z°/³²]*\\s*[*†‡]?$', 1), ',', '') AS raw FROM cell WHERE col > 0),
    cells AS (SELECT page_id, island, row, col, label, coalesce(header[col + 1], 'col' || col) AS "column", TRY_CAST(raw AS DOUBLE) AS value,
        regexp_matches(lower(coalesce(header[col + 1], '')), 'indicate whether|frequency \\(annually|subject for review') OR lower(label) LIKE 'subject for review%' AS is_form FROM num WHERE raw <> '' AND NOT regexp_full_match(raw, '(19|20)[0-9][0-9]'))"""
_RECALLED = """val AS (SELECT page_id, value * 1.005 AS v FROM cells WHERE page_id % 3 <> 0 AND col <> 2),
    hits AS (SELECT c.*, page_id IN (SELECT page_id FROM val) AS done, EXISTS (SELECT 1 FROM val AS v WHERE v.page_id = c.page_id AND (v.v = c.value OR greatest(abs(v.v), abs(c.value)) > 0 AND abs(v.v - c.value) / greatest(abs(v.v), abs(c.value)) <= 0.01)) AS hit FROM cells AS c),
    once AS (SELECT * FROM hits WHERE NOT is_form QUALIFY row_number() OVER (PARTITION BY page_id, lower(trim(label)), value ORDER BY island, row, col) = 1)"""
_TALLY = lambda name, source: f"SELECT '{name}' AS frame, count(*) AS cells, count(*) FILTER (hit) AS hits, count(*) FILTER (done) AS processed, floor(count(*) FILTER (hit) / count(*) * 1e4 + 0.5) / 1e4 AS recall, floor(count(*) FILTER (hit) / count(*) FILTER (done) * 1e4 + 0.5) / 1e4 AS processed_recall FROM {source}"
ORACLES = {
    "triage_profile": f"""WITH {BLOCKS}, p AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY block_id) AS t FROM blocks GROUP BY ALL), g AS (SELECT doc_id, count(*) AS pages, round(avg(length(trim(t))) FILTER (page_number <= 5), 1) AS avg_chars FROM p GROUP BY doc_id)
        SELECT doc_id, pages, avg_chars, CASE WHEN avg_chars >= 100 THEN 'digital' ELSE 'scanned' END AS path FROM g""",
    "layout_classify": f"WITH {CLASSIFIED} SELECT doc_id, block_id, kind FROM kinds",
    "repeat_filter": f"""WITH {CLASSIFIED}, e AS (SELECT *, left(trim(text), 50) AS k FROM kinds WHERE kind IN ('page_header', 'page_footer')), t AS (SELECT doc_id, max(page_number) AS pages FROM kinds GROUP BY doc_id),
        c AS (SELECT doc_id, k, coalesce(nullif(count(*) FILTER (kind = 'page_footer'), 0), count(*)) AS n FROM e GROUP BY doc_id, k),
        r AS (SELECT e.doc_id, e.block_id FROM e JOIN c USING (doc_id, k) JOIN t USING (doc_id) WHERE n >= 3 AND n >= 0.6 * pages)
        SELECT doc_id, block_id, kind FROM kinds WHERE (doc_id, block_id) NOT IN (SELECT doc_id, block_id FROM r)""",
    "section_levels": f"""WITH {HEADED} SELECT doc_id, block_id, section, level, title, (SELECT arg_max(p.section, p.level * 1000000000 + p.section) FROM heads AS p WHERE p.doc_id = h.doc_id AND p.section < h.section AND p.level < h.level) AS parent FROM heads AS h""",
    "section_subtrees": f"""WITH RECURSIVE {PLACED}, s AS MATERIALIZED (SELECT doc_id, section, (SELECT arg_max(p.section, p.level * 1000000000 + p.section) FROM heads AS p WHERE p.doc_id = h.doc_id AND p.section < h.section AND p.level < h.level) AS parent FROM heads AS h),
        under AS (SELECT doc_id, section AS top, section FROM s UNION ALL SELECT u.doc_id, u.top, s.section FROM under AS u JOIN s ON s.doc_id = u.doc_id AND s.parent = u.section),
        b AS (SELECT doc_id, sec AS section, count(*) AS n FROM placed GROUP BY ALL), k AS (SELECT doc_id, parent AS section, string_agg(section, ',' ORDER BY section) AS children FROM s WHERE parent IS NOT NULL GROUP BY ALL)
        SELECT u.doc_id, u.top AS section, coalesce(any_value(k.children), '') AS children, count(*) - 1 AS sections_under, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS blocks_under
        FROM under AS u LEFT JOIN b ON b.doc_id = u.doc_id AND b.section = u.section LEFT JOIN k ON k.doc_id = u.doc_id AND k.section = u.top GROUP BY u.doc_id, u.top""",
    "block_section_asof": f"WITH {PLACED} SELECT doc_id, block_id, sec AS section, title FROM placed",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, block_id, idx, sentence FROM found",
    "candidate_score": f"WITH {SCORED} SELECT doc_id, block_id, idx, tenths FROM scored WHERE tenths >= 4",
    "context_window": f"""WITH {SCORED}, n AS (SELECT *, coalesce(lag(sentence) OVER w, '') AS b, coalesce(lead(sentence) OVER w, '') AS a FROM scored WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY idx))
        SELECT doc_id, block_id, idx, length(b) AS before, length(a) AS after, sha256(trim('[Section: ' || coalesce(title, 'Unknown Section') || ']' || chr(10) || CASE WHEN b <> '' THEN b || chr(10) ELSE '' END || sentence || CASE WHEN a <> '' THEN chr(10) || a ELSE '' END)) AS chunk FROM n WHERE tenths >= 4""",
    "provenance_join": f"WITH {SCORED} SELECT doc_id, block_id, idx, page_number, section, title FROM scored WHERE tenths >= 4",
    "rule_extract": f"""WITH {STORY}, r AS (SELECT *, lower(sentence) AS l, regexp_extract(sentence, '{X.METRIC}', 1) AS v, regexp_extract(sentence, '{X.METRIC}', 2) AS u, [regexp_extract(sentence, '{X.TIMES}', 1), regexp_extract(sentence, '{X.TIMES}', 2), regexp_extract(sentence, '{X.TIMES}', 3), regexp_extract(sentence, '{X.TIMES}', 4)] AS t FROM found),
        c AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(l, '{p}') THEN '{a}'" for p, a in X.ASPECTS)} END AS aspect, CASE {' '.join(f"WHEN regexp_matches(l, '{p}') THEN '{a}'" for p, a in X.ACTIONS)} ELSE 'reported' END AS action, TRY_CAST(nullif(replace(v, ',', ''), '') AS DOUBLE) AS value FROM r)
        SELECT doc_id, block_id, idx, aspect, action, value, CASE {' '.join(f"WHEN regexp_matches(sentence, '{p}') THEN regexp_extract(sentence, '{p}', 1)" for p, _ in X.PLACES)} END AS location, CASE {' '.join(f"WHEN regexp_matches(sentence, '{p}') THEN '{k}'" for p, k in X.PLACES)} END AS specificity, CASE WHEN value IS NOT NULL THEN u END AS unit,
            CASE WHEN t[2] <> '' THEN t[1] || '-01-01' WHEN t[3] <> '' THEN CAST(CAST(t[3] AS INT) - 1 AS VARCHAR) || '-04-01' WHEN t[4] <> '' THEN t[4] || '-01-01' END AS start_date, CASE WHEN t[2] <> '' THEN t[2] || '-12-31' WHEN t[3] <> '' THEN t[3] || '-03-31' WHEN t[4] <> '' THEN t[4] || '-12-31' END AS end_date FROM c WHERE aspect IS NOT NULL""",
    "gfm_tables": f"WITH {GFM} SELECT page_id, island, row, array_to_string(cells, '|') AS cells FROM gfm",
    "gfm_cells": f"WITH {CELLS} SELECT * FROM cells",
    "rule_floor": f"""WITH {CELLS}, m AS (SELECT a.label, t.node, t.place, CASE WHEN lower(trim(a.label)) = phrase THEN 0 WHEN regexp_matches(lower(trim(a.label)), '\\b' || regexp_escape(phrase) || '\\b') THEN 1 WHEN regexp_matches(phrase, '\\b' || regexp_escape(lower(trim(a.label))) || '\\b') THEN 2 END AS kind, length(phrase) AS n
            FROM (SELECT DISTINCT label FROM cells) AS a, {PHRASES}), b AS (SELECT label, node FROM m WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY kind, CASE kind WHEN 1 THEN -n WHEN 2 THEN n ELSE 0 END, place) = 1),
        h AS (SELECT *, lower(label || ' ' || "column") AS t FROM cells WHERE NOT is_form)
        SELECT page_id, island, row, col, coalesce(node, 'uncategorized') AS node, CASE WHEN t LIKE '%\\%%' ESCAPE '\\' OR t LIKE '%percent%' THEN '%' WHEN t LIKE '%gj%' THEN 'GJ' WHEN t LIKE '%tonne%' THEN 'tonnes' ELSE 'unspecified' END AS unit, value FROM h LEFT JOIN b USING (label)""",
    "table_recall": f"WITH {CELLS}, {_RECALLED} {_TALLY('raw', 'hits')} UNION ALL {_TALLY('distinct', 'once')}",
    "table_rows": f"""WITH {GFM}, pr AS (SELECT b.page_id || '_' || b.island AS table_id, b.row - 1 AS row, unnest(h.cells) AS k, unnest(list_resize(b.cells, len(h.cells))) AS v FROM gfm AS b JOIN gfm AS h ON h.page_id = b.page_id AND h.island = b.island AND h.row = 0 WHERE b.row > 0)
        SELECT table_id, row, string_agg(k || '=' || v, ';' ORDER BY k) AS cells FROM pr WHERE k <> '' AND coalesce(v, '') <> '' GROUP BY table_id, row HAVING sum(length(v)) > 2""",
    "table_claims_legacy": f"""WITH {GFM}, pr AS (SELECT b.page_id || '_' || b.island AS table_id, b.row - 1 AS row, h.cells AS hd, b.cells AS c FROM gfm AS b JOIN gfm AS h ON h.page_id = b.page_id AND h.island = b.island AND h.row = 0 WHERE b.row > 0 AND h.cells[1] = 'Item'),
        f AS (SELECT table_id, row, c[1] AS label, unnest(hd) AS k, unnest(list_resize(c, len(hd))) AS v FROM pr), n AS (SELECT *, replace(replace(v, ',', ''), ' ', '') AS p FROM f WHERE k LIKE 'Total%' AND coalesce(v, '') <> '' AND label = 'Water consumption')
        SELECT table_id, row, 'water consumption' AS aspect, k AS "column", CAST(p AS DOUBLE) AS value, 'unspecified' AS unit, k[-4:] || '-01-01' AS start_date, k[-4:] || '-12-31' AS end_date FROM n""",
    "table_claims_yoy": f"""WITH {GFM}, pr AS (SELECT b.page_id, b.island, b.row, b.cells[1] AS label, unnest(h.cells) AS k, unnest(list_resize(b.cells, len(h.cells))) AS v, CAST(generate_subscripts(h.cells, 1) - 1 AS INT) AS col FROM gfm AS b JOIN gfm AS h ON h.page_id = b.page_id AND h.island = b.island AND h.row = 0 WHERE b.row > 0),
        n AS (SELECT *, TRY_CAST(nullif(regexp_extract(regexp_replace(v, '[,\\s]', '', 'g'), '-?[0-9]+[.]?[0-9]*', 0), '') AS DOUBLE) AS value, CASE WHEN k LIKE 'Total%' THEN k[-4:] END AS year,
            CASE WHEN label LIKE 'Scope 1%' THEN 'Scope 1 emissions' WHEN label LIKE 'Water c%' THEN 'Water consumption' WHEN label LIKE 'Waste r%' THEN 'Waste recycled' WHEN label LIKE 'Total emp%' THEN 'Employee count' END AS aspect FROM pr WHERE (k LIKE 'FY%' OR k LIKE 'Total%') AND coalesce(v, '-') NOT IN ('-', '')),
        u AS (SELECT *, CASE WHEN v LIKE '%\\%%' ESCAPE '\\' THEN '%' WHEN label LIKE 'Scope%' THEN 'tCO2e' WHEN label LIKE 'Water%' THEN 'ML' WHEN label LIKE 'Waste%' THEN 'MT' ELSE 'employees' END AS unit FROM n WHERE aspect IS NOT NULL AND value IS NOT NULL),
        y AS (SELECT *, CASE WHEN year IS NOT NULL THEN lag(value) OVER w END AS value_from, CASE WHEN year IS NOT NULL THEN lag(year) OVER w END AS year_from FROM u WINDOW w AS (PARTITION BY page_id, island, row, year IS NULL ORDER BY year, col))
        SELECT page_id, island, row, col, aspect, year, value, unit, CASE WHEN value_from IS NULL THEN 'absolute' WHEN value < value_from THEN 'decreased' WHEN value > value_from THEN 'increased' ELSE 'stable' END AS direction, year_from, value_from,
            CASE WHEN value_from <> value THEN CASE WHEN value_from <> 0 THEN floor(abs(value - value_from) / value_from * 1000 + 0.5) / 10 ELSE 0e0 END END AS pct FROM y""",
    "fy_repair": """SELECT p_partkey AS claim_id, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 1 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size + p_partkey % 3 - 1 AS DOUBLE) END AS value, p_partkey % 4 = 0 AND p_partkey % 3 <> 1 AS fy_column_fixed FROM part""",
}
