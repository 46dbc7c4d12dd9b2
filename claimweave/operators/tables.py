"""Markdown tables into rows, cells and claims; repair of values from the wrong column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import scalars as S
from claimweave.functions.expressions import first, text

# What marks a form rather than a measurement.
FORM_COLUMN, FORM_ROW = r"(?i)indicate whether|frequency \(annually|subject for review", r"(?i)^subject for review"
# Headers of value and unit columns.
VALUE_HEADER = r"(?i)fy\s*\d{2,4}|20\d{2}|amount|value|total|quantity|current\s*year|previous\s*year|target|actual|result"
METRIC_HEADER = r"(?i)fy\s*\d{2,4}|20\d{2}[-\s]?\d{0,2}|current\s*year|previous\s*year|amount|value|total|quantity|actual|result|this\s*year|last\s*year"
UNIT_HEADER = r"(?i)unit|uom|measure|metric"
# Words of a table worth reading, in its first five rows.
TABLE_WORDS = "emissions scope co2 ghg carbon energy electricity renewable water discharge consumption waste recycl divert landfill biodiversity hectares trees planted".split()
# Phrases of a row's label and the aspect that they name, in order.
LABEL_ASPECTS = [
    ("scope 1", "Scope 1 emissions"), ("scope 2", "Scope 2 emissions"), ("scope 3", "Scope 3 emissions"), ("total emissions", "total emissions"), ("ghg emissions", "GHG emissions"),
    ("energy consumption", "energy consumption"), ("electricity", "electricity consumption"), ("renewable energy", "renewable energy"), ("water consumption", "water consumption"), ("water withdrawal", "water withdrawal"),
    ("waste generated", "waste generation"), ("waste diverted", "waste diversion"), ("waste recycled", "waste recycling"), ("hazardous waste", "hazardous waste"), ("trees planted", "reforestation"),
]
# Patterns of a label, the name of what it measures and the sentence that states a figure of it.
TEMPLATES = [
    (r"scope\s*1", "Scope 1 emissions", "The company reported Scope 1 GHG emissions of {value} {unit} in {period}."),
    (r"scope\s*2", "Scope 2 emissions", "The company reported Scope 2 GHG emissions of {value} {unit} in {period}."),
    (r"scope\s*3", "Scope 3 emissions", "The company reported Scope 3 GHG emissions of {value} {unit} in {period}."),
    (r"(total\s+)?ghg|total\s+emission", "Total GHG emissions", "Total GHG emissions were {value} {unit} in {period}."),
    (r"energy\s+consumption|total\s+energy", "Energy consumption", "Total energy consumption was {value} {unit} in {period}."),
    (r"renewable\s+energy", "Renewable energy", "Renewable energy usage was {value} {unit} in {period}."),
    (r"water\s+(consumption|withdrawal|usage)", "Water consumption", "Water consumption was {value} {unit} in {period}."),
    (r"waste\s+to\s+landfill|landfill\s+waste", "Waste to landfill", "Waste to landfill was {value} {unit} in {period}."),
    (r"waste\s+(recycl|diverted|recovered)", "Waste recycled", "Waste recycled or diverted was {value} {unit} in {period}."),
    (r"total\s+(permanent\s+)?employee", "Employee count", "Total employees were {value} in {period}."),
    (r"female\s+(employee|worker)", "Female employees", "The company had {value} female employees in {period}."),
    (r"male\s+(employee|worker)", "Male employees", "The company had {value} male employees in {period}."),
    (r"ltifr|lost\s+time\s+injury", "Safety - LTIFR", "Lost Time Injury Frequency Rate (LTIFR) was {value} per million hours worked in {period}."),
    (r"injury|fatali|accident", "Safety incidents", "The number of safety incidents reported was {value} in {period}."),
    (r"tree|forest|reforest|hectare", "Reforestation", "The company reported {value} {unit} of reforestation or tree planting activity in {period}."),
    (r"(training|learning|development)\s+hour", "Training hours", "Total employee training hours were {value} in {period}."),
]
# What a label says of the unit, in order.
LABEL_UNITS = [
    (("tco2", "co2e", "ghg", "emission"), "tCO2e"), (("energy", "electricity"), "GJ"), (("water",), "ML"), (("waste",), "MT"), (("employee", "worker", "people", "person"), "employees"),
    (("hour", "hrs"), "hours"), (("hectare", "ha"), "hectares"),
]
FISCAL_YEAR = r"(?i)\bfy\s*'?\s*(?:20)?(\d{2})\b"


def _cells(line: str) -> Column:
    return F.transform(F.split(F.expr(f"trim(BOTH '|' FROM trim({line}))"), r"\|"), lambda c: F.trim(c))


def tables(pages: DataFrame, page: str = "page_id", markdown: str = "markdown") -> DataFrame:
    """(page, island, row, cells): the rows of every run of two or more lines between pipes, the header being
    row 0. Separator rows and rows without content are no rows, but do not end a table."""
    lines = pages.select(page, F.posexplode(F.split(markdown, r"\r?\n")).alias("pos", "line"))
    is_row = F.expr("length(trim(line)) > 0 AND trim(line) LIKE '|%' AND trim(line) LIKE '%|'")
    order = Window.partitionBy(page).orderBy("pos")
    marked = lines.withColumn("is_row", is_row).withColumn("island", F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(order))
    rows = marked.where("is_row").withColumn("cells", _cells("line")).where(F.exists("cells", lambda c: ~c.rlike("^[-: ]*$")))
    run = Window.partitionBy(page, "island")
    numbered = rows.withColumns({"row": F.row_number().over(run.orderBy("pos")) - 1, "rows": F.count("*").over(run)})
    return numbered.where("rows >= 2").select(page, "island", "row", "cells")


def table_cells(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, island, row, col, label, column, value, is_form): the cells of body rows that are numbers, if the
    row's first cell has a word of three letters."""
    head = rows.where("row = 0").select(page, "island", F.col("cells").alias("header"))
    body = rows.where("row > 0 AND cells[0] RLIKE '[A-Za-z]{3,}'").join(head, [page, "island"])
    each = body.select(page, "island", "row", F.col("cells")[0].alias("label"), "header", F.posexplode("cells").alias("col", "cell")).where("col > 0")
    column = F.expr("coalesce(get(header, col), concat('col', col))")
    out = each.withColumns({"value": F.expr(S.parse_number("cell")), "column": column}).where("value IS NOT NULL")
    is_form = F.col("column").rlike(FORM_COLUMN) | F.col("label").rlike(FORM_ROW)
    return out.select(page, "island", "row", "col", "label", "column", "value", is_form.alias("is_form"))


def distinct_facts(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """One cell for each label and value of a page, forms left out."""
    same = Window.partitionBy(page, F.lower(F.trim("label")), "value").orderBy("island", "row", "col")
    return cells.where("NOT is_form").withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")


def recall(cells: DataFrame, claims: DataFrame, page: str = "page_id", tolerance: float = 0.01) -> DataFrame:
    """Raw, distinct and processed-page recall of cells by claims (page, value) of the same page within the
    tolerance. A page without claims was not processed.

    Distinct values of a page meet its cells, so repeated figures cost nothing.
    """
    values = claims.where("value IS NOT NULL").groupBy(page).agg(F.collect_set("value").alias("found"))
    hit = F.expr(f"coalesce(exists(found, v -> v = value OR (greatest(abs(v), abs(value)) > 0 AND abs(v - value) / greatest(abs(v), abs(value)) <= {tolerance})), false)")

    def tally(some: DataFrame, name: str) -> DataFrame:
        j = some.join(values, page, "left").withColumn("hit", hit)
        part = j.agg(F.count("*").alias("cells"), F.count_if("hit").alias("hits"), F.count_if(F.col("found").isNotNull()).alias("processed"))
        return part.select(F.lit(name).alias("frame"), "cells", "hits", "processed", F.expr("floor(hits / cells * 1e4 + 0.5) / 1e4").alias("recall"), F.expr("CASE WHEN processed > 0 THEN floor(hits / processed * 1e4 + 0.5) / 1e4 END").alias("processed_recall"))

    return tally(cells, "raw").unionByName(tally(distinct_facts(cells, page), "distinct"))


def named_rows(raw: DataFrame) -> DataFrame:
    """Rows (table_id, row, cells) as maps from header to value: unnamed columns go, a repeated name gets its
    number, tables need two named columns and rows more than two characters."""
    head = raw.where("row = 0").select("table_id", F.posexplode("cells").alias("col", "name")).where("trim(coalesce(name, '')) <> ''").withColumn("name", F.trim("name"))
    seen = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("col")) - 1
    named = head.withColumn("seen", seen).withColumn("name", F.expr("CASE WHEN seen > 0 THEN concat(name, ' (', seen, ')') ELSE name END"))
    named = named.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "name"))).alias("names")).where("size(names) >= 2")
    filled = raw.where("row > 0").join(named, "table_id")
    pairs = F.filter(F.transform("names", lambda n: F.struct(n["name"].alias("key"), F.trim(F.coalesce(F.get("cells", n["col"]), F.lit(""))).alias("value"))), lambda p: p["value"] != "")
    out = filled.select("table_id", (F.col("row") - 1).alias("row"), pairs.alias("pairs"))
    return out.where("aggregate(pairs, 0, (n, p) -> n + length(p.value)) > 2").select("table_id", "row", F.map_from_entries("pairs").alias("cells"))


def legacy_claims(rows: DataFrame) -> DataFrame:
    """One claim for each value column of the rows (table_id, row, pairs in column order) of a table whose
    first five rows have a word of TABLE_WORDS: the first other column is the label and names the aspect."""
    words = " OR ".join(f"contains(t, '{w}')" for w in TABLE_WORDS)
    early = rows.where("row < 5").select("table_id", F.expr("lower(concat_ws(' ', concat(transform(pairs, p -> p.key), transform(pairs, p -> p.value))))").alias("t"))
    good = early.groupBy("table_id").agg(F.bool_or(F.expr(words)).alias("good")).where("good").select("table_id")
    role = f"CASE WHEN p.key RLIKE '{UNIT_HEADER}' THEN 'unit' WHEN p.key RLIKE r'{VALUE_HEADER}' THEN 'value' ELSE 'label' END"
    roles = rows.join(good, "table_id").withColumn("r", F.expr(f"transform(pairs, p -> struct({role} AS role, p.key AS key, p.value AS value))"))
    one = lambda sql, name: F.expr(sql).alias(name)
    split = roles.select("table_id", "row", one("get(filter(r, x -> x.role = 'label'), 0).value", "label"), one("get(reverse(filter(r, x -> x.role = 'unit')), 0).value", "unit"), one("filter(r, x -> x.role = 'value')", "figures"))
    aspect = first([(f"contains(lower(label), {text(k)})", text(v)) for k, v in LABEL_ASPECTS], "NULL")
    each = split.withColumn("aspect", F.expr(aspect)).where("aspect IS NOT NULL").select("table_id", "row", "label", "unit", "aspect", F.explode("figures").alias("f"))
    plain = "replace(replace(f.value, ',', ''), ' ', '')"
    value = rf"coalesce(try_cast({plain} AS DOUBLE), try_cast(nullif(regexp_extract({plain}, '([0-9.]+)', 1), '') AS DOUBLE))"
    out = each.withColumn("value", F.expr(value)).where("value IS NOT NULL")
    fy, year = r"regexp_extract(f.key, '(?i)fy *([0-9]{4})', 1)", "regexp_extract(f.key, '(20[0-9]{2})', 1)"
    ends = f"CASE WHEN {fy} <> '' THEN concat({fy}, '-03-31') WHEN {year} <> '' THEN concat({year}, '-12-31') END"
    starts = f"CASE WHEN {fy} <> '' THEN concat(CAST({fy} AS INT) - 1, '-04-01') WHEN {year} <> '' THEN concat({year}, '-01-01') END"
    unit = S.unit_named("lower(coalesce(nullif(unit, ''), label))")
    return out.select("table_id", "row", "aspect", F.col("f.key").alias("column"), "value", F.expr(f"coalesce({unit}, 'unspecified')").alias("unit"), F.expr(starts).alias("start_date"), F.expr(ends).alias("end_date"))


def yearly_claims(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """Sentences that state the figures of a table's rows: the first year's alone, each later one's against the
    year before (up, down or stable), and one for each value column without a year."""
    head = rows.where("row = 0").select(page, "island", F.col("cells").alias("header"))
    label = F.expr("get(filter(cells, c -> trim(c) <> ''), 0)")
    body = rows.where("row > 0 AND size(cells) >= 2").withColumn("label", label).where("length(label) >= 3").join(head, [page, "island"])
    kind = first([(f"regexp_like(lower(label), r'{p}')", str(i)) for i, (p, _, _) in enumerate(TEMPLATES)], "NULL")
    each = body.withColumn("kind", F.expr(kind)).where("kind IS NOT NULL").select(page, "island", "row", "label", "kind", "header", F.posexplode("cells").alias("col", "cell"))
    each = each.withColumn("head", F.expr("get(header, col)")).where(F.col("head").rlike(METRIC_HEADER) & ~F.upper(F.trim("cell")).isin("NA", "N/A", "-", ""))
    number = rf"try_cast(nullif(regexp_extract(regexp_replace(cell, r'[,\s]', ''), r'-?\d+\.?\d*', 0), '') AS DOUBLE)"
    units = [("contains(cell, '%')", "'%'")] + [(" OR ".join(f"contains(lower(label), '{w}')" for w in ws), text(u)) for ws, u in LABEL_UNITS] + [("contains(lower(label), 'per') AND contains(lower(label), 'million')", "'per million person-hours'")]
    points = each.withColumns({"value": F.expr(number), "unit": F.expr(first(units, "'units'")), "year": F.expr("nullif(regexp_extract(head, '(20[0-9]{2})', 1), '')")}).where("value IS NOT NULL")
    order = Window.partitionBy(page, "island", "row", F.col("year").isNull()).orderBy("year", "col")
    points = points.withColumns({"old": F.when(F.col("year").isNotNull(), F.lag("value").over(order)), "from": F.when(F.col("year").isNotNull(), F.lag("year").over(order))})
    # a row's unit is that of the column looked at last
    last = F.last("unit").over(Window.partitionBy(page, "island", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    points = points.withColumn("unit", F.when(F.col("year").isNull(), F.col("unit")).otherwise(last))
    way = "CASE WHEN old IS NULL THEN 'absolute' WHEN value < old THEN 'decreased' WHEN value > old THEN 'increased' ELSE 'stable' END"
    pct = "CASE WHEN old <> 0 THEN floor(abs(value - old) / old * 1000 + 0.5) / 10 ELSE 0e0 END"
    names = first([(f"kind = {i}", text(n)) for i, (_, n, _) in enumerate(TEMPLATES)], "NULL")
    return points.select(page, "island", "row", "col", F.expr(names).alias("aspect"), "year", "value", "unit", F.expr(way).alias("direction"), F.col("from").alias("year_from"), F.col("old").alias("value_from"), F.expr(f"CASE WHEN old IS NOT NULL AND old <> value THEN {pct} END").alias("pct"))


def sentence_of(claims: DataFrame) -> DataFrame:
    """``claims`` of ``yearly_claims`` with the sentence that states each."""
    shown = lambda c: f"CASE WHEN {c} >= 1 THEN format_number({c}, 0) ELSE CAST({c} AS STRING) END"
    period = "CASE WHEN year IS NULL THEN 'the reporting period' ELSE concat('FY', year) END"
    alone = "CASE aspect " + " ".join(f"WHEN {text(n)} THEN replace(replace(replace({text(t)}, '{{value}}', {shown('value')}), '{{unit}}', unit), '{{period}}', {period})" for _, n, t in TEMPLATES) + " END"
    moved = f"concat(aspect, ' ', direction, ' from ', format_number(value_from, 0), ' ', unit, ' in FY', year_from, ' to ', format_number(value, 0), ' ', unit, ' in FY', year, ' (', CASE direction WHEN 'increased' THEN '+' ELSE '−' END, pct, '%).')"
    stable = "concat(aspect, ' remained stable at ', format_number(value, 0), ' ', unit, ' in both FY', year_from, ' and FY', year, '.')"
    return claims.withColumn("sentence", F.expr(f"CASE direction WHEN 'absolute' THEN {alone} WHEN 'stable' THEN {stable} ELSE {moved} END"))


def repair_years(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claims`` (claim_id, page_id, label, value) with the value of the year that the label names, where the
    page's table shows the claim's value under another year: the first line that decides counts."""
    lines = pages.select("page_id", F.posexplode(F.split("markdown", r"\r?\n")).alias("pos", "line")).where("contains(line, '|')")
    cells = lines.withColumn("cells", F.split("line", r"\|"))
    years = F.transform("cells", lambda c: F.regexp_extract_all(c, F.lit(FISCAL_YEAR), 1))
    years = F.transform(years, lambda y: F.when(F.size(y) == 1, y[0]))
    numbers = F.expr(f"transform(cells, c -> {S.cell_number('c')})")
    marked = cells.withColumns({"years": years, "numbers": numbers}).withColumn("head", F.expr("CASE WHEN size(filter(years, y -> y IS NOT NULL)) >= 2 THEN years END"))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    body = marked.withColumn("map", F.last("head", ignorenulls=True).over(before)).where("head IS NULL AND map IS NOT NULL").select("page_id", "pos", "numbers", "map")
    named = claims.withColumn("fys", F.array_distinct(F.regexp_extract_all("label", F.lit(FISCAL_YEAR), 1))).where("size(fys) = 1 AND value IS NOT NULL").select("claim_id", "page_id", "value", F.col("fys")[0].alias("fy"))
    met = named.join(body, "page_id")
    right = "filter(sequence(0, size(map) - 1), i -> map[i] = fy)"
    right_has = f"exists({right}, i -> get(numbers, i) = value)"
    wrong_has = "exists(sequence(0, size(map) - 1), i -> map[i] IS NOT NULL AND map[i] <> fy AND get(numbers, i) = value)"
    fixed = f"get(filter(transform({right}, i -> get(numbers, i)), v -> v IS NOT NULL), 0)"
    decided = met.where(f"size({right}) > 0 AND ({right_has} OR {wrong_has})").select("claim_id", "pos", F.expr(f"CASE WHEN coalesce({right_has}, false) THEN NULL ELSE {fixed} END").alias("fixed"))
    first_line = decided.groupBy("claim_id").agg(F.min_by("fixed", "pos").alias("fixed"))
    out = claims.join(first_line, "claim_id", "left")
    return out.withColumn("fy_column_fixed", F.col("fixed").isNotNull()).withColumn("value", F.coalesce("fixed", "value")).drop("fixed")
