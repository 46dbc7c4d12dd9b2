"""Tables of claims, reports, reviews and units of work as they are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the reports (or documents) of ``new`` in their place; without new claims nothing goes."""
    gone = new.select("report_id").distinct()
    return old.join(gone, "report_id", "left_anti").unionByName(new, allowMissingColumns=True)


def write_reports(new: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the reports in ``new``; an empty input leaves the table as it is."""
    if not new.isEmpty():
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_id").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of the same keys."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def todo(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Units without a finished line in a checkpoint (text); a torn last line does not count, and a line with
    claims that cannot be read still finishes its unit."""
    done = lines.select(F.from_json("text", "unit STRING, claims STRING, torn STRING", {"columnNameOfCorruptRecord": "torn"}).alias("l")).where("l.torn IS NULL AND l.unit IS NOT NULL")
    return units.join(done.select(F.col("l.unit").alias("unit")).distinct(), "unit", "left_anti")


def snapshot(claims: DataFrame) -> DataFrame:
    """Twelve flat columns of a claim for a sheet, the sentence cut at 200 characters."""
    names = ["claim_id", "company_name", "report_year", "aspect", "normalized_aspect", "action", "claim_type", "metric_value", "metric_unit", "time_bucket", "location_scope"]
    return claims.select(*names, F.expr("left(source_sentence, 200)").alias("source_sentence"))


def backfill_company(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """An unset company from the first phrase that the text or the document's name contains."""
    found = F.lit(None).cast("string")
    for phrase, name in reversed(rules):
        found = F.when(F.contains(F.lower("text"), F.lit(phrase)) | F.contains(F.lower("doc"), F.lit(phrase)), name).otherwise(found)
    return rows.withColumn("company", F.coalesce("company", found))


def page_runs(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages of a document: first and last."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    return pages.distinct().withColumn("island", island).groupBy("doc", "island").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("island")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, text, absolute) of the anchors of each page's html, relative ones made absolute by the
    page's url."""
    anchor = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(anchor), 0)).alias("nth", "tag"))
    cut = found.withColumns({"href": F.regexp_extract("tag", anchor, 1), "text": F.trim(F.regexp_replace(F.regexp_extract("tag", anchor, 2), r"<[^>]*>", ""))})
    scheme, host = "regexp_extract(url, '^([^:/?#]+):', 1)", "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
    base = "regexp_extract(url, '^([^:/?#]+://[^/?#]*(/[^?#]*/)?)', 1)"
    absolute = f"CASE WHEN href RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*:' THEN href WHEN startswith(href, '//') THEN concat({scheme}, ':', href) WHEN startswith(href, '/') THEN concat({host}, href) WHEN href = '' THEN url WHEN startswith(href, '#') THEN concat(substring_index(url, '#', 1), href) WHEN endswith({base}, '/') THEN concat({base}, href) ELSE concat({base}, '/', href) END"
    return cut.select("page_id", "nth", "href", "text", F.expr(absolute).alias("absolute"))


# Words of a report's link, and of links to other things.
REPORT_WORDS = "sustainability report|esg report|integrated report|environmental report|corporate responsibility|annual sustainability|sustainability disclosure|progress report|responsible business|brsr|climate report|net zero|esg-report|sustainability-report"
OTHER_WORDS = "press-release|press_release|pressrelease|code-of-conduct|code_of_conduct|policy|terms-of-service|terms_of_service|vendor|supplier-code|proxy|shareholder|whitepaper|brochure|catalogue|catalog|recruitment|careers"


def report_links(found: DataFrame, this_year: int) -> DataFrame:
    """Links to reports as PDF, with the year from the address, else the text, else the current one."""
    both = F.lower(F.concat_ws(" ", "absolute", "text"))
    kept = found.where(F.lower("absolute").endswith(".pdf") & both.rlike(REPORT_WORDS) & ~both.rlike(OTHER_WORDS))
    year = "coalesce(nullif(regexp_extract(absolute, '20(1[5-9]|2[0-9])', 0), ''), nullif(regexp_extract(text, '20(1[5-9]|2[0-9])', 0), ''))"
    return kept.withColumn("year", F.coalesce(F.expr(year), F.lit(str(this_year))))


def file_metadata(files: DataFrame) -> DataFrame:
    """Company, year and report id from the name of a file (stem): a fiscal year counts as its second one. Only the year
    that was read leaves the name, other numbers belong to the company."""
    two, one = r"regexp_extract(stem, '(\\d{4})-(\\d{2})', 1)", r"regexp_extract(stem, '20\\d{2}', 0)"
    year = f"CASE WHEN {two} <> '' THEN CAST({two} AS INT) + 1 WHEN {one} <> '' THEN CAST({one} AS INT) ELSE 2024 END"
    name = rf"CASE WHEN {two} <> '' THEN regexp_replace(stem, '(?s)^(.*?)[-_]?\\d{{4}}-\\d{{2}}', '$1 ') WHEN {one} <> '' THEN regexp_replace(stem, '(?s)^(.*?)[-_]?20\\d{{2}}[-_]?\\d{{0,2}}', '$1 ') ELSE regexp_replace(stem, '[-_]?\\d{{4}}[-_]?\\d{{0,2}}', ' ') END"
    for word in ("esg", "sustainability", "environmental", "report", "brsr", "business", "responsibility", "and", "of"):
        name = rf"regexp_replace({name}, '(?i)[-_\\s]{word}', ' ')"
    words = rf"filter(split(trim(regexp_replace({name}, '[-_]+', ' ')), '\\s+'), w -> length(w) > 1)"
    company = f"array_join(transform({words}, w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ')"
    out = files.withColumns({"report_year": F.expr(year), "company_name": F.expr(company)})
    out = out.withColumn("company_name", F.expr("CASE WHEN company_name = '' THEN initcap(replace(left(stem, 20), '-', ' ')) ELSE company_name END"))
    out = out.withColumn("company_id", F.expr("trim(BOTH '_' FROM regexp_replace(lower(company_name), '[^a-z0-9]+', '_'))"))
    return out.withColumn("report_id", F.concat_ws("_", "company_id", F.col("report_year").cast("string")))
