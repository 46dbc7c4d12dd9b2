"""URL filtering: fixed host rules first, association rules mined from labelled URLs for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small

#: (host, path, verdict). A rule fits its host and every subdomain where the path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A mined rule needs this share of the labelled URLs, and so many of them, to hold its tokens and its label, this
#: share of the URLs with its tokens to have the label, and this much more than of all URLs.
SUPPORT, LEAST_URLS, CONFIDENCE, LIFT = 0.002, 20, 0.6, 1.5
#: Tokens of more than this share of the labelled URLs say nothing and only multiply the frequent sets.
CONSTANT = 0.9
_LABEL = "\nlabel="


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for
    a null url or one without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where the host is not defined."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fixed rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host, its labels by place from the right, path segments and
    their number, file ending, query keys, fragment. Digits become 0, so numbered pages look alike."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(plain(path), "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))), F.concat(F.lit("host="), host)),
        F.transform(labels, lambda x, i: F.concat(F.lit("label"), F.least(i, F.lit(4)).cast("string"), F.lit("="), plain(x))),
        F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        F.array(F.concat(F.lit("depth="), F.least(F.size(segments), F.lit(8)).cast("string"))),
        F.transform(keys, lambda k: F.concat(F.lit("key="), k)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        F.when(path.rlike(r"\.[A-Za-z]{1,5}$"), F.array(F.concat(F.lit("ending="), F.lower(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


@dataclass
class RuleIndex:
    """Mined rules by their rarest token: (token, need, verdict, confidence), ``need`` being all of its tokens."""

    rules: DataFrame
    count: int


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST_URLS) -> RuleIndex:
    """Rules tokens -> block and tokens -> allow from ``labelled`` (tokens, blocked), all rows of it, by FP-growth.

    Of the frequent token sets with a label, those of enough confidence and lift stay, and of those only the
    ones that no subset with as much confidence for the same label covers. Rows whose label is null are
    passed over; without a blocked row there are no rules.
    """
    rows = labelled.where("blocked IS NOT NULL AND size(tokens) > 0")
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("int")).alias("k")).first()
    spark = labelled.sparkSession
    if not sums["k"]:
        return RuleIndex(spark.createDataFrame([], "token string, need array<string>, verdict string, confidence double"), 0)
    often = cut(rows.select(F.explode("tokens").alias("token")).groupBy("token").count())
    constant = [r["token"] for r in often.where(F.col("count") > CONSTANT * sums["n"]).select("token").collect()]  # each row has few tokens, so few are so common
    telling = F.array_except("tokens", F.array(*map(F.lit, constant)).cast("array<string>"))
    label = F.concat(F.lit(_LABEL), F.when(F.col("blocked"), "block").otherwise("allow"))
    baskets = rows.select(F.concat(telling, F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, min(1.0, least / sums["n"])), minConfidence=confidence).fit(baskets)
    mined = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL) & (F.col("lift") >= lift))
    mined = cut(mined.select(F.array_sort("antecedent").alias("need"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence"))
    wide = mined.select(F.col("need").alias("wide"), "verdict", F.col("confidence").alias("c"), F.explode("need").alias("t"))
    slim = mined.select("need", "verdict", "confidence", F.explode("need").alias("t"))
    covered = (
        wide.join(slim, ["t", "verdict"]).where("size(need) < size(wide) AND confidence >= c AND size(array_except(need, wide)) = 0").select(F.col("wide").alias("need"), "verdict").distinct()
    )
    useful = mined.join(covered, ["need", "verdict"], "left_anti")
    ranked = useful.select("need", "verdict", "confidence", F.explode("need").alias("token")).join(often, "token")
    index = cut(ranked.groupBy("need", "verdict", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token")).select("token", "need", "verdict", "confidence"))
    return RuleIndex(index, index.count())


def judge(pages: DataFrame, index: RuleIndex, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` with ``__host``, ``__path``, ``__rule`` (of the fixed ones, else null), ``__score`` and
    ``__verdict`` (allow or block).

    The longest fixed rule decides. Where none fits, the mined rule of highest confidence does (block among equals)
    whose tokens are all among the url's: its distinct tokens are looked up in the index by rarest token and
    only the rules found there are compared. ``__score`` is that confidence, 0 without a rule. Without any
    rule a url is allowed; null, empty and malformed urls have no tokens. Rows stay, repeated ones included; other
    columns pass through.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.withColumns({"__host": host, "__path": path}).withColumn("__fixed", rule_of(F.col("__host"), F.col("__path")))
    distinct = parsed.where("__fixed IS NULL AND __host <> ''").select(F.col(url).alias("__u"), "__host", "__path").distinct()
    mine_of = distinct.select("__u", tokens_of(F.col("__u"), F.col("__host"), F.col("__path")).alias("tokens"))
    hits = mine_of.select("__u", "tokens", F.explode("tokens").alias("token")).join(small(index.rules, index.count), "token")
    best = hits.where("size(array_except(need, tokens)) = 0").groupBy("__u").agg(F.max(F.struct("confidence", "verdict")).alias("__best"))
    joined = parsed.join(best, F.col(url) == F.col("__u"), "left").drop("__u")
    return joined.select(
        *pages.columns,
        "__host",
        "__path",
        F.col("__fixed.rule").alias("__rule"),
        F.coalesce("__best.confidence", F.lit(0.0)).alias("__score"),
        F.coalesce("__fixed.verdict", "__best.verdict", F.lit("allow")).alias("__verdict"),
    )
