"""Secret scanning: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import cut

TREES, DEPTH = 40, 8
#: Labelled findings that a forest is trained on at most, by hash of their content.
TRAIN_ROWS = 50_000
#: A word is a candidate if it has a run like this, or assigns something to a name like one of KEYS.
RUN = "(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{10,}"
KEYS = "pass|pwd|secret|token|key|auth|credential|bearer|private"
#: What ends a piece of a word, what may stand before one, and a piece after the names that it is assigned to.
_STOPS, _OPEN = r"""\s"'`,;<>()\[\]{}|#$%&*!?""", r"""["'(\[{<`]*"""
PIECE = rf"""{_OPEN}(?:([A-Za-z][A-Za-z0-9_.-]{{1,40}})["']?[=:]+{_OPEN}){{0,4}}([^{_STOPS}]+)"""
#: A value with any signs, assigned to a name like one of KEYS: up to the next assignment or the closing signs.
ASSIGNED = rf"""(?i)([A-Za-z0-9_.-]{{0,40}}(?:{KEYS})[A-Za-z0-9_.-]{{0,40}})["']?[=:]+["'`]?([^\s"'`]\S*?)(?=["'`]?[)\]}}>,;.:"'`]*$|["'`]?[,;&}}\]]["'`{{}}\[\],]*[A-Za-z][A-Za-z0-9_.-]*["']?[=:])"""
#: The password in the address of a service.
LOGIN = "://[^/@:]*:([^/@]+)@"
#: Shortest assigned value.
SHORT = 6
#: Words around a finding that speak against a secret, and parts of a path that do.
PLAIN_WORDS = "sha|md5|commit|checksum|digest|hash|revision|uuid|guid|isbn|phone|tel|call|card|order|invoice|version|page|figure|http|example|sample|dummy|placeholder"
PLAIN_PATHS = "test|example|sample|fixture|mock|doc|readme|tutorial"
#: Dictionary for the share of a candidate that is made of words.
WORDS = (
    "password passwd secret token example sample default change your here admin user login test demo key value name file page image index section chapter figure "
    "table version release build report number order invoice product release update config server client local public private master main project package module "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "the and for with from this that have will time year people about other which their there first would these"
).split()
FEATURES = [
    "size", "digits", "uppers", "lowers", "signs", "distinct", "letter_digit", "digit_letter", "case_change", "same_class", "runs", "hex_only",
    "words", "vowels", "assigned", "quoted", "key_word", "plain_word", "plain_path", "prefix",
]


def findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source", after_key: bool = False) -> DataFrame:
    """(id, path, nth, before2, before, word, after): every candidate word of the whole texts with its
    place among the text's words (from 0) and its neighbours. With ``after_key`` also words of SHORT
    characters or more whose name and sign of assignment are the words before."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(path).cast("string").alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), r"\s+").alias("words"))
    test = f"length(w) >= 10 AND (w RLIKE '{RUN}' OR w RLIKE '(?i)({KEYS})[^=:]{{0,12}}[=:].{{6,}}')"
    if after_key:
        last, name = "coalesce(get(words, i - 1), '')", f"(?i)({KEYS})[^=:]{{0,12}}"
        test += f""" OR (length(w) >= {SHORT} AND ({last} RLIKE '{name}[=:]+$' OR ({last} RLIKE '^[=:]+$' AND coalesce(get(words, i - 2), '') RLIKE '{name}$')))"""
    found = f"""filter(transform(words, (w, i) -> CASE WHEN {test} THEN named_struct('nth', i, 'word', w,
        'before2', CASE WHEN i > 1 THEN words[i - 2] END, 'before', CASE WHEN i > 0 THEN words[i - 1] END, 'after', get(words, i + 1)) END), s -> s IS NOT NULL)"""
    return rows.select("id", "path", F.explode(F.expr(found)).alias("s")).select("id", "path", "s.nth", "s.before2", "s.before", "s.word", "s.after")


def candidates(found: DataFrame) -> DataFrame:
    """``found`` (see ``findings``) with one row for each ``candidate`` of a word and its ``name``: pieces that have
    a run of RUN, values of SHORT characters or more that are assigned to a name like one of KEYS (as cut
    at signs, and with them), passwords in addresses. Equal candidates of a word are one."""
    word = F.col("word")

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(F.regexp_extract_all(word, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(word, F.lit(pattern), F.lit(2)).alias("value"))

    def struct(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.alias("value"))

    pieces = F.transform(pairs(PIECE), lambda p: struct(p["name"], F.regexp_replace(p["value"], "[.:]+$", "")))
    names = F.transform(pieces, lambda p: struct(F.lit(""), p["name"]))
    whole = F.transform(pairs(ASSIGNED), lambda p: struct(p["name"], p["value"]))
    logins = F.transform(F.regexp_extract_all(word, F.lit(LOGIN), F.lit(1)), lambda x: struct(F.lit("password"), x))
    keyed = F.coalesce(F.col("before").rlike(f"(?i)({KEYS})[^=:]{{0,12}}[=:]+$") | (F.col("before").rlike("^[=:]+$") & F.col("before2").rlike(f"(?i)({KEYS})")), F.lit(False))
    taken = F.filter(
        F.concat(whole, logins, pieces, names),
        lambda p: ((F.length(p["value"]) >= 10) & p["value"].rlike(RUN)) | ((F.length(p["value"]) >= SHORT) & (p["name"].rlike(f"(?i)({KEYS})") | (keyed & (p["name"] == "")))),
    )
    # a value that follows its name by words may hold any signs
    bare = F.regexp_replace(F.regexp_replace(word, f"^{_OPEN}", ""), r"""["'`)\]}>,;.:]+$""", "")
    taken = F.concat(taken, F.when(keyed & (F.length(bare) >= SHORT), F.array(struct(F.lit(""), bare))).otherwise(F.array().cast("array<struct<name:string,value:string>>")))
    taken = F.array_sort(F.transform(taken, lambda p: F.struct(p["value"].alias("value"), p["name"].alias("name"))))
    first = F.expr("filter(__taken, (p, i) -> i + 1 = size(__taken) OR p.value <> get(__taken, i + 1).value)")
    rows = found.withColumn("__taken", taken).withColumn("__p", F.explode(first))
    return rows.withColumns({"name": F.col("__p.name"), "candidate": F.col("__p.value")}).drop("__taken", "__p")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with ``candidate``, the suspected value in the word, and the columns of FEATURES: its
    length, character classes and transitions between them, dictionary coverage, path and neighbours. Names and
    candidates that are there already (see ``candidates``) stay."""
    word = F.col("word")
    name = F.regexp_extract(word, r"""^["'(\[{]*([A-Za-z][A-Za-z0-9_.-]{1,40})["']?[=:]+""", 1)
    value = F.when(name != "", F.regexp_replace(word, r"""^["'(\[{]*[A-Za-z][A-Za-z0-9_.-]{1,40}["']?[=:]+""", "")).otherwise(word)
    value = F.regexp_replace(F.regexp_extract(value, r"""^["'(\[{<`]*([^"'`,;<>()\[\]{}|#$%&*!?]*)""", 1), "[.:]+$", "")
    if "candidate" in found.columns:
        name, value = F.col("name"), F.col("candidate")
    base = found.withColumns({"__name": F.lower(name), "candidate": value})
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    near = F.lower(F.concat_ws(" ", F.col("before2"), F.col("before"), F.col("__name")))
    around = F.lower(F.concat_ws(" ", F.col("before2"), F.col("before"), F.col("__name"), F.col("after")))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    left = F.regexp_replace(F.lower(c), "|".join(sorted(WORDS, key=len, reverse=True)), "")
    columns = {
        "size": F.least(F.length(c), F.lit(256)).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "same_class": share("[0-9](?=[0-9])|[a-z](?=[a-z])|[A-Z](?=[A-Z])"),
        "runs": share(r"(.)(?=\1)"),
        "hex_only": flag(c.rlike("^[0-9a-f]{8,}$") & c.rlike("[a-f]")),
        "words": 1 - F.length(left) / n,
        "vowels": share("(?i)[aeiou]"),
        "assigned": flag((F.col("__name") != "") | F.col("before").rlike("[=:]$")),
        "quoted": flag(word.rlike("[\"']")),
        "key_word": flag(near.rlike(KEYS)),
        "plain_word": flag(around.rlike(PLAIN_WORDS)),
        "plain_path": flag(F.lower("path").rlike(PLAIN_PATHS)),
        "prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[bpas]-|sk_live_|sk-|AIza|eyJ)")),
    }
    return base.withColumns({k: v.cast("double") for k, v in columns.items()}).drop("__name")


def example_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings for want of a table of them: values of known secret and harmless formats, made
    from hashes of row numbers, with neighbours to match. (path, before2, before, word, after, secret)"""
    n = spark.range(rows).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("g", F.sha2(F.concat(F.lit("g"), F.col("id").cast("string")), 256))
    pick = lambda seed, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(of))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    upper = F.translate(F.upper(F.substring("h", 1, 32)), "0189ABCDEF", "GHJKLMNPQR")
    mixed = F.substring(F.concat(F.translate(F.upper(F.substring("g", 1, 20)), "019", "XZW"), F.substring("h", 1, 20)), 3, 16)
    number = F.translate(F.substring("h", 1, 24), "abcdef", "012345")
    filler = pick(1, "the", "of", "and", "was", "report", "in", "value", "for", "is", "see")
    key = pick(2, "password", "token", "secret", "api_key", "access_token", "passwd", "auth_token", "client_secret", "private_key")
    plain_key = pick(3, "commit", "sha256", "checksum", "revision", "md5", "digest", "uuid", "etag", "hash")
    word = pick(4, "example", "release", "section", "product", "version", "chapter", "invoice", "project", "figure", "order")
    other = pick(5, "update", "table", "index", "report", "package", "image", "config", "server", "page", "module")
    q = F.lit('"')
    kinds = [
        (True, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), filler, filler),
        (True, F.concat(key, F.lit("="), F.substring("h", 1, 18)), filler, filler),
        (True, F.concat(q, F.substring("h", 1, 40), q), key, F.lit("=")),
        (True, F.concat(key, pick(6, "=", ":"), F.substring(b64, 1, 32)), filler, filler),
        (True, F.concat(q, b64, q), key, pick(7, "=", ":")),
        (True, F.concat(pick(8, "ghp_", "sk_live_", "xoxb-", "glpat-"), F.substring(b64, 1, 36)), filler, filler),
        (True, F.concat(key, F.lit("="), mixed), filler, filler),
        (False, number, filler, pick(9, "card", "phone", "number", "is", "call", "at")),
        (False, F.substring(number, 1, 12), filler, filler),
        (False, F.substring("h", 1, 40), filler, plain_key),
        (False, F.concat(plain_key, F.lit(":"), F.col("h")), filler, filler),
        (False, F.concat_ws("-", word, other, F.substring(number, 1, 4)), filler, filler),
        (False, F.concat(word, F.lit("_"), other, F.substring(number, 1, 3)), filler, filler),
        (False, F.concat(key, F.lit("="), pick(10, "changeme123", "your_password_1", "xxxxxxxx1234", "example12345", "test1234567", "00000000000")), filler, filler),
        (False, F.concat(F.lit("https://www."), word, F.lit(".com/"), other, F.lit("/"), F.substring(number, 1, 6)), filler, filler),
        (False, F.concat(F.substring("h", 1, 8), F.lit("-"), F.substring("h", 9, 4), F.lit("-4"), F.substring("h", 13, 3), F.lit("-a"), F.substring("h", 16, 3), F.lit("-"), F.substring("h", 20, 12)), filler, plain_key),
        (False, F.concat(word, F.lit("."), other, F.substring(number, 1, 2), F.lit("@mail.example.com")), filler, filler),
        (False, F.concat(F.substring(number, 1, 4), F.lit("-0"), F.substring(number, 5, 1), F.lit("-1"), F.substring(number, 6, 1), F.lit("T1"), F.substring(number, 7, 1), F.lit(":30")), filler, filler),
    ]
    made = F.lit(None).cast("struct<secret:boolean,word:string,before2:string,before:string>")
    for i, (secret, text, before2, before) in enumerate(kinds):
        row = F.struct(F.lit(secret).alias("secret"), text.alias("word"), before2.alias("before2"), before.alias("before"))
        made = F.when(F.col("id") % len(kinds) == i, row).otherwise(made)
    path = pick(11, "src1", "src2", "config", "docs/readme", "tests/fixture", "src3")
    return n.select(path.alias("path"), made.alias("m"), filler.alias("after")).select("path", "m.before2", "m.before", "m.word", "after", "m.secret")


def train(labelled: DataFrame, seed: int = 3) -> PipelineModel:
    """A forest from labelled findings (path, before2, before, word, after, secret). Rows without a word
    or label are passed over; both labels must occur."""
    rows = labelled.where("word IS NOT NULL AND secret IS NOT NULL")
    n = rows.count()
    span = 1 << 20
    part = rows.where(F.pmod(F.xxhash64("path", "before", "word"), F.lit(span)) < int(span * min(1.0, TRAIN_ROWS / max(n, 1))) + 1)
    ready = with_features(cut(part)).withColumn("label", F.col("secret").cast("double"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(ready)


def scan(docs: DataFrame, forest: PipelineModel, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(id, path, nth, word, candidate, probability, secret) of every candidate in the whole texts, all of a word.

    ``secret`` is what the forest leaves after removing false positives: probability over one half. Null
    and empty texts have no candidates; repeated rows give repeated findings; a null id or path takes
    part; other columns are not read.
    """
    scored = forest.transform(with_features(candidates(findings(docs, id_col, text, path, after_key=True))))
    probability = vector_to_array("probability")[1]
    return scored.select("id", "path", "nth", "word", "candidate", probability.alias("probability"), (probability > 0.5).alias("secret"))
