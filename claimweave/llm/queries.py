"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.ann import nearest
from claimweave.llm.bpe import round_trip
from claimweave.llm.common import read
from claimweave.llm.exact_topk import exact_topk
from claimweave.llm.langid import held_out, identify, labelled_sample
from claimweave.llm.lexical import build_index, search
from claimweave.llm.lines import dedup_lines
from claimweave.llm.mixing import label_domain, mix, train
from claimweave.llm.packing import pack
from claimweave.llm.phrases import collocations
from claimweave.llm.secrets import example_findings, scan
from claimweave.llm.secrets import train as forest_of
from claimweave.llm.sharding import shuffle_to_shards
from claimweave.llm.simhash import near_duplicates
from claimweave.llm.urls import host_of, judge, mine, path_of, tokens_of


SHARDS = 16


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart, in uniform random order."""
    found = shuffle_to_shards(read(spark, sf_dir, "documents"), SHARDS)
    return found.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules, else by rules mined from the labels of its document:
    a page is a bad example if its document is toxic or of low quality."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), label_domain().alias("domain"))
    url = F.col("url")
    labelled = pages.join(labels, "page_id").select(tokens_of(url, host_of(url), path_of(url)).alias("tokens"), (F.col("domain") != "high").alias("blocked"))
    return judge(pages, mine(labelled)).select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__score").alias("score")
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 largest inner products for each vector whose id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every suspicious word of every document, and whether the forest takes it for a secret."""
    found = scan(read(spark, sf_dir, "documents"), forest_of(example_findings(spark)))
    return found.select(F.col("id").alias("doc_id"), "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word-shingle SimHash of every document, linked at 2 or fewer differing bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_diff=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


#: Domain shares of the mix, and the domains in the order of their probabilities.
MIX_WEIGHTS = {"high": 0.8, "low": 0.15, "toxic": 0.05}


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain probabilities, expected copies and drawn copies of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", label_domain().alias("domain"))
    found = mix(docs, train(docs, labels, list(MIX_WEIGHTS)), MIX_WEIGHTS)
    return found.select(
        "doc_id",
        F.col("__n_tokens").alias("n_tokens"),
        *(F.col(f"__p_{d}").alias(f"p_{d}") for d in MIX_WEIGHTS),
        F.col("__rate").alias("rate"),
        F.col("__copies").alias("copies"),
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products for each vector whose id is divisible by 100."""
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that go as fuzzy repeats, and a digest of the text that stays."""
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("__dropped").alias("dropped_lines"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from three of four parts of the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), labelled_sample(docs))
    return found.select("doc_id", held_out().alias("held_out"), "__lang.lang_pred", "__lang.score")


def vocabulary(variable: str = "WORD_BPE_FILE", name: str = "word_bpe_49k.json") -> str:
    """Place of a tokenizer file, from the environment or the package of public tokenizers."""
    if found := os.environ.get(variable):
        return found
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to, as counts and digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = round_trip(docs, vocabulary())
    return found.select(
        "doc_id",
        F.size("__bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("__bpe.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("__bpe.decoded", 256).alias("decoded_sha256"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of up to 1,024 tokens."""
    found = pack(read(spark, sf_dir, "documents"), vocabulary("BYTE_BPE_FILE", "byte_bpe_50k.json"), ["doc_id"])
    return found.select(
        "doc_id",
        F.col("__piece").alias("piece"),
        F.col("__start").alias("start"),
        (F.octet_length("__ids") / 4).cast("long").alias("length"),
        F.crc32("__ids").alias("ids_crc32"),
        F.col("__sequence").alias("sequence_id"),
        F.col("__offset").alias("offset"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of two or three words in each language whose weakest cut scores highest."""
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES = {"op1_shards": op1_shards, "op2_urls": op2_urls, "op3_ann": op3_ann, "op4_secrets": op4_secrets, "op5_simhash": op5_simhash, "op6_bpe": op6_bpe, "op7_mix": op7_mix, "op8_exact_topk": op8_exact_topk, "op9_line_dedup": op9_line_dedup, "op10_language_id": op10_language_id, "op11_packing": op11_packing, "op12_phrases": op12_phrases, "op13_lexical": op13_lexical}
ORACLES: dict[str, str] = {
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT d, lang, unnest(regexp_extract_all(text, '[^.,;:!?\n\x0b\f\r]+')) AS piece FROM d),
        q AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
        w AS (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
        g AS (SELECT lang, w AS w1, lead(w) OVER (PARTITION BY p ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY p ORDER BY i) AS w3 FROM w),
        f1 AS MATERIALIZED (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
        f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
        inside AS (
            SELECT lang, w1, w2, max(f) AS longer
            FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
            FROM f2 AS c JOIN f1 AS x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 AS y ON y.lang = c.lang AND y.w1 = c.w2
            LEFT JOIN inside AS i ON i.lang = c.lang AND i.w1 = c.w1 AND i.w2 = c.w2
            WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.f
            UNION ALL
            SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
            FROM f3 AS c JOIN f1 AS x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 AS y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
            UNION ALL
            SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
            FROM f3 AS c JOIN f2 AS x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 AS y ON y.lang = c.lang AND y.w1 = c.w3),
        scored AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_lexical": r"""
        WITH t AS (
            SELECT row_number() OVER () AS d, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        docs AS MATERIALIZED (SELECT d, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
        p AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY ALL),
        s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
        weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, nn),
        items AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        q AS (
            SELECT i, item_id,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM items),
        u AS (SELECT i, item_id, term, count(*) AS times FROM q GROUP BY ALL),
        scored AS (
            SELECT i, item_id, d, doc_id,
                sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
            FROM u JOIN weight USING (term) JOIN p USING (term) JOIN docs USING (d), s GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
