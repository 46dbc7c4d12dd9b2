"""Every registered query of the corpus operators on the smallest tables: columns, types, and values that can be told plainly."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from claimweave.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
TYPES = {
    "op1_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_urls": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_secrets": "doc_id bigint",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_mix": "doc_id bigint",
    "op8_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_line_dedup": "doc_id bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op12_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_lexical": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def rows(spark):
    found = {}

    def of(name):
        if name not in found:
            df = QUERIES[name](spark, DATA)
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_types(rows, docs, name):
    types, got = rows(name)
    assert set(QUERIES) == set(TYPES)
    for column in TYPES[name].split(", "):
        c, t = column.split(" ")
        assert types[c] == t, (c, types.get(c))
    assert got
    if name in ("op1_shards", "op5_simhash", "op6_bpe", "op7_mix", "op9_line_dedup", "op10_language_id"):
        assert sorted(r.doc_id for r in got) == sorted(docs)


def test_values(spark, rows, docs):
    for r in rows("op1_shards")[1]:
        data = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and 0 <= r.shard < 16
    for r in rows("op10_language_id")[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    for r in rows("op6_bpe")[1]:
        ids = tokenizer.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    fixed = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in rows("op2_urls")[1]:
        rest = (urls[r.page_id] or "").partition("://")[2]
        stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        assert r.host == "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
        tail = rest[stop:] if rest[stop : stop + 1] == "/" else ""
        assert r.path == tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fitting = [k for k in fixed if (r.host == (h := k.split("/")[0]) or r.host.endswith("." + h)) and r.path.startswith(k[len(h) :])]
        assert r.rule == max(fitting, key=len, default=None) and (r.rule is None or r.verdict == fixed[r.rule]) and r.verdict in ("allow", "block")
    for name, k in (("op3_ann", 20), ("op8_exact_topk", 10)):
        of = {}
        for r in rows(name)[1]:
            of.setdefault(r.query_id, []).append(r)
        for found in of.values():
            found.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= k
            assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
