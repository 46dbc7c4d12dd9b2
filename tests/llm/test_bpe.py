from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimweave.llm.bpe import Bpe, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_padding()
    found.no_truncation()
    return found


def same(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.encode(text)
    assert got.tolist() == want, text
    assert bpe.decode(got) == library.decode(want, skip_special_tokens=False)


HARD = [
    "", " ", "Hello, WORLD!!", "don't we'll I'VE", "a  b\t\n c d", "ΑΣ ΣΑΣ", "İstanbul ǅ ß ẞ", "é 가", "日本語テキスト 🙂🙃",
    "<|endoftext|>a<|startoftext|> B <|endoftext|", "x" * 300, "%%% ### $$$&&&***", "12345 ½ Ⅷ ٣", "\x00\x1c\x1f\x85 z", "'s'S 'LL", "aaaaaaaabaaaaaab " * 20,
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(bpe, library, text):
    same(bpe, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeinorstuü'éñ .,<|>"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=80))
def test_random_texts(bpe, library, text):
    same(bpe, library, text)


def test_every_token_in_every_setting(bpe, library):
    rng = random.Random(3)
    tokens = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii()]
    for _ in range(4000):
        same(bpe, library, "".join(rng.choices(tokens, k=rng.randint(1, 4))))


def test_whole_documents_in_spark(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = decode(encode(docs, PATH), PATH).select("text", "__ids", "__decoded").collect()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["__ids"] == ids and r["__decoded"] == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "ab " * 60000, 7)], "doc_id long, text string, ids long")
    got = decode(encode(docs, PATH), PATH).selectExpr("size(__ids) n", "length(__decoded) m").collect()
    assert [r.n for r in got][:3] == [0, 0, 0] and got[3].n == 60000 and [r.m for r in got][:3] == [0, 0, 0]
    assert encode(docs.where("doc_id > 5"), PATH).count() == 0
