from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from claimweave.llm import packing
from claimweave.llm.queries import op11_packing

FILE = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def ids_of(text: str | None) -> np.ndarray:
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check_places(rows, capacity: int) -> int:
    """Every sequence is filled from 0 without a gap; returns how many there are."""
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def plain_best_fit(sizes: list[int], capacity: int, limit: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, by looking at all open bins."""
    room: dict[int, int] = {}
    out, opened = [], 0
    for size in sizes:
        fitting = [(room[b], b) for b in room if room[b] >= size]
        if fitting:
            best = min(fitting)[0]
            b = [x for x in room if room[x] == best][-1]
        else:
            if len(room) == limit and size < capacity:
                fullest = min(room.values())
                del room[[x for x in room if room[x] == fullest][-1]]
            b, opened = opened, opened + 1
            room[b] = capacity
        out.append((b, capacity - room[b]))
        left = room.pop(b) - size
        if left:
            room[b] = left
    return out


def test_bins_equal_a_plain_search():
    rng = random.Random(5)
    for limit in (1, 2, 7, 300):
        sizes = [rng.choice([1, 3, rng.randint(1, 64), 64]) for _ in range(2000)]
        bins = packing.OpenBins(64, limit)
        assert [bins.place(s)[:2] for s in sizes] == plain_best_fit(sizes, 64, limit)
        assert bins.open <= limit


def test_only_the_first_piece_is_short():
    for n, want in ((1, [1]), (7, [7]), (8, [8]), (9, [1, 8]), (24, [8, 8, 8]), (25, [1, 8, 8, 8])):
        got = list(packing.pieces_of(np.arange(n), 8))
        assert [len(p) for _, p in got] == want
        assert np.concatenate([p for _, p in got]).tolist() == list(range(n)) and [s for s, _ in got] == [p[0] for _, p in got]


def test_ids_equal_the_library():
    bpe = packing.ByteBpe(open(FILE, encoding="utf-8").read())
    texts = [None, "", " ", "a  b\n\n c", "x<|endoftext|> y<|endoftext|>", "Straße İ 日本語 👩‍👩‍👧 ñ\x1c\x85 z", "don't  we'll 12345 --- \t\t x ", "word " * 80_000, "a" * 50_000, "\n" * 300_000, " " * 1_200_000 + "x"]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([32, 9, 10, rng.randrange(33, 127), rng.randrange(160, 0x3000), rng.randrange(0x10000, 0x1F700)])) for _ in range(400)) for _ in range(50)]
    for text in texts:
        assert [int(i) for b in bpe.encode(text) for i in b] == ids_of(text)[:-1].tolist()


@pytest.mark.parametrize("bins", [1, 3, 256])
def test_pieces_and_places(spark, monkeypatch, bins):
    """Null ids, null, empty and repeated rows, clashing names; few bins make several rounds."""
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(bins)
    rows = [(None, None, 1), (None, "", 1), (3, "same text", 1), (3, "same text", 1)]
    rows += [(i, " ".join(rng.choice(["alpha", "of", "Δ", "12"]) for _ in range(rng.choice([2, 9, 40, 150]))), 0) for i in range(10, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __piece int").repartition(6)
    found = packing.pack(df, FILE, ["doc_id"], capacity=64, open_bins=bins)
    got = found.select("doc_id", F.col("__piece").alias("piece"), F.col("__start").alias("start"), "__ids", (F.octet_length("__ids") / 4).cast("int").alias("length"), F.col("__sequence").alias("sequence"), F.col("__offset").alias("offset")).collect()
    check_places(got, 64)
    want = sorted((str(i), nth, start, p.tobytes()) for i, text, _ in rows for nth, (start, p) in enumerate(packing.pieces_of(ids_of(text), 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, bytes(r["__ids"])) for r in got) == want
    assert packing.pack(df.limit(0), FILE, ["doc_id"]).count() == 0


def test_query_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    found = op11_packing(spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = found.withColumnRenamed("sequence_id", "sequence").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = [(d.doc_id, nth, start, len(p), zlib.crc32(p.tobytes())) for d in docs for nth, (start, p) in enumerate(packing.pieces_of(ids_of(d.text), 1024))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_places(rows, 1024) <= -(-sum(w[3] for w in want) // 1024) * 1.05 + 1
