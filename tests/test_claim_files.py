from __future__ import annotations

import json
import random

import pytest

from claimweave.sources.claim_files import register


@pytest.fixture(autouse=True)
def known(spark):
    register(spark)


def read(spark, folder, **options):
    rows = spark.read.format("claims").options(**options).load(str(folder)).collect()
    assert len({(r.file, r.offset, r.nth) for r in rows}) == len(rows)
    return sorted(json.loads(r.claim)["id"] for r in rows if r.claim), sorted(r.torn for r in rows if r.torn is not None)


def test_documents_lines_and_torn_ones(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2, "text": "é\n"}]))
    (tmp_path / "b.json").write_text(json.dumps({"claims": [{"id": 3}], "other": 1}, indent=1))
    (tmp_path / "deep" / "c.jsonl").write_text('{"id": 4}\n\n{"claims": [{"id": 5}, {"id": 6}]}\r\n{"id": 7}\n{"id": 8')
    (tmp_path / "bad.json").write_text('[{"id": 9}')
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "_hidden.jsonl").write_text('{"id": 99}')
    (tmp_path / "odd.jsonl").write_text('3\n[1]\n{"id": 10}')
    assert read(spark, tmp_path) == ([1, 2, 3, 4, 5, 6, 7, 10], sorted(['{"id": 8', '[{"id": 9}', "3\n", "[1]\n"]))
    assert read(spark, f"file://{tmp_path}/deep/c.jsonl")[0] == [4, 5, 6, 7]
    assert spark.read.format("claims").load(str(tmp_path)).where("torn IS NOT NULL").count() == 4


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_ranges_read_each_line_once(spark, tmp_path, split):
    rng = random.Random(split)
    ids = list(range(60 if split < 10 else 400))
    (tmp_path / "a.jsonl").write_bytes(b"".join(json.dumps({"id": i, "t": "é" * rng.randint(0, 40)}, ensure_ascii=False).encode() + b"\n" for i in ids))
    frame = spark.read.format("claims").option("splitBytes", split).load(str(tmp_path))
    assert read(spark, tmp_path, splitBytes=split) == (ids, [])
    assert split > 5000 or frame.rdd.getNumPartitions() > 10


def test_stream_waits_for_whole_lines(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()

    def run():
        stream = spark.readStream.format("claims").option("splitBytes", 16).load(str(inbox))
        assert stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination(120)
        return sorted(json.loads(r.claim)["id"] for r in spark.read.parquet(out).collect())

    (inbox / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id"')
    (inbox / "d.json").write_text('{"claims": [{"id": 10}')
    assert run() == [1, 2]
    with (inbox / "a.jsonl").open("a") as f:
        f.write(': 3}\n{"id": 4}\n')
    (inbox / "b.jsonl").write_text('{"id": 5}\n')
    (inbox / "d.json").write_text('{"claims": [{"id": 10}]}')
    assert run() == [1, 2, 3, 4, 5, 10]
    assert run() == [1, 2, 3, 4, 5, 10]
