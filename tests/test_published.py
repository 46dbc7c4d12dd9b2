from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.sources.published import Store
from claimweave.streaming import reports as R

SCHEMA = StructType().add("report_id", "string").add("n", "integer")


def rows(store):
    return sorted(map(tuple, store.read().collect()))


def test_replace_by_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", SCHEMA, "report_id", 4)
    assert rows(store) == [] and store.replace(spark.createDataFrame([], SCHEMA)) == 0
    store.replace(spark.createDataFrame([(f"r{i}", i) for i in range(20)] + [("r1", 100)], SCHEMA))
    store.replace(spark.createDataFrame([("r1", -1), ("new", 7)], SCHEMA), keys=spark.createDataFrame([("r2",), ("none",)], "report_id string"))
    want = sorted([(f"r{i}", i) for i in range(20) if i not in (1, 2)] + [("r1", -1), ("new", 7)])
    assert rows(store) == want
    store.replace(spark.createDataFrame([("r1", -1), ("new", 7)], SCHEMA))
    assert rows(store) == want
    store.replace(spark.createDataFrame([], SCHEMA), keys=spark.createDataFrame([(k,) for k, _ in want], "report_id string"))
    assert rows(store) == []
    with pytest.raises(ValueError):
        store.replace(spark.createDataFrame([(None, 1)], SCHEMA))


def test_a_failing_write_leaves_the_table(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/t", SCHEMA, "report_id", 2)
    first = [(f"r{i}", i) for i in range(6)]
    store.replace(spark.createDataFrame(first, SCHEMA))
    fails = F.udf(lambda n: 1 // (n - 3), "int")
    with pytest.raises(Exception):
        store.replace(spark.createDataFrame([(f"r{i}", i) for i in range(6)], SCHEMA).withColumn("n", fails("n")))
    assert rows(store) == first
    real = Store._publish
    monkeypatch.setattr(Store, "_publish", lambda self, stage, touched, before, sent: real(self, stage, touched, before, sent + 1))
    with pytest.raises(OSError, match="staged"):
        store.replace(spark.createDataFrame([("r1", -5)], SCHEMA))
    assert rows(store) == first


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """A writer whose bucket was replaced since it read it fails, and the other's rows stay whole."""
    store = Store(spark, f"file://{tmp_path}/t", SCHEMA, "report_id", 1)
    store.replace(spark.createDataFrame([("a", 1)], SCHEMA))
    real = Store._publish
    calls = []

    def late(self, *args):
        if not calls:
            calls.append(1)
            store.replace(spark.createDataFrame([("b", 2)], SCHEMA))
        return real(self, *args)

    monkeypatch.setattr(Store, "_publish", late)
    with pytest.raises(Exception, match="(?i)exist"):
        store.replace(spark.createDataFrame([("a", 9)], SCHEMA))
    assert rows(store) == [("a", 1), ("b", 2)]


def claim(i, value=5.0):
    base = {"aspect": "a", "normalized_aspect": "water.consumption", "claim_type": "performance", "source_type": "text", "source_sentence": "x", "metric_unit": "kilolitres", "time_bucket": "2023", "location_scope": "global"}
    return base | {"claim_id": i, "metric_value": value}


def put(folder, name, *units):
    lines = [json.dumps({"report_id": r, "unit": u, "units": n, "claims": c}) for r, u, n, c in units]
    (folder / name).write_text("\n".join(lines) + '\n{"report_id": "r", "unit": "to')


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(spark, tmp_path, files=1, wait=10**9):
    store, jobs = R.store_of(spark, f"file://{tmp_path}/claims", 4), Store(spark, f"file://{tmp_path}/jobs", StructType().add("report_id", "string").add("status", "string").add("done", "integer"), "report_id", 2)
    stream = R.collected(R.arriving_units(spark, str(tmp_path / "in"), files), wait)
    assert R.ingest_reports(stream, store, f"file://{tmp_path}/mark", jobs).awaitTermination(240)
    return sorted((r.report_id, r.claim_id, r.metric_value, r.canonical_unit) for r in store.read().collect()), rows(jobs)


def test_a_report_in_two_files_is_stored_whole(spark, tmp_path, rocks):
    """Two files and two micro-batches, a restart in between, a unit twice, a report again, and one without claims."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", ("r", "sec::0", 2, [claim(1), claim(2), claim(3)]), ("s", "tbl::1", 1, [claim(9)]), ("r", "sec::0", 2, [claim(1), claim(2), claim(3)]))
    got, jobs = run(spark, tmp_path)
    assert [g[:2] for g in got] == [("s", 9)] and jobs == [("s", "complete", 1)]
    put(inbox, "b.json", ("r", "tbl::4", 2, [claim(4), claim(5), claim(6), {"no": "claim"}]))
    put(inbox, "c.json", ("s", "tbl::1", 1, []), ("", "u", 2, [claim(7)]))
    got, jobs = run(spark, tmp_path)
    assert [g[:2] for g in got] == [*(("r", i) for i in range(1, 7)), ("s", 9)] and {g[3] for g in got} == {"m3"}
    assert jobs == [("r", "complete", 2), ("s", "complete", 1)]
    assert run(spark, tmp_path)[0] == got
    put(inbox, "d.json", ("r", "sec::0", 1, [claim(8, 1.0)]))
    assert [g[:3] for g in run(spark, tmp_path)[0]] == [("r", 8, 1.0), ("s", 9, 5.0)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    store = R.store_of(spark, f"file://{tmp_path}/claims", 2)
    batch = spark.createDataFrame([("r", "complete", 1, json.dumps(claim(i))) for i in range(4)] + [("t", "given up", 1, None)], R.COLLECTED)
    store.replace(R.claims_of(batch))
    once = sorted(map(tuple, store.read().collect()))
    store.replace(R.claims_of(batch))
    assert sorted(map(tuple, store.read().collect())) == once and len(once) == 4


def test_a_report_that_stays_incomplete_is_given_up(spark, tmp_path, rocks):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", ("r", "sec::0", 2, [claim(1)]))
    assert run(spark, tmp_path, wait=1) == ([], [])
    put(inbox, "b.json", ("s", "sec::0", 1, [claim(2)]))
    got, jobs = run(spark, tmp_path, wait=1)
    assert [g[:2] for g in got] == [("s", 2)] and ("r", "given up", 1) in jobs
