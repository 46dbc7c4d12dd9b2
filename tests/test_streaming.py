from __future__ import annotations

import json

from claimweave.streaming.claims import arriving, counts, ingest
from claimweave.streaming.reports import store_of


def put(folder, name, rows):
    base = {"aspect": "a", "normalized_aspect": "water.consumption", "claim_type": "performance", "source_type": "text", "source_sentence": "x", "metric_unit": "kilolitres", "time_bucket": "2023", "location_scope": "global"}
    (folder / name).write_text("\n".join(json.dumps(base | r) for r in rows) + "\n{torn")


def test_claims_of_a_report_come_in_many_batches(spark, tmp_path):
    """Two files of three claims of one report, a file at a time: all six are stored; one that comes again is replaced."""
    inbox, mark = tmp_path / "in", f"file://{tmp_path}/mark"
    inbox.mkdir()
    store = store_of(spark, f"file://{tmp_path}/out", 2)

    def run():
        assert ingest(arriving(spark, str(inbox), files=1), store, mark).awaitTermination(120)
        return sorted((r.claim_id, r.report_id, r.metric_value, r.canonical_unit) for r in store.read().collect())

    put(inbox, "a.json", [{"claim_id": i, "report_id": "r", "metric_value": 5.0} for i in (1, 2, 3)] + [{"claim_id": 7, "report_id": "s", "metric_value": 6.0}])
    put(inbox, "b.json", [{"claim_id": i, "report_id": "r", "metric_value": 5.0} for i in (4, 5, 6)])
    assert run() == [*((i, "r", 5.0, "m3") for i in range(1, 7)), (7, "s", 6.0, "m3")]
    put(inbox, "c.json", [{"claim_id": 3, "report_id": "r", "metric_value": 7.0}])
    assert [r[2] for r in run()] == [5.0, 5.0, 7.0, 5.0, 5.0, 5.0, 6.0]


def test_counts_by_time(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(r.n for r in counts(events).collect()) == events.count()
