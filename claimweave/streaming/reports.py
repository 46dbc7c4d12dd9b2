"""Units of reports as they stream in: a report goes into the store when all its units are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from claimweave.operators.claims import enrich
from claimweave.sources.published import Store
from claimweave.streaming.claims import SCHEMA

#: A line of a file: one finished unit of a report, how many units that report has, and its claims.
UNIT = "report_id STRING, unit STRING, units INT, claims ARRAY<STRING>, torn STRING"
#: What comes out: a report that is complete, a row a claim (null if it has none), or one that never became so.
COLLECTED = "report_id STRING, status STRING, done INT, claim STRING"
#: A claim without its report.
CLAIM = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith(("report_id", "torn")))


def arriving_units(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Finished units in the JSON lines of files that come into ``folder``. Torn lines, and lines without a report, a unit
    or a number of units, are left out: such a unit is not done and comes again."""
    lines = spark.readStream.schema(UNIT).option("columnNameOfCorruptRecord", "torn").option("maxFilesPerTrigger", files).json(folder)
    return lines.where("torn IS NULL AND report_id IS NOT NULL AND unit IS NOT NULL AND units > 0").drop("torn")


class Collector(StatefulProcessor):
    """Holds the units done of each report. A unit that comes again takes the place of what it was.

    When as many units are done as the report has (by its last line), its claims go out and its state ends. A report
    with no new unit for ``wait_ms`` goes out as given up, without claims, when a later batch comes.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getMapState("units", "unit string", "claims array<string>")

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted = None
        for part in rows:
            for unit, units, claims in zip(part["unit"], part["units"], part["claims"]):
                self.units.updateValue((unit,), ([] if claims is None else list(claims),))
                wanted = int(units)
        done = sum(1 for _ in self.units.keys())
        if wanted is None or done < wanted:
            self._timer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            return
        claims = [c for _, (some,) in self.units.iterator() for c in some]
        self.units.clear()
        self._timer(None)
        yield pd.DataFrame({"report_id": key[0], "status": "complete", "done": done, "claim": claims or [None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = sum(1 for _ in self.units.keys())
        self.units.clear()
        yield pd.DataFrame({"report_id": [key[0]], "status": ["given up"], "done": [done], "claim": [None]})

    def close(self) -> None:
        pass


def collected(units: DataFrame, wait_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """The claims of each report of a stream of units, in the micro-batch that makes it whole.

    The state must be kept by the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
    """
    return units.groupBy("report_id").transformWithStateInPandas(Collector(wait_ms), COLLECTED, "Update", "ProcessingTime")


def claims_of(reports: DataFrame) -> DataFrame:
    """The claims of complete reports with their derived columns; texts that are no claim with an id are left out."""
    whole = reports.where("status = 'complete' AND claim IS NOT NULL").select("report_id", F.from_json("claim", CLAIM).alias("c"))
    return enrich(whole.where("c.claim_id IS NOT NULL").select("report_id", "c.*"))


def store_of(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The store of claims with derived columns, by report."""
    return Store(spark, path, claims_of(spark.createDataFrame([], COLLECTED)).schema, "report_id", buckets)


def ingest_reports(stream: DataFrame, store: Store, checkpoint: str, jobs: Store | None = None) -> StreamingQuery:
    """Write each report that becomes complete in one step, in place of what the store had of it.

    A report without any claim leaves what the store has. What was read, and units of reports that are not
    complete, are kept in ``checkpoint``: a restart goes on there, and a batch that runs twice writes the same rows.
    ``jobs`` (report_id, status, done) gets the last outcome of each report.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            store.replace(claims_of(batch))
            if jobs is not None:
                jobs.replace(batch.groupBy("report_id").agg(F.max_by("status", F.col("status") == "complete").alias("status"), F.max("done").alias("done")))
        finally:
            batch.unpersist()

    # with timers, batches without data would follow each other for ever once all files are read
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = store.spark.conf.get(name)
    store.spark.conf.set(name, "false")
    try:
        return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        store.spark.conf.set(name, before)
