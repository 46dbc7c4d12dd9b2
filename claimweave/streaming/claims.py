"""Claim files as a stream through the derived columns into the store, and late events counted by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.operators.claims import enrich
from claimweave.sources.published import Store

#: A claim in a file of JSON lines; lines that cannot be read have only ``torn``.
SCHEMA = (
    "claim_id BIGINT, report_id STRING, aspect STRING, normalized_aspect STRING, claim_type STRING, source_type STRING, source_sentence STRING, metric_value DOUBLE, metric_unit STRING, "
    "metric_direction STRING, time_bucket STRING, location_text STRING, location_scope STRING, torn STRING"
)


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Claims of the files that come into ``folder``, so many files at a time; torn lines are left out."""
    lines = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "torn").option("maxFilesPerTrigger", files).json(folder)
    return lines.where("torn IS NULL AND claim_id IS NOT NULL").drop("torn")


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Write the claims, with their derived columns, by report: one that comes again replaces what it was, the report's
    others stay, whatever files and micro-batches they come in. Reports that come again as a whole go through
    ``reports.ingest_reports``.

    What was read is kept in ``checkpoint``, so a restart goes on where it stopped, and a batch that runs twice
    writes the same rows.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.replace(enrich(batch.where("report_id IS NOT NULL").dropDuplicates(["report_id", "claim_id"])), ids=["claim_id"])

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events (ts, event_type) by type and window; those later than ``late`` are dropped, and so is their state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
