"""A total order of a table over all its partitions: row numbers, pages and running sums without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimweave.sources.tables import settled


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums (name: column of whole numbers, null as 0) over all rows in the order given.

    Rows are dealt by ranges of the order and sorted there; each task adds up its own rows, and its start is the
    sum of the parts before it. Only one row a part comes to the driver. Give an order that tells all rows apart, else
    equal ones fall in one part.
    """
    schema = StructType([*df.schema, *(StructField(n, LongType()) for n in sums), StructField("__part", LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for name, source in sums.items():
                values = batch.column(source).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(values) + held[name]
                held[name] = int(total[-1]) if len(total) else held[name]
                columns.append(pa.array(total, pa.int64()))
                names.append(name)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part), pa.int64())], names=[*names, "__part"])

    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    ends = parts.groupBy("__part").agg(*(F.max(n).alias(n) for n in sums)).orderBy("__part").collect()
    if not ends:
        return parts.drop("__part")
    starts = list(zip([r["__part"] for r in ends], *([0, *accumulate(r[n] for r in ends)] for n in sums)))
    before = df.sparkSession.createDataFrame(starts, "__part long, " + ", ".join(f"__before_{n} long" for n in sums))
    met = parts.join(F.broadcast(before), "__part")
    return met.select(*df.columns, *((F.col(n) + F.col(f"__before_{n}")).alias(n) for n in sums))


def in_order(df: DataFrame, by: str, descending: bool = False, key: str = "claim_id") -> DataFrame:
    """``df`` with ``place``, its row number (from 1) by the column ``by``, missing values last either way, then by ``key``."""
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    numbered = running_sums(df.withColumn("__one", F.lit(1)), [first, F.asc_nulls_last(key)], {"place": "__one"})
    return numbered.drop("__one")


def page(ordered: DataFrame, number: int, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of rows with a ``place``."""
    return ordered.where(F.col("place").between((number - 1) * size + 1, number * size))
