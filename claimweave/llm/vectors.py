"""Valid vectors, and packing of vectors into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that holds no null, NaN or infinite component. Rows that
    repeat an id are one vector, the least of them."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def pack(rows: DataFrame, block: str) -> DataFrame:
    """One row for each value of ``block``: n, ids and vals, the vectors one after another."""
    held = rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("all"))
    return held.select(block, F.size("all").alias("n"), F.col("all.id").alias("ids"), F.flatten("all.v").alias("vals"))


def matrix(column: pa.ListArray, row: int, n: int) -> np.ndarray:
    """A packed column's values at a row as n vectors."""
    return column[row].values.to_numpy(zero_copy_only=False).reshape(n, -1)
