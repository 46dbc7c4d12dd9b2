"""Nearest claims by cosine similarity, and pairs of claims."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.sources.tables import settled

#: Queries up to this many are sent to the vectors; more are joined by shuffling both.
BROADCAST_QUERIES = 20_000
#: Rows of a block, pairs that are computed exactly at a time, blocks of queries that a task holds, blocks of vectors in a lane.
BLOCK_ROWS, MET_ROWS, HELD_BLOCKS, LANE_BLOCKS = 1024, 1 << 16, 64, 64
#: More than a product of matrices and the sum in order, and rounding to nine digits, can differ.
SLACK = 2e-9


def unit_vector(column: str) -> Column:
    """The vector at length 1, null for one of length 0."""
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))



def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, id, v) that come in order of the keys, vectors of one length in each, as blocks of up to BLOCK_ROWS of equal keys."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names[:-2]), strict=True))
        ids = batch.column("id").cast(pa.int64()).to_numpy()
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        start = at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == BLOCK_ROWS:
                end = at + (i - start) * keys[start][-1]
                data = [*([x] for x in keys[start]), [ids[start:i].tobytes()], [values[at:end].tobytes()]]
                types = [*batch.schema.types[:-2], pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types, strict=True)], [*batch.schema.names[:-2], "ids", "vectors"])
                start, at = i, end


def _rounded(s: np.ndarray) -> np.ndarray:
    """As Spark rounds to nine digits: half up by the decimal digits of each number."""
    scaled = s * 1e9
    out = np.rint(scaled) / 1e9
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-4).tolist():
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


class Found:
    """The k nearest that each query of a block has met, ties to the smaller id; not a number is above all, as in SQL."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, at_least: float) -> None:
        self.ids, self.vectors, self.k, self.at_least = ids, vectors, k, at_least
        self.least = np.full(len(ids), at_least)
        self.row, self.similarity, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        about = self.vectors @ vectors.T
        about[np.isnan(about)] = np.inf
        about[self.ids[:, None] == ids[None, :]] = -np.inf
        near = about >= (self.least - SLACK)[:, None]
        many = np.flatnonzero(near.sum(axis=1) > self.k)
        if len(many):
            kth = np.partition(about[many], -self.k, axis=1)[:, -self.k]
            near[many] &= about[many] >= (kth - SLACK)[:, None]
        row, column = np.nonzero(near)
        for start in range(0, len(row), MET_ROWS):
            self._add(row[start : start + MET_ROWS], column[start : start + MET_ROWS], ids, vectors)

    def _add(self, row: np.ndarray, column: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        exact = np.zeros(len(row))
        for d in range(vectors.shape[1]):  # one sum after another, as SQL adds
            exact += self.vectors[row, d] * vectors[column, d]
        exact = np.where(np.isnan(exact), np.inf, exact)
        whole = np.isfinite(exact)
        exact[whole] = _rounded(exact[whole])
        passed = exact > self.at_least
        row, exact, found = row[passed], exact[passed], ids[column[passed]]
        row, similarity, i = np.concatenate([self.row, row]), np.concatenate([self.similarity, exact]), np.concatenate([self.id, found])
        order = np.lexsort((i, -similarity, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.similarity, self.id = row[kept], similarity[order][kept], i[order][kept]
        full = place == self.k - 1
        self.least[row[full]] = similarity[order][full]

    def rows(self) -> pa.RecordBatch:
        similarity = np.where(np.isinf(self.similarity), np.nan, self.similarity)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(similarity, from_pandas=False)], ["query_id", "id", "similarity"])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, at_least: float, block: str | None = None) -> DataFrame:
    """(query_id, id, similarity, place): the k nearest of ``vectors`` (id, vector and the block column) for each
    row of ``queries`` in its block, itself left out, if their cosine similarity exceeds ``at_least``; ties go to
    the smaller id. Ids are whole numbers; vectors meet only those of their length.

    Every query meets all vectors of its block, as products of matrices of up to BLOCK_ROWS rows each; what can be among the k
    is computed again in the order of SQL's sum, so results are those of a join. A task keeps k rows of each query of
    HELD_BLOCKS blocks.
    """
    spark = vectors.sparkSession
    keys = ["block", "dim"]
    own = F.col(block) if block else F.lit(0)

    def packed(df: DataFrame) -> DataFrame:
        v = df.select(own.alias("block"), F.col("id").cast("long").alias("id"), unit_vector("vector").alias("v")).where("v IS NOT NULL AND id IS NOT NULL AND block IS NOT NULL")
        v = v.where(~F.exists("v", lambda x: x.isNull())).select("block", F.size("v").alias("dim"), "id", "v")
        kind = v.schema["block"].dataType.simpleString()
        return settled(v.sortWithinPartitions(*keys).mapInArrow(_packed, f"block {kind}, dim int, ids binary, vectors binary"))

    q, v = packed(queries), packed(vectors)
    few = (q.agg(F.sum(F.length("ids") / 8)).first()[0] or 0) <= BROADCAST_QUERIES
    q = q.select(*keys, F.monotonically_increasing_id().alias("asks"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    if few:
        met = v.join(F.broadcast(q), keys)
    else:  # blocks of vectors are spread by lanes, so that no task gets a whole group
        lanes = v.groupBy(*keys).agg(F.ceil(F.count("*") / LANE_BLOCKS).alias("lanes"))
        laned = v.join(F.broadcast(lanes), keys).withColumn("lane", F.pmod(F.xxhash64("ids"), "lanes"))
        met = laned.join(q.join(F.broadcast(lanes), keys).withColumn("lane", F.explode(F.expr("sequence(0L, lanes - 1)"))).drop("lanes"), [*keys, "lane"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Found] = {}
        for batch in batches:
            for dim, asks, q_ids, q_vectors, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if asks not in held:
                    if len(held) == HELD_BLOCKS:
                        yield held.pop(next(iter(held))).rows()
                    held[asks] = Found(np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dim), k, at_least)
                held[asks].meet(np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim))
        for found in held.values():
            yield found.rows()

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        found = settled(met.select("dim", "asks", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(compare, "query_id long, id long, similarity double"))
    finally:
        spark.conf.set(name, before)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair of (a, b) once, the first by ``at``; none of an id with itself; rows with a missing id
    are all kept, for they cannot be told apart."""
    whole = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    once = whole.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by(F.struct("a", "b", "at"), "at").alias("p")).select("p.*")
    return once.unionByName(pairs.where("a IS NULL OR b IS NULL").select("a", "b", "at"))
