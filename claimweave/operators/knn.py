"""The nearest claims of every claim: an exact self-join of vectors by pivots, rings and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.vectors import unit_vector
from claimweave.sources.tables import settled

#: Rows of a block; pivots of a family at most; rows that one task assigns to pivots; blocks that one task compares with a block.
BLOCK_ROWS, PIVOTS, LANE_ROWS, LANE_BLOCKS = 1024, 256, 20_000, 64
#: Slack for distances that are computed in doubles.
SLACK = 1e-7

_BLOCK = "family string, dim int, pivot int, block long, n int, low double, high double, ids binary, vectors binary"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest_pivot(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Rows of one family with the place of their nearest pivot and how far it is."""
    if not rows.num_rows:
        return pa.table({"family": pa.array([], pa.string()), "dim": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "pivot": pa.array([], pa.int32()), "far": pa.array([], pa.float64())})
    dim = rows["dim"][0].as_py()
    v, p = _matrix(rows["v"], dim), _matrix(pivots["p"], dim)
    near = (v @ p.T).argmax(axis=1)
    far = np.linalg.norm(v - p[near], axis=1)
    nth = pivots["nth"].to_numpy()[near].astype(np.int32)
    return rows.select(["family", "dim", "id", "v"]).append_column("pivot", pa.array(nth)).append_column("far", pa.array(far))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come in order of family, pivot and distance, as blocks with the least and greatest distance."""
    made, held, key = 0, [], None

    def block() -> pa.RecordBatch:
        nonlocal made
        ids = np.array([r[0] for r in held], np.int64)
        vectors = np.array([r[2] for r in held])
        name = (TaskContext.get().partitionId() << 32) + made
        made += 1
        values = [key[0], key[1], key[2], name, len(held), held[0][1], held[-1][1], ids.tobytes(), vectors.tobytes()]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([x], t) for x, t in zip(values, types)], names=["family", "dim", "pivot", "block", "n", "low", "high", "ids", "vectors"])

    for batch in batches:
        families, dims, ids, pivots, far = (batch.column(c).to_pylist() for c in ("family", "dim", "id", "pivot", "far"))
        vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        at = 0
        for family, dim, i, pivot, d in zip(families, dims, ids, pivots, far):
            if held and ((family, dim, pivot) != key or len(held) == BLOCK_ROWS):
                yield block()
                held.clear()
            key = (family, dim, pivot)
            held.append((i, d, vectors[at : at + dim]))
            at += dim
    if held:
        yield block()


class Best:
    """The k most similar of each row of a block, more than ``at_least`` alike, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, at_least: float) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.least = np.full(len(ids), np.nextafter(at_least, 2))
        self.row, self.similarity, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        s = np.round(self.vectors @ vectors.T, 9)
        s[self.ids[:, None] == ids[None, :]] = -2
        least = self.least
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(s >= least[:, None])
        row, similarity, i = np.concatenate([self.row, row]), np.concatenate([self.similarity, s[row, column]]), np.concatenate([self.id, ids[column]])
        order = np.lexsort((i, -similarity, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        self.row, self.similarity, self.id = row[place < self.k], similarity[kept], i[kept]
        full = place == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], similarity[order][full])


def _compare(k: int, at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.row):
                yield pa.record_batch([pa.array(best.ids[best.row]), pa.array(best.id), pa.array(best.similarity)], names=["query_id", "id", "similarity"])

        for batch in batches:
            for kind, dim, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("kind", "dim", "ids", "vectors"))):
                i, v = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                if kind == 0:
                    yield from out()
                    best = Best(i, v, k, at_least)
                else:
                    best.meet(i, v)
        yield from out()

    return run


def nearest_of_all(vectors: DataFrame, k: int, at_least: float, block: str) -> DataFrame:
    """(query_id, id, similarity, place): for every row of ``vectors`` (id, vector, the column ``block``) the ``k`` most
    similar others of its block (cosine, 9 digits), if more than ``at_least``; ties go to the smaller id.

    Rows without a block, and vectors that are null, zero or hold null or non-finite numbers, take no part; vectors
    meet only those of their length. Of rows that repeat an id in a block one takes part (that of the least vector).

    Each vector goes to its nearest pivot (rows picked by hash). By distance from it a cell falls into rings of up to
    ``BLOCK_ROWS`` rows, however many rows it has. What two rings can hold is bounded by the triangle inequality,
    and what a ring's k-th neighbours can be away by the cells near it that hold k rows. Pairs of rings beyond that are
    dropped unread; the others meet in blocks, a bounded number of them in a task.
    """
    spark = vectors.sparkSession
    v = vectors.select("id", F.col(block).cast("string").alias("family"), unit_vector("vector").alias("v"))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("v").isNotNull() & F.col("family").isNotNull() & F.col("id").isNotNull() & whole)
    v = settled(v.groupBy("family", F.size("v").alias("dim"), F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v")))
    sizes = v.groupBy("family", "dim").agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("rows") / BLOCK_ROWS))).withColumn("lanes", F.ceil(F.col("rows") / LANE_ROWS))
    picked = Window.partitionBy("family", "dim").orderBy("h", "id")
    pivots = v.select("family", "dim", "id", F.xxhash64("id").alias("h")).withColumn("nth", F.row_number().over(picked)).where(F.col("nth") <= PIVOTS)
    pivots = pivots.join(sizes, ["family", "dim"]).where("nth <= pivots").join(v.select("family", "dim", "id", F.col("v").alias("p")), ["family", "dim", "id"])
    pivots = settled(pivots.select("family", "dim", "nth", "p", "lanes"))

    laned = v.join(sizes.select("family", "dim", "lanes"), ["family", "dim"]).withColumn("lane", F.pmod(F.xxhash64("id", F.lit(1)), "lanes"))
    spread = pivots.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))
    keys = ["family", "dim", "lane"]
    placed = laned.groupBy(keys).cogroup(spread.groupBy(keys)).applyInArrow(_nearest_pivot, "family string, dim int, id long, v array<double>, pivot int, far double")
    ranged = settled(placed).repartitionByRange("family", "dim", "pivot", "far", "id").sortWithinPartitions("family", "dim", "pivot", "far", "id")
    blocks = settled(ranged.mapInArrow(_blocks, _BLOCK))

    about = blocks.select("family", "dim", "pivot", "block", "n", "low", "high")
    cells = about.groupBy("family", "dim", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    p = pivots.select("family", "dim", F.col("nth").alias("pivot"), "p")
    q = p.select("family", "dim", F.col("pivot").alias("other"), F.col("p").alias("q"))
    gap = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    apart = p.join(q, ["family", "dim"]).select("family", "dim", "pivot", "other", gap.alias("apart"))
    other = cells.select("family", "dim", F.col("pivot").alias("other"), F.col("n").alias("other_n"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = settled(apart.join(other, ["family", "dim", "other"]))
    reach = Window.partitionBy("family", "dim", "pivot").orderBy("to", "other")
    nearby = pairs.withColumn("to", F.col("apart") + F.col("other_high")).withColumn("held", F.sum("other_n").over(reach))
    kth = nearby.where(F.col("held") > k).groupBy("family", "dim", "pivot").agg(F.min("to").alias("to"))
    limit = float(np.sqrt(max(0.0, 2 - 2 * at_least)))
    asking = about.join(kth, ["family", "dim", "pivot"], "left")
    asking = asking.withColumn("within", F.least(F.lit(limit), F.coalesce(F.col("to") + F.col("high"), F.lit(2.0))) + SLACK)
    asking = asking.select("family", "dim", "pivot", F.col("block").alias("asks"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), "within")

    def apart_at_least(low: str, high: str):
        """Least distance between rings around pivots that are ``apart``."""
        return F.greatest(F.col("apart") - F.col("a_high") - F.col(high), F.col(low) - F.col("apart") - F.col("a_high"), F.col("a_low") - F.col("apart") - F.col(high))

    near_cells = asking.join(pairs.drop("other_n"), ["family", "dim", "pivot"]).where(apart_at_least("other_low", "other_high") <= F.col("within"))
    met = near_cells.join(about.select("family", "dim", F.col("pivot").alias("other"), "block", "low", "high"), ["family", "dim", "other"])
    met = met.where(apart_at_least("low", "high") <= F.col("within")).select("asks", "block", "apart")
    lane = F.floor((F.row_number().over(Window.partitionBy("asks").orderBy("apart", "block")) - 1) / LANE_BLOCKS)
    met = settled(met.withColumn("lane", lane))
    data = blocks.select("block", "dim", "ids", "vectors")
    asks = met.select("asks", "lane").distinct().join(data.withColumnRenamed("block", "asks"), "asks").withColumn("kind", F.lit(0)).withColumn("apart", F.lit(0.0))
    answers = met.join(data, "block").select("asks", "lane", "dim", "ids", "vectors", F.lit(1).alias("kind"), "apart")
    stream = asks.select(answers.columns).unionByName(answers).repartition("asks", "lane").sortWithinPartitions("asks", "lane", "kind", "apart")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        found = settled(stream.mapInArrow(_compare(k, at_least), "query_id long, id long, similarity double"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def contrary_pairs(neighbours: DataFrame, sentences: DataFrame) -> DataFrame:
    """(a, b, similarity): each unordered pair of ``neighbours`` once, none whose sentences (id, sentence) are equal.

    Rows without a sentence are equal to none.
    """
    pairs = neighbours.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity").distinct()
    side = lambda x: sentences.select(F.col("id").alias(x), F.md5("sentence").alias(f"s_{x}"), F.length("sentence").alias(f"l_{x}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.where(~F.coalesce((F.col("s_a") == F.col("s_b")) & (F.col("l_a") == F.col("l_b")), F.lit(False))).select("a", "b", "similarity")
