"""Exact top-k inner products, pruned by segment means and deviations at several resolutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small_batches
from claimweave.llm.vectors import matrix, pack, valid_vectors

#: Rows of a block of candidates and of one of queries, about.
CANDIDATES, QUERIES = 4096, 512
#: Segments of a vector, coarse to fine.
SEGMENTS = (1, 4, 16)
_EXACT = float(1 << 53)


def summaries(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """At each resolution: lengths of the segments, and each vector's means and deviations in them."""
    out = []
    for count in SEGMENTS:
        edges = np.unique(np.linspace(0, v.shape[1], count + 1).astype(int))
        size = np.diff(edges)
        if not len(size):
            size, mean, square = np.zeros(0), np.zeros((len(v), 0)), np.zeros((len(v), 0))
        else:
            mean = np.add.reduceat(v, edges[:-1], axis=1) / size
            square = np.add.reduceat(v * v, edges[:-1], axis=1) / size
        out.append((size, mean, np.sqrt(np.maximum(square - mean * mean, 0))))
    return out


def least_distance(size: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Lower bound of the squared distance between one vector a and several b: in a segment, the squared
    gap of the means plus that of the deviations, times its length."""
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) @ size


def best(queries: np.ndarray, query_ids: np.ndarray, at_least: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows for each query, those below its ``at_least`` left out.

    score = (|q|^2 + |x|^2 - d^2) / 2, so a lower bound of the distance d bounds the score from above.
    The k rows of the best coarse bound give a first k-th score; whatever bound falls short of it, coarse
    to fine, is pruned, and the exact product is taken for what survives.
    """
    found: list[tuple[int, int, int]] = []
    if not len(rows):
        return found
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) >= _EXACT
    exact = (lambda i, at: (rows[at].astype(object) @ queries[i].astype(object)).astype(np.int64)) if wide else (lambda i, at: (x[at] @ q[i]).astype(np.int64))
    q_parts, x_parts = summaries(q), summaries(x)
    q_square, x_square = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for i in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[i])
        floor = float(at_least[i])
        for level, (size, mean, dev) in enumerate(x_parts):
            near = least_distance(size, (q_parts[level][1][i], q_parts[level][2][i]), (mean[alive], dev[alive]))
            total = q_square[i] + x_square[alive]
            bound = (total - near) / 2 + 1e-9 * (total + 1)
            if level == 0 and len(alive) > k:
                first = alive[np.argpartition(-bound, k - 1)[:k]]
                floor = max(floor, float(exact(i, first).min()))
            alive = alive[bound >= floor]
        if len(alive):
            score = exact(i, alive)
            order = np.lexsort((ids[alive], -score))[:k]
            found += [(int(query_ids[i]), int(ids[alive[j]]), int(score[j])) for j in order.tolist() if score[j] >= floor]
    return found


def _search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of each block of ``rows`` that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                n, m = column["qn"][r].as_py(), column["n"][r].as_py()
                q_ids, ids = (column[c][r].values.to_numpy(zero_copy_only=False) for c in ("qids", "ids"))
                low = column["floors"][r].values.to_numpy(zero_copy_only=False)
                out = best(matrix(column["qvals"], r, n), q_ids, low, matrix(column["vals"], r, m), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return queries.join(rows, ["dim", "qblock"]).mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)")).where(F.col("rank") <= k)


def exact_topk(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for every query id.

    Each component x becomes floor(scale * x). Candidates are all ids but the query's own of as many
    components; fewer than k candidates give fewer rows. Ties go to the smaller id. Invalid vectors (see
    ``valid_vectors``) take no part, zero vectors do; products are taken to fit 64 bits. An empty table
    gives an empty result. ``is_query`` is a condition on column id.

    Queries and candidates are packed into blocks by hash and every block of one meets every block of
    the other, so work is the query set times all rows, and a task holds one block of each. A first pass
    over one block in each dimension gives every query a k-th score to prune by in all others.
    """
    small_batches(df.sparkSession, 8)
    whole = valid_vectors(df, id_col, vector)
    whole = cut(whole.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.size("v").alias("dim")))
    queries = whole.where(is_query)
    blocks = max(1, -(-whole.count() // CANDIDATES))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    hashed = F.xxhash64("id", F.lit(3))
    key = lambda n: F.struct("dim", F.pmod(hashed, F.lit(n)).cast("int").alias("b")).alias("at")
    rows = cut(pack(whole.select(key(blocks), "id", "v"), "at").select("at.dim", F.col("at.b").alias("block"), "n", "ids", "vals"))
    spread = rows.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    packed = pack(queries.select(key(query_blocks), "id", "v"), "at").select("at.dim", F.col("at.b").alias("qblock"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vals").alias("qvals"))
    packed = cut(packed)
    none = packed.withColumn("floors", F.transform("qids", lambda _: F.lit(-(2**62)).cast("long")))
    first = rows.groupBy("dim").agg(F.min("block").alias("block"))
    seeds = _ranked(_search(none, spread.join(first, ["dim", "block"]), k), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    low = seeds.where(F.col("n") == k).select(F.col("query_id").alias("id"), "low")
    floors = (
        packed.select("dim", "qblock", F.posexplode("qids").alias("pos", "id"))
        .join(low, "id", "left")
        .groupBy("dim", "qblock")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("low", F.lit(-(2**62))).alias("low")))).alias("f"))
        .select("dim", "qblock", F.col("f.low").alias("floors"))
    )
    found = _search(packed.join(cut(floors), ["dim", "qblock"]), spread, k)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
