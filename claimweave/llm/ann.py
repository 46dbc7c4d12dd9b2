"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small_batches
from claimweave.llm.vectors import matrix, pack, valid_vectors

#: Neighbours of a node (twice as many on the lowest layer), and the width of searches while a graph is
#: built and when it is asked.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 14, 80, 96
#: Shards are at least SHARDS and hold SHARD_ROWS vectors at most, about; queries go in blocks.
SHARDS, SHARD_ROWS, QUERIES = 8, 32_768, 256


@dataclass
class Graph:
    """Layers of neighbour lists as flat arrays: node i of layer l has its neighbours in
    ``links[l][i * width : (i + 1) * width]``, of which the first ``counts[l][i]`` are set."""

    points: np.ndarray
    level: np.ndarray
    links: list[np.ndarray]
    counts: list[np.ndarray]
    entry: int

    def neighbours(self, layer: int, node: int) -> np.ndarray:
        width = len(self.links[layer]) // len(self.points)
        return self.links[layer][node * width : node * width + self.counts[layer][node]]

    def climb(self, q: np.ndarray, start: int, layer: int) -> int:
        """The node that no neighbour on a layer betters."""
        now, score = start, float(self.points[start] @ q)
        while True:
            near = self.neighbours(layer, now)
            if not len(near):
                return now
            scores = self.points[near] @ q
            best = int(scores.argmax())
            if scores[best] <= score:
                return now
            now, score = int(near[best]), float(scores[best])

    def search(self, q: np.ndarray, start: int, layer: int, width: int) -> list[tuple[float, int]]:
        """The up to ``width`` best (score, node) that a best-first walk from ``start`` meets, best first."""
        seen = np.zeros(len(self.points), bool)
        seen[start] = True
        score = float(self.points[start] @ q)
        todo, held = [(-score, start)], [(score, start)]
        while todo:
            score, node = heapq.heappop(todo)
            if -score < held[0][0] and len(held) >= width:
                break
            near = self.neighbours(layer, node)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            scores = self.points[near] @ q
            for s, x in zip(scores.tolist(), near.tolist(), strict=True):
                if len(held) < width:
                    heapq.heappush(held, (s, x))
                elif s > held[0][0]:
                    heapq.heapreplace(held, (s, x))
                else:
                    continue
                heapq.heappush(todo, (-s, x))
        return sorted(held, reverse=True)

    def descend(self, q: np.ndarray, to: int) -> int:
        now = self.entry
        for layer in range(len(self.links) - 1, to, -1):
            now = self.climb(q, now, layer)
        return now


def _spread(points: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Of candidates, best first, those nearer to the node than to one chosen before; then the best rest."""
    nodes = np.array([x for _, x in found])
    score = np.array([s for s, _ in found])
    among = points[nodes] @ points[nodes].T
    chosen: list[int] = []
    nearest = np.full(len(nodes), -np.inf)
    for i in range(len(nodes)):
        if len(chosen) == most:
            break
        if nearest[i] < score[i]:
            chosen.append(i)
            np.maximum(nearest, among[i], out=nearest)
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [i for i in range(len(nodes)) if i not in taken][: most - len(chosen)]
    return nodes[chosen].tolist()


def build(points: np.ndarray, seed: int) -> Graph:
    """Insert unit vectors one by one into layers drawn from a geometric law."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(points)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 8)
    tops = int(level.max(initial=0)) + 1
    widths = [2 * LINKS if k == 0 else LINKS for k in range(tops)]
    graph = Graph(points, level, [np.zeros(n * w, np.int32) for w in widths], [np.zeros(n, np.int32) for _ in widths], 0)
    for i in range(1, n):
        q = points[i]
        high, entry_level = int(level[i]), int(level[graph.entry])
        now = graph.entry
        for layer in range(entry_level, high, -1):
            now = graph.climb(q, now, layer)
        for layer in range(min(high, entry_level), -1, -1):
            found = graph.search(q, now, layer, BUILD_WIDTH)
            now = found[0][1]
            width, links, counts = widths[layer], graph.links[layer], graph.counts[layer]
            near = _spread(points, found, LINKS)
            links[i * width : i * width + len(near)] = near
            counts[i] = len(near)
            for x in near:
                if counts[x] < width:
                    links[x * width + counts[x]] = i
                    counts[x] += 1
                else:
                    others = np.append(links[x * width : (x + 1) * width], np.int32(i))
                    scores = points[others] @ points[x]
                    order = np.argsort(-scores)
                    kept = _spread(points, [(float(scores[j]), int(others[j])) for j in order], width)
                    links[x * width : x * width + len(kept)] = kept
                    counts[x] = len(kept)
        if high > entry_level:
            graph.entry = i
    return graph


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over ``longest`` with one more component that makes them unit vectors: the largest inner
    product with a query that has zero there is then the nearest direction."""
    scaled = v / longest
    rest = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
    return np.ascontiguousarray(np.concatenate([scaled, rest[:, None]], axis=1), np.float32)


def index_shards(classes: DataFrame, shards: int, seed: int = 5) -> DataFrame:
    """(shard, dim, n, ids, vals, entry, level, widths, links, counts): every vector of ``classes`` (id, v)
    in the graph of its shard, one row a shard."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = classes.groupBy(F.size("v").alias("d")).agg(F.max(norm).alias("longest"))
    key = F.struct(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")).alias("at")
    packed = pack(classes.select(key, "id", "v"), "at").select("at.dim", "at.shard", "n", "ids", "vals")
    ready = packed.repartition(shards, "shard", "dim").join(F.broadcast(longest), F.col("dim") == F.col("d")).drop("d")  # one row a dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                n = column["n"][r].as_py()
                graph = build(_lift(matrix(column["vals"], r, n), column["longest"][r].as_py()), seed)
                flat = [np.concatenate(graph.links), np.concatenate(graph.counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(column[c].slice(r, 1) for c in ("dim", "shard", "n", "ids", "vals")), pa.array([graph.entry], pa.int32()), pa.array([graph.level], pa.list_(pa.int64()))]
                    + [pa.array([x], pa.list_(pa.int32())) for x in flat]
                    + [pa.array([column["longest"][r].as_py()], pa.float64())],
                    ["dim", "shard", "n", "ids", "vals", "entry", "level", "links", "counts", "longest"],
                )

    return ready.mapInArrow(run, "dim int, shard int, n int, ids array<long>, vals array<double>, entry int, level array<long>, links array<int>, counts array<int>, longest double")


def _graph(column: dict, r: int, n: int, vectors: np.ndarray) -> Graph:
    counts = column["counts"][r].values.to_numpy(zero_copy_only=False)
    links = column["links"][r].values.to_numpy(zero_copy_only=False)
    tops = len(counts) // n
    cuts = np.cumsum([2 * LINKS * n] + [LINKS * n] * (tops - 1))[:-1]
    level = column["level"][r].values.to_numpy(zero_copy_only=False)
    return Graph(_lift(vectors, column["longest"][r].as_py()), level, np.split(links, cuts), np.split(counts, tops), column["entry"][r].as_py())


def ask_shards(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score): for each query (dim, qblock, qn, qids, qvals in blocks) the best k of every
    shard that its graph finds, with the inner product in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                n, m = column["n"][r].as_py(), column["qn"][r].as_py()
                vectors, asked = matrix(column["vals"], r, n), matrix(column["qvals"], r, m)
                ids, q_ids = (column[c][r].values.to_numpy(zero_copy_only=False) for c in ("ids", "qids"))
                graph, out = _graph(column, r, n, vectors), []
                norms = np.sqrt((asked * asked).sum(axis=1, keepdims=True))
                unit = np.concatenate([asked / norms, np.zeros((m, 1))], axis=1).astype(np.float32)
                for i in range(m):
                    near = [x for _, x in graph.search(unit[i], graph.descend(unit[i], 0), 0, max(SEARCH_WIDTH, 2 * k))[: k + 8]]
                    scores = vectors[near] @ asked[i]
                    order = np.lexsort((ids[near], -scores))[:k]
                    out += [(int(q_ids[i]), int(ids[near[j]]), float(scores[j])) for j in order.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out])], ["query", "id", "score"])

    spread = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.select("shard").agg(F.max("shard")).first()[0] or 0))))
    return spread.join(index, ["dim", "shard"]).mapInArrow(run, "query long, id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products for every query id.

    ``is_query`` is a condition on column id. Candidates are all ids but the query's own, of as many
    components; fewer give fewer rows. ``score`` is the inner product of the vectors in double precision,
    ties go to the smaller id. Invalid and zero vectors (see ``valid_vectors``) take no part.

    Equal vectors are one node of a graph that stands for its k + 1 smallest ids, more of which no answer
    needs, so a large group of copies neither fills a shard nor crowds a graph. Every shard is asked and
    the results are merged. Shards hold up to SHARD_ROWS vectors: their number follows the table.
    """
    small_batches(df.sparkSession, 4)
    whole = valid_vectors(df, id_col, vector).where(F.exists("v", lambda x: x != 0))
    ranked = whole.withColumn("r", F.expr("row_number() OVER (PARTITION BY v ORDER BY id)")).where(F.col("r") <= k + 1)
    classes = cut(ranked.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("same")))
    shards = max(SHARDS, -(-classes.count() // SHARD_ROWS))
    index = cut(index_shards(classes.select("id", "v"), shards))
    asked = whole.where(is_query)
    blocks = max(1, -(-asked.count() // QUERIES))
    key = F.struct(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")).alias("at")
    packed = pack(asked.select(key, "id", "v"), "at").select("at.dim", F.col("at.b").alias("qblock"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vals").alias("qvals"))
    found = ask_shards(index, cut(packed), k + 1)
    merged = found.withColumn("r", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, id)")).where(F.col("r") <= k + 1)
    members = merged.join(classes.select("id", "same"), "id").select(F.col("query").alias("query_id"), "score", F.explode("same").alias("vec_id"))
    best = members.where("query_id <> vec_id").withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
