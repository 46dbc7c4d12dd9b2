"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small

#: Rows of a shard that are ordered together, about.
BIN_ROWS = 4_000
#: numpy draws from populations below this.
_POPULATION = 10**9


def _wide_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for a population of any size, by inversion of its distribution.

    Probabilities follow from the one before by an exact ratio, so only those around the most likely count are
    made: twelve deviations to each side leave out less than 1e-30 of the whole.
    """
    everything = good + bad
    spread = (n * (good / everything) * (bad / everything) * ((everything - n) / max(everything - 1, 1))) ** 0.5
    middle, reach = n * good // everything, int(12 * spread) + 24
    low, high = max(0, n - bad, middle - reach), min(good, n, middle + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(float(bad - n) + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw: how many of n rows without replacement are good."""
    if not good or not bad:
        return n if good else 0
    return int(rng.hypergeometric(good, bad, n)) if good + bad < _POPULATION else _wide_draw(rng, good, bad, n)


def communication_matrix(rows_in: list[int], rows_out: list[int], seed: int) -> np.ndarray:
    """How many rows of each partition go to each shard, drawn as a uniform shuffle would give them.

    Partition by partition, its rows are a draw without replacement from the places left in the shards,
    so rows add up to ``rows_in`` and columns to ``rows_out`` exactly.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(rows_out, np.int64)
    matrix = np.zeros((len(rows_in), len(rows_out)), np.int64)
    for p, n in enumerate(rows_in):
        for s in range(len(left)):
            matrix[p, s] = _draw(rng, int(left[s]), int(left[s + 1 :].sum()), n)
            n -= int(matrix[p, s])
        left -= matrix[p]
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, 0 to the shard's size - 1).

    Every order of the rows is equally likely; shard sizes differ by one at most. The rows are first
    written as a table with their partition and place in it, so a task that runs again deals them alike.
    The driver draws the communication matrix (partitions x shards counts, no rows). Each partition's
    shard numbers are permuted and every row gets a random place; bins of a shard by place, of about
    BIN_ROWS rows, are then exchanged and ordered on their own, so no shard has to fit a task. Rows are
    never compared by value: nulls, repeated rows and any columns pass through, and columns named shard
    or slot are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = cut(df.drop("shard", "slot").withColumns({"__p": F.spark_partition_id(), "__at": place}))
    rows = {r["__p"]: r["count"] for r in fixed.groupBy("__p").count().collect()}
    sizes = [rows.get(p, 0) for p in range(max(rows, default=-1) + 1)]
    matrix = spark.sparkContext.broadcast(communication_matrix(sizes, shard_sizes(sum(sizes), shards), seed))
    bins = max(1, -(-sum(sizes) // (shards * BIN_ROWS)))

    @F.pandas_udf("shard int, place long")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        now, to, places = -1, None, None
        for partition, at in batches:
            p, i = partition.to_numpy(), at.to_numpy()
            shard, where = np.zeros(len(p), np.int32), np.zeros(len(p), np.int64)
            for x in np.unique(p).tolist():
                if x != now:
                    rng = np.random.Generator(np.random.PCG64([seed, x]))
                    counts = matrix.value[x]
                    now, to = x, rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), counts))
                    places = rng.integers(0, 2**62, len(to))
                mine = p == x
                shard[mine], where[mine] = to[i[mine]], places[i[mine]]
            yield pd.DataFrame({"shard": shard, "place": where})

    dealt = fixed.withColumn("__to", deal("__p", "__at")).withColumn("__bin", F.col("__to.place") % bins)
    held = dealt.groupBy(F.col("__to.shard").alias("__s"), F.col("__bin").alias("__b")).count()
    earlier = "coalesce(sum(count) OVER (PARTITION BY __s ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    before = small(held.select("__s", "__b", F.expr(earlier).alias("__before")), shards * bins)
    ranked = dealt.withColumn("__rank", F.expr("row_number() OVER (PARTITION BY __to.shard, __bin ORDER BY __to.place, __p, __at)"))
    placed = ranked.join(before, (F.col("__to.shard") == F.col("__s")) & (F.col("__bin") == F.col("__b")))
    kept = [c for c in fixed.columns if c not in ("__p", "__at")]
    return placed.select(*kept, F.col("__to.shard").alias("shard"), (F.col("__before") + F.col("__rank") - 1).cast("long").alias("slot"))
