"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one type; nulls and loops are
    ignored), where component is the smallest node reachable.

    Each round links a node's larger neighbours to its smallest one (large star), then its smaller
    neighbours and itself (small star). Rounds grow with the logarithm of a component's size. Only a
    row count and a checksum of the edges reach the driver. An empty table gives an empty table.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .select(F.explode(F.expr("array(struct(u, m AS v), struct(v AS u, m AS v))")).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
