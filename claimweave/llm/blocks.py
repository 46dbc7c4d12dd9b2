"""Members of blocks to pairs, without all pairs of a large block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import cut, small


def split_blocks(members: DataFrame, hot: int, least: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot members) of ``members`` (block, node, fp), where a node is at most once in a block.

    Pairs are (a, b, x): two nodes, a < b, and the bits in which their fingerprints differ; with ``least`` also (m), the
    least node of their block. Blocks of
    one are dropped by a pre-aggregated count. A block of two needs only its extremes. Blocks of up to
    ``hot`` give all their pairs, so a node has under ``hot`` partners there. Larger ones come back as
    (block, node, fp, n) for a way that does not pair everything.
    """
    stats = cut(
        members.groupBy("block")
        .agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.min("fp").alias("f"), F.max("fp").alias("g"))
        .where("n > 1")
    )
    two = stats.where("n = 2").selectExpr("a", "b", "f ^ g AS x", *["a AS m"] * least)
    some = members.join(small(stats.where(f"n > 2 AND n <= {hot}").select("block")), "block")
    more = (
        some.groupBy("block")
        .agg(F.collect_list(F.struct("node", "fp")).alias("all"))
        .select("all", F.array_min("all.node").alias("m"), F.explode("all").alias("p"))
        .select("m", "p", F.explode("all").alias("q"))
        .where("p.node < q.node")
        .selectExpr("p.node AS a", "q.node AS b", "p.fp ^ q.fp AS x", *["m"] * least)
    )
    large = members.join(small(stats.where(f"n > {hot}").select("block", "n")), "block")
    return two.unionByName(more), large
