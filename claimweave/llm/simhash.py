"""SimHash near-duplicate detection with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.blocks import split_blocks
from claimweave.llm.common import cut, small_batches
from claimweave.llm.components import connected_components
from claimweave.llm.nearcopies import keep_first

BITS = 64
#: Blocks of more fingerprints than this are linked through shared neighbours instead of pairs.
HOT_BLOCK = 24
#: Hashes spread into bits at a time, so that a text of any length needs little memory.
_CHUNK = 1 << 15



def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text, as an unsigned number.

    A-Z are lower-cased, words are runs of anything but ASCII white space, features are all runs of
    ``shingle`` words (the whole sequence if there are fewer), repeats included, hashed by XXH64 with
    seed 42. A bit is set if it is set in over half the hashes. No words: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    grams = zip(*(words[i:] for i in range(k)), strict=False)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "__fp", shingle: int = 3) -> DataFrame:
    """``df`` with the SimHash of ``text`` as a signed long."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, simhash(F.col(text)))


def chain_budgets(max_diff: int, segments: int) -> list[int]:
    """Differing bits allowed in a chain of 1, 2, ... consecutive segments: the share of ``max_diff``
    that falls to them, rounded down. If two fingerprints differ in at most ``max_diff`` bits, some
    start on the ring of segments keeps within every one of these budgets."""
    return [k * max_diff // segments for k in range(1, segments + 1)]


def _segments(segments: int) -> list[int]:
    """A mask of each segment, as even as 64 bits allow."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> str:
    return f"{mask - (1 << BITS) if mask >> (BITS - 1) else mask}L" if mask != 1 << (BITS - 1) else "(-9223372036854775807L - 1L)"


def near_links(fps: DataFrame, max_diff: int = 2, segments: int = 5, hot: int = HOT_BLOCK) -> DataFrame:
    """Links (a, b) that connect all values of column fp (distinct, not null) which differ in at most
    ``max_diff`` bits. ``max_diff`` is even; every link joins values whose distance is within it, or
    both of which reach a shared middle value within half of it.

    Pigeonring: the leading segments whose budget is zero must agree, so they are the block key, one
    per ring position. In blocks of up to ``hot`` values, pairs pass only if each longer chain from
    that position keeps within its budget; then comes the full Hamming check. In larger blocks each
    value is sent to all values within half the distance that agree in the key; two values meet there
    exactly if they are near, and a meeting place holds a bounded number of values, so a block of any
    size costs rows in proportion to its members and loses no link.
    """
    if max_diff % 2 or not 0 < max_diff < segments:
        raise ValueError("max_diff must be even, positive and below the number of segments")
    masks, budgets = _segments(segments), chain_budgets(max_diff, segments)
    lead = sum(1 for b in budgets if b == 0)
    chains = [[sum(masks[(i + j) % segments] for j in range(k)) for k in range(1, segments + 1)] for i in range(segments)]
    keys = ", ".join(f"struct({i} AS ring, fp & {_signed(c[lead - 1])} AS bits)" for i, c in enumerate(chains))
    members = fps.select("fp", F.col("fp").alias("node"), F.explode(F.expr(f"array({keys})")).alias("block"))
    pairs, large = split_blocks(members, hot)

    within = " OR ".join(
        "(" + " AND ".join(f"bit_count(x & {_signed(m)}) <= {n}" for m, n in zip(c[lead - 1 :], budgets[lead - 1 :], strict=True)) + ")"
        for c in chains
    )
    near = pairs.distinct().where(within).where(f"bit_count(x) <= {max_diff}").select("a", "b")

    free = "CASE block.ring " + " ".join(f"WHEN {i} THEN {_signed((1 << BITS) - 1 - c[lead - 1])}" for i, c in enumerate(chains)) + " END"
    spread = large.select("fp", F.expr(free).alias("free"), F.col("fp").alias("at"), F.lit(-1).alias("last"))
    reached = spread
    for _ in range(max_diff // 2):
        flips = F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), i -> i > last AND (shiftright(free, i) & 1L) = 1L)"))
        spread = spread.select("fp", "free", "at", flips.alias("last")).withColumn("at", F.expr("at ^ shiftleft(1L, last)"))
        reached = reached.unionByName(spread)
    meet = reached.groupBy("at").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    met = meet.select(F.expr("array_min(all)").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return near.unionByName(met)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_diff: int = 2, segments: int = 5
) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_key``, ``fp`` (signed long) and ``component``, the
    smallest id whose fingerprint can be reached by links of at most ``max_diff`` bits.

    Equal fingerprints are one node, so copies cost one row each and make no pairs. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows give repeated result rows; a
    null id takes part, but names a component only if there is no other. Other columns are not read.
    """
    return _rooted(docs, id_col, text, shingle, max_diff, segments).drop("root")


def _rooted(docs: DataFrame, id_col: str, text: str, shingle: int, max_diff: int, segments: int) -> DataFrame:
    """``near_duplicates`` with ``root``, the fingerprint that names the component whatever its ids."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), key)
    slim = cut(with_fingerprint(slim, "text", "fp", shingle).select("id", "text_key", "fp"))
    nodes = cut(slim.groupBy("fp").agg(F.min("id").alias("first")))
    parts = connected_components(near_links(nodes.select("fp"), max_diff, segments))
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of_fp = named.join(least, "root").select("fp", "component", "root")
    return slim.join(of_fp, "fp").select("id", "text_key", "fp", "component", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, max_diff: int = 2, segments: int = 5) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: that of the smallest id (a null id
    only where there is no other), and of several texts with that id the one of least hash."""
    return keep_first(docs, _rooted(docs, id_col, text, shingle, max_diff, segments), id_col, text)
