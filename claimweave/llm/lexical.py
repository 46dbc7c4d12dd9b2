"""Ranked lexical search: document at a time over compressed postings in shards, exact integer scores."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import arrow_batches, cut

#: Terms in a shard's texts from which it is closed, and query texts searched together.
SHARD_TERMS, BLOCK_ITEMS = 2_000_000, 128
#: Bytes of a side up to which it may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Term bytes in lower case, all others as spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("postings", pa.binary()), ("ids", pa.binary()), ("lengths", pa.binary())])


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters and digits and all other than ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def compress(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value's begin): seven bits a byte, lowest first, the top bit set on all but the last."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for n in range(1, 10):
        size += values >> np.uint64(7 * n) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for n in range(int(size.max(initial=0))):
        has = size > n
        out[at[:-1][has] + n] = (values[has] >> np.uint64(7 * n) & np.uint64(127)).astype(np.uint8) | (size[has] > n + 1).astype(np.uint8) << 7
    return out, at


def expand(data: bytes) -> np.ndarray:
    """The values that ``compress`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    nth = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * nth), starts)


class ShardWriter:
    """Postings of the documents of one shard: gaps of places in doc_id order and occurrences, in turns."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
            self.size += len(found)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row with the documents (null term), then one a term."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ids = np.array([self.ids[i] or 0 for i in order], np.int64)
        known = n - sum(i is None for i in self.ids)
        lengths = np.array(self.lengths, np.int64)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip([[shard], [None], [known], [self.size], [None], [ids.tobytes()], [lengths[order].tobytes()]], _INDEX)], schema=_INDEX)
        pairs = np.concatenate(self.terms).astype(np.int64) << 32 | np.repeat(place, lengths)
        self.terms.clear()
        pairs.sort()
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(pairs)]]))
        pairs = pairs[starts]
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        gaps = doc.copy()
        gaps[1:] -= doc[:-1]
        gaps[first] = doc[first]
        data, at = compress(np.column_stack([gaps, counts]).ravel())
        ends = np.concatenate([at[2 * first], [len(data)]])
        total = np.add.reduceat(counts, first)
        names, df = list(self.numbers), np.diff(np.concatenate([first, [len(doc)]]))
        for a in range(0, len(first), 50_000):
            b = min(a + 50_000, len(first))
            offsets = (ends[a : b + 1] - ends[a]).astype(np.int32)
            postings = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ends[a] : ends[b]].tobytes())])
            none = pa.nulls(b - a, pa.binary())
            yield pa.record_batch([pa.array(np.full(b - a, shard)), pa.array(names[a:b], pa.binary()).cast(pa.string()), pa.array(df[a:b]), pa.array(total[a:b]), postings, none, none], schema=_INDEX)


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of all terms of whole texts, a written table: shard, term, df, total (occurrences),
    postings, ids, lengths.

    A task makes shards of the rows that it reads, of ``SHARD_TERMS`` terms or the one text that passes them; nothing
    is shuffled. Its row without a term has the shard's documents that hold terms, by id (null ids last, ``df`` says how many
    are not null) and how many terms each has. Repeated rows are documents of their own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        shard = ShardWriter()
        for batch in batches:
            for key, words in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(key, words)
                if shard.size >= SHARD_TERMS:
                    yield from shard.rows(task + made)
                    shard, made = ShardWriter(), made + 1
        if shard.size:
            yield from shard.rows(task + made)

    with arrow_batches(df.sparkSession, 256):
        return cut(df.select(F.col(doc_id).cast("long"), text).mapInArrow(write, "shard long, term string, df long, total long, postings binary, ids binary, lengths binary"))


def best_documents(terms: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """(score, place) of the ``k`` best documents, best first, ties to the lower place.

    ``terms`` has each term's places in order, its scores there, and the highest of them. A heap holds the next place of each
    term and hands out places in order, so a document's score is whole before the next one's begins; the best so
    far stay in a heap of ``k``, worst on top. Terms that cannot lift a document over it by themselves, all together, leave
    the merge; they are only looked up in documents that another term proposes.
    """
    terms = sorted(terms, key=lambda t: t[2])
    bounds = np.cumsum([t[2] for t in terms]).tolist()
    at = [0] * len(terms)
    merge = [(t[0][0], nth) for nth, t in enumerate(terms)]
    heapq.heapify(merge)
    best: list[tuple[int, int]] = []
    least, out = 0, 0  # a score must pass ``least``; terms before ``out`` have left the merge
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            nth = merge[0][1]
            if nth < out:
                heapq.heappop(merge)
                continue
            places, scores, _ = terms[nth]
            i = at[nth]
            score += scores[i]
            at[nth] = i = i + 1
            if i < len(places):
                heapq.heapreplace(merge, (places[i], nth))
            else:
                heapq.heappop(merge)
        if not score:
            continue
        for nth in range(out - 1, -1, -1):
            if score + bounds[nth] <= least:
                break
            places, scores, _ = terms[nth]
            at[nth] = i = bisect_left(places, doc, at[nth])
            if i < len(places) and places[i] == doc:
                score += scores[i]
        if score > least:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k:
                least = best[0][0]
                while out < len(terms) and bounds[out] <= least:
                    out += 1
                if out == len(terms):
                    break
    return [(score, -place) for score, place in sorted(best, reverse=True)]


def _search_shard(docs: dict, postings: dict, n: int, total: int, k: int) -> tuple[list, ...]:
    """(item, rank in shard, doc_id, score) columns of a shard's best documents for a block of items."""
    ids, lengths, known = np.frombuffer(docs["ids"][0], np.int64), np.frombuffer(docs["lengths"][0], np.int64), docs["df"][0]
    m = 25 + 75 * lengths * n // total
    of_item: dict[int, list] = {}
    for data, users in zip(postings["postings"], postings["users"]):
        pairs = expand(data).reshape(-1, 2)
        places, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
        unit = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
        where, lists = places.tolist(), {}
        for user in users:
            weight = user["weight"]
            if weight > 0:
                if weight not in lists:
                    scores = unit * weight
                    lists[weight] = (where, scores.tolist(), int(scores.max()))
                of_item.setdefault(user["item"], []).append(lists[weight])
    found: tuple[list, ...] = ([], [], [], [])
    for item, terms in of_item.items():
        for rank, (score, place) in enumerate(best_documents(terms, k)):
            for column, value in zip(found, (item, rank, int(ids[place]) if place < known else None, score)):
                column.append(value)
    return found


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its strings and rows have been measured to be small, else unchanged (shuffled)."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``index`` for each text of ``items``: item_id, rank (from 1), doc_id, score.

    N counts the documents with a term, L their terms, n one document's, df the documents that hold a term, tf its
    occurrences in one. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); all else is of integers, rounded down. A
    document's m is 25 + 75 n N / L, its score the sum of w (10^9 tf) / (1000 tf + 8 m) over the text's terms, repeats
    included. Scores of 0 are none; equal scores go by doc_id, null last.

    Items that are alike in id and text are searched once; others of one id, each by itself. A null text finds nothing.
    Each shard is searched by itself, for a block of ``BLOCK_ITEMS`` items at a time; the results of all shards are merged.
    """
    about = index.where("term IS NULL").select("shard", "df", "ids", "lengths", "total")
    n, total = about.agg(F.sum(F.octet_length("ids") / 8).cast("long"), F.sum("total")).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(terms_of(words))
                yield pa.record_batch([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["item", "term", "times"])

    wanted = cut(asked.select("item", "text").mapInArrow(split, "item long, term string, times long"))
    postings = cut(index.join(_small(wanted.select("term").distinct()), "term").select("shard", "term", "df", "postings"))
    weight = F.floor(1000 * F.log((2.0 * (n or 0) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = postings.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight")).where("weight > 0")
    users = wanted.join(weights, "term").groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term")
    users = cut(users.agg(F.collect_list(F.struct("item", (F.col("weight") * F.col("times")).alias("weight"))).alias("users")))
    parts = postings.join(_small(users), "term").select("shard", "block", "postings", "users")
    shards = about.drop("total").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = pa.schema([("item", pa.int64()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def best(docs: pa.Table, terms: pa.Table) -> pa.Table:
        found = _search_shard(docs.to_pydict(), terms.select(["postings", "users"]).to_pydict(), n, total, k) if docs.num_rows and terms.num_rows else ([],) * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    found = cut(shards.groupBy("shard", "block").cogroup(parts.groupBy("shard", "block")).applyInArrow(best, "item long, rank int, doc_id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rank")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
