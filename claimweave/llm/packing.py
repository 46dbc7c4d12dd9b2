"""Documents packed into sequences of so many tokens: bounded-space online best-fit."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from claimweave.llm.bpe import byte_symbols
from claimweave.llm.common import arrow_batches, cut, held_model

#: Open bins of a task, and how many tasks' open bins one task of the next round packs again.
OPEN_BINS, FAN_IN = 256, 8
#: Letters of a text encoded at a time, and bytes of ids in a batch of results.
BLOCK_CHARS, BATCH_BYTES = 1 << 18, 16 << 20
#: Fixed value: how the byte-level pre-tokenizer picks words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No word and no special token goes on over a space after a letter or digit.
_BREAK = re.compile(r"(?<=\w)(?= )")


class ByteBpe:
    """Ids as the tokenizers library gives for a byte-level BPE file, special tokens in the text included.

    The words are merged by tiktoken, four times as fast, from the ranks in the file. It gives up on runs of
    white space beyond its stack; such a block goes through the tokenizers library itself.
    """

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        made = [vocab["".join(p)] for p in pairs]
        if spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"] or made != sorted(made) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("not a plain byte-level BPE file whose ids follow its merges")
        byte = {c: b for b, c in byte_symbols().items()}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self._fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self._source, self._exact = source, None

    def _block(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self._exact is None:
                self._exact = Tokenizer.from_str(self._source)
                self._exact.no_truncation()
                self._exact.no_padding()
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> list[np.ndarray]:
        """Ids of a whole text, block by block; none for a null or empty one."""
        blocks, at = [], 0
        while text and at < len(text):
            stop = _BREAK.search(text, at + BLOCK_CHARS)
            end = stop.start() if stop else len(text)
            blocks.append(self._block(text[at:end]))
            at = end
        return blocks


class OpenBins:
    """Up to ``limit`` open bins. Bit s of ``free`` is set when some open bin has s free places."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.limit, self.open, self.free = limit, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.opened = capacity, 0

    def _take(self, space: int) -> int:
        found = self.by_free[space].pop()
        if not self.by_free[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int, int | None, bool]:
        """(bin, offset in it, a bin closed to make room, whether the bin is full now) for a piece of ``size``.

        The bin is the open one with the least free space that holds the piece. Where there is none a new bin
        opens, and if that is one too many, the fullest closes first.
        """
        closed, fitting = None, self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.limit and size < self.capacity:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            found, space, self.opened = self.opened, self.capacity, self.opened + 1
        left = space - size
        if left:
            self.by_free[left].append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.capacity - space, closed, not left


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece of a document: all but the first have ``capacity`` ids."""
    start, end = 0, len(ids) % capacity or min(capacity, len(ids))
    while start < end:
        yield start, ids[start:end]
        start, end = end, min(end + capacity, len(ids))


def _packed(rows: Iterable[tuple], capacity: int, limit: int, first: int, last: bool) -> Iterator[tuple]:
    """(row, sequence, offset, closed) of rows that end with their ids' bytes; the bins open at the end are ``last`` or wait."""
    bins, held = OpenBins(capacity, limit), {}
    for row in rows:
        to, offset, closed, full = bins.place(len(row[-1]) // 4)
        if closed is not None:
            yield from ((*r, first + closed, o, True) for r, o in held.pop(closed))
        held.setdefault(to, []).append((row, offset))
        if full:
            yield from ((*r, first + to, o, True) for r, o in held.pop(to))
    for to, rest in held.items():
        yield from ((*r, first + to, o, last) for r, o in rest)


def _batches(rows: Iterable[tuple], schema: pa.Schema, ids: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[ids]) + 64
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pack(df: DataFrame, path: str, columns: list[str], text: str = "text", capacity: int = 1024, end: int = 2, open_bins: int = OPEN_BINS) -> DataFrame:
    """The token ids of all documents, cut to pieces and packed into sequences of up to ``capacity`` ids.

    A document is the ids of its whole ``text`` (null and empty: none) by the byte-level BPE file at ``path``, then
    ``end``. One of more than ``capacity`` is cut into pieces of that many, the first shorter if need be. The result
    has one row a piece: ``columns`` of ``df``, ``__piece`` and ``__start`` in the document, ``__ids`` (unsigned
    little-endian 32 bits each), ``__sequence`` and ``__offset``, its place there. Places have no gaps.

    Each task packs what it reads, in the order it comes, with ``open_bins`` open bins. The sequences still open at its end
    are unpacked and packed again, ``FAN_IN`` tasks' in one, until one task has the rest, so the number of part-filled
    sequences does not grow with the tasks. Every round is a written table. Rows with null columns and repeated rows are
    documents like any other; other columns do not matter; an empty table gives none.
    """
    spark = df.sparkSession
    with open(path, encoding="utf-8") as f:
        source = f.read()
    held = spark.sparkContext.broadcast((hash(source), source))
    kept = [df.schema[c] for c in columns]
    schema = StructType([
        *kept, StructField("__piece", IntegerType()), StructField("__start", LongType()), StructField("__ids", BinaryType()),
        StructField("__sequence", LongType()), StructField("__offset", LongType()), StructField("__closed", BooleanType()),
    ])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    width = len(kept)

    def first_id(turn: int) -> int:
        return (turn << 56) + (TaskContext.get().partitionId() << 32)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe: ByteBpe = held_model(("byte bpe", held.value[0]), lambda: ByteBpe(held.value[1]))
        for batch in batches:
            for *keys, words in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([*bpe.encode(words), np.array([end], np.uint32)]).astype("<u4")
                for nth, (start, piece) in enumerate(pieces_of(ids, capacity)):
                    yield (*keys, nth, start, piece.tobytes())

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_packed(documents(batches), capacity, open_bins, first_id(0), False), arrow, width + 2)

    def pack_again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            yield from _batches(_packed(rows, capacity, open_bins, first_id(turn), last), arrow, width + 2)

        return run

    with arrow_batches(spark, 256):
        found = cut(df.select(*columns, F.col(text).alias("__text")).mapInArrow(pack_texts, schema))
    done = found.where("__closed")
    turn = 0
    while (bins := found.where("NOT __closed AND __offset = 0").count()) > 0:
        turn += 1
        tasks = -(-bins // (FAN_IN * open_bins))
        waiting = found.where("NOT __closed").select(*columns, "__piece", "__start", "__ids").repartition(tasks)
        with arrow_batches(spark, 4096):
            found = cut(waiting.mapInArrow(pack_again(turn, tasks == 1), schema))
        done = done.unionByName(found.where("__closed"))
    return done.drop("__closed")
