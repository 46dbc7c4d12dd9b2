"""``spark.read.format("claims")``: files of claims as a source, at once or as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file of lines that one task reads; bytes read at a time to find the end of a line.
SPLIT_BYTES, STEP_BYTES = 32 << 20, 1 << 16
#: A row is a claim (JSON), or what could not be read (torn); ``offset`` is where its line begins.
SCHEMA = "file string, offset long, nth int, claim string, torn string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("nth", pa.int32()), ("claim", pa.string()), ("torn", pa.string())])


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin from ``start`` and before ``end``; of a document of JSON, all of it."""

    file: str
    start: int
    end: int
    lines: bool

    def __init__(self, file: str, start: int, end: int, lines: bool) -> None:
        self.file, self.start, self.end, self.lines = file, start, end, lines


def _found(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Files of claims at ``path`` (a file or a folder, with all below it) by name; hidden ones are none."""
    files, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = files.get_file_info(place)
    some = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(place, recursive=True))
    kept = [f for f in some if f.type == pafs.FileType.File and f.base_name.endswith((".json", ".jsonl")) and not f.base_name.startswith((".", "_"))]
    return files, sorted(kept, key=lambda f: f.path)


def _claims(text: bytes, file: str, offset: int) -> Iterator[tuple]:
    """The claims of a line or document: an object, a list of them, or an object with a list of ``claims``."""
    if not text.strip():
        return
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    some = data.get("claims", [data]) if isinstance(data, dict) else data
    if not isinstance(some, list) or not all(isinstance(c, dict) for c in some):
        yield file, offset, 0, None, text.decode("utf-8", "replace")
        return
    for nth, claim in enumerate(some):
        yield file, offset, nth, json.dumps(claim, ensure_ascii=False), None


def _lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line) of the lines that begin in the range. One that begins before it is another piece's."""
    at, held = max(start - 1, 0), b""
    stream.seek(at)
    skip = start > 0  # up to the first line feed from the byte before the range on
    while True:
        data = stream.read(STEP_BYTES)
        held += data
        while (stop := held.find(b"\n")) >= 0 or (not data and held):
            stop = stop if stop >= 0 else len(held) - 1
            line, held = held[: stop + 1], held[stop + 1 :]
            if not skip:
                if at >= end:
                    return
                yield at, line
            skip, at = False, at + len(line)
        if not data or (at >= end and not skip):
            return


def _rows(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    files, _ = _found(path)
    held: list[tuple] = []
    with files.open_input_file(piece.file) as stream:
        lines = _lines(stream, piece.start, piece.end) if piece.lines else [(0, stream.read())]
        for offset, line in lines:
            held += _claims(line, piece.file, offset)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Piece]:
        out = []
        for f in _found(self.path)[1]:
            lines = f.base_name.endswith(".jsonl")
            out += [Piece(f.path, at, min(at + self.split, f.size), lines) for at in range(0, f.size, self.split if lines else max(f.size, 1))]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is how far each file is read: up to its last line feed, so a line that is being written waits.

    A document of JSON counts when it can be parsed, and again when its size changes.
    """

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, found = _found(self.path)
        out = {}
        for f in found:
            with files.open_input_file(f.path) as stream:
                if f.base_name.endswith(".jsonl"):
                    end = f.size
                    while end > 0:
                        step = min(STEP_BYTES, end)
                        stream.seek(end - step)
                        if (feed := stream.read(step).rfind(b"\n")) >= 0:
                            end = end - step + feed + 1
                            break
                        end -= step
                else:
                    try:
                        json.loads(stream.read())
                        end = f.size
                    except ValueError:
                        end = 0
            if end:
                out[f.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for file, to in sorted(end.items()):
            since, lines = start.get(file, 0), file.endswith(".jsonl")
            if lines:
                out += [Piece(file, at, min(at + self.split, to), True) for at in range(since, to, self.split)]
            elif since != to:
                out.append(Piece(file, 0, to, False))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ClaimFiles(DataSource):
    """Options: ``path`` (a file or folder of .jsonl and .json) and ``splitBytes``. Files of lines are read in ranges by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "claims"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("format claims needs a path")
        return self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._options())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ClaimFiles)
