"""Helpers that the corpus operators share: cutting lineage, checked broadcasts, batch sizes."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which it may be broadcast; beyond that it is shuffled.
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in a local session that names none (as in tests) is a new temporary folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, so a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``cut`` wrote, and those of them that stages of pipelines worked with.
_WRITTEN: list[str] = []
_OF_STAGES: list[str] = []

def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _collect_garbage(spark: SparkSession) -> None:
    """Let go of shuffles and broadcasts that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing will read again, and the shuffles that went into them."""
    for df in tables:
        spark = df.sparkSession
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in _WRITTEN if p.rsplit("/", 1)[-1] in names]:
            _delete(spark, path)
            _WRITTEN.remove(path)
    _collect_garbage(tables[0].sparkSession)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """A stage of a pipeline that first deletes the tables that tidy stages before it worked with.

    The result of a stage must be written before the next one is called. Tables that ``docs`` itself reads stay, and so do
    all that were not written by stages. Shuffles that nothing refers to any more go as well.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = docs.inputFiles()
        for path in list(_OF_STAGES):
            name = path.rsplit("/", 1)[-1]
            if not any(name in f for f in used):
                _delete(spark, path)
                _OF_STAGES.remove(path)
        _collect_garbage(spark)
        start = len(_WRITTEN)
        out = stage(spark, docs, sf_dir)
        _OF_STAGES.extend(_WRITTEN[start:])
        return out

    return run


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be small, else unchanged (shuffled)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of each Arrow batch; texts of 100 KB and more are common in a corpus."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of so many rows and of up to 16 MB for what is written inside; the session's own limits come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """64-bit hash of a text, null-safe; with the id it names a row, fully repeated rows alike."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


#: The one model that this Python worker holds, by name.
_HELD: dict[Hashable, object] = {}


def held_model(name: Hashable, make: Callable[[], object]):
    """The named model, made once in a worker; it takes the place of any other, for workers outlive their tasks."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release_models() -> None:
    """Drop the model that an earlier stage left in this worker."""
    _HELD.clear()
