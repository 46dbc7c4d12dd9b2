"""Stored tables that are replaced as a whole or not at all: staged beside, counted, swapped by one rename."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Store:
    """A table of rows by ``key`` (such as a report) in a folder, dealt to ``buckets`` by the key's hash.

    A bucket's rows are plain Parquet files in ``bucket=b/gen-n``, and the highest n counts. A writer fills a folder that no reader
    looks at, compares the rows there with those it sent, and renames it to the next n. So a reader sees
    all of a key's old rows or all of its new ones, a writer that fails leaves what was there, and of two writers to a bucket
    the later one fails, for the name is taken. The generation before stays for readers that have begun. The file system
    must rename a folder in one step, as HDFS and local disks do.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    def _files(self):
        """(file context, path of a name below the folder) of the folder's file system, wherever it is."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs
        return fs.FileContext.getFileContext(fs.Path(self.path).toUri(), conf), lambda name="": fs.Path(f"{self.path}/{name}" if name else self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.hash(F.col(self.key).cast("string")), F.lit(self.buckets))

    def _names(self, folder: str = "") -> list[str]:
        files, at = self._files()
        if not files.util().exists(at(folder)):
            return []
        return [s.getPath().getName() for s in files.util().listStatus(at(folder))]

    def generations(self) -> dict[int, int]:
        """The generation that counts of each bucket that was ever written."""
        found = {}
        for name in self._names():
            if name.startswith("bucket="):
                numbers = [int(g[4:]) for g in self._names(name) if g.startswith("gen-")]
                if numbers:
                    found[int(name[7:])] = max(numbers)
        return found

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some; none if nothing was written yet."""
        paths = [f"{self.path}/bucket={b}/gen-{n:09d}" for b, n in sorted(self.generations().items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, new: DataFrame, keys: DataFrame | None = None, ids: list[str] | None = None) -> int:
        """Put the rows of ``new`` in the place of those of the same keys, and of those of ``keys`` (which may have no
        new rows, so theirs go); returns how many rows the touched buckets have. Without any key nothing changes.
        With ``ids`` only rows of the same key and ids give way, so a key's rows can come bit by bit.

        Rows without a key are refused. Only touched buckets are read and written.
        """
        new = new.select([F.col(f.name).cast(f.dataType) for f in self.schema])
        by = [self.key, *(ids or [])]
        gone = new.select(by)
        gone = (gone if keys is None else gone.unionByName(keys.select([F.col(c).cast(self.schema[c].dataType) for c in by]))).distinct()
        touched = {r[0] for r in gone.select(F.when(F.col(self.key).isNotNull(), self._bucket())).distinct().collect()}
        if None in touched:
            raise ValueError(f"a row has no {self.key}")
        if not touched:
            return 0
        before = self.generations()
        stay = self.read(touched).join(gone, by, "left_anti").select(self.schema.names)
        stage = f"_staged-{uuid.uuid4().hex}"
        sent = Observation()
        rows = stay.unionByName(new).withColumn("bucket", self._bucket()).observe(sent, F.count(F.lit(1)).alias("rows"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{stage}")
        try:
            count = sent.get["rows"]
        except (Py4JJavaError, KeyError):
            count = 0  # an input that turns out to be empty is not run, so nothing is observed
        return self._publish(stage, touched, before, count)

    def _publish(self, stage: str, touched: set[int], before: dict[int, int], sent: int) -> int:
        files, at = self._files()
        full = {int(n[7:]) for n in self._names(stage) if n.startswith("bucket=")}
        written = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{stage}/bucket={b}" for b in sorted(full))).count() if full else 0
        if written != sent:
            raise OSError(f"{written} rows staged of {sent}")
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        anyone = self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault()
        for b in sorted(touched):
            if b not in full:
                files.mkdir(at(f"{stage}/bucket={b}"), anyone, True)
            if not files.util().exists(at(f"bucket={b}")):
                files.mkdir(at(f"bucket={b}"), anyone, True)
            files.rename(at(f"{stage}/bucket={b}"), at(f"bucket={b}/gen-{before.get(b, 0) + 1:09d}"), none)
        files.delete(at(stage), True)
        for b in touched:
            for name in self._names(f"bucket={b}"):
                if name.startswith("gen-") and int(name[4:]) < before.get(b, 0):
                    files.delete(at(f"bucket={b}/{name}"), True)
        return written
