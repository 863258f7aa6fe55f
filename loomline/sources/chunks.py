"""A table of chunks that grows by commits: resumable, replaceable, compacted, looked up by key.

    path/data/<attempt>/part-*.parquet     chunks, sorted by key
    path/manifest/<attempt>                a row a chunk: file, rows, least and greatest key, digest
    path/commits/00000001, ...             one small file a version

A write stages its chunks and their manifest under an attempt's own name and then
publishes them by creating the next commit file, which the file system lets one
writer do only. What was staged and never published is not part of the table, so
a job killed anywhere leaves the table as it was, and a rerun writes what is
missing. Nothing published is ever overwritten: ``replace`` and ``compact`` publish
a new whole, the versions before it stay readable until ``vacuum``.

All rows of a key belong to one commit. Rows without a key are left out. Of two
writers at once, one gets the next version and the other a FileExistsError; its
staged rows may be published again with :meth:`publish`. On a store whose create
is not atomic, let one writer at a time publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knowledge import remaining

MANIFEST = "file string, rows long, least string, greatest string, digest long"


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str, key: str, chunk_rows: int = 1_000_000):
        self.spark, self.path, self.key, self.chunk_rows = spark, path.rstrip("/"), key, chunk_rows
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._at(f"{self.path}/commits"))

    # Versions

    def commits(self) -> list[dict]:
        """The commits of the table, in order; a commit file that isn't whole counts for nothing."""
        out = []
        for status in self._files.listStatus(self._at(f"{self.path}/commits")):
            stream = self._files.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("}"):
                out.append({"version": int(status.getPath().getName()), **json.loads(text)})
        return sorted(out, key=lambda c: c["version"])

    def version(self) -> int:
        return max((c["version"] for c in self.commits()), default=0)

    def _attempts(self, version: int | None) -> list[str]:
        """Those of the last whole version and of the additions since."""
        out: list[str] = []
        for commit in self.commits():
            if version is None or commit["version"] <= version:
                out = [commit["attempt"]] if commit["whole"] else [*out, commit["attempt"]]
        return out

    def manifest(self, version: int | None = None) -> DataFrame:
        """The chunks of a version."""
        parts = [self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{a}").withColumn("attempt", F.lit(a)) for a in self._attempts(version)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], MANIFEST + ", attempt string")

    # Writing

    def stage(self, df: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
        """Write chunks and their manifest under a new attempt's name; they are not part of the table yet.

        ``make`` derives what is written from the rows once they are in order, so it runs once for each.
        """
        attempt, key = uuid.uuid4().hex, F.col(self.key)
        rows = make(df.where(key.isNotNull()).repartitionByRange(key).sortWithinPartitions(key))
        folder = f"{self.path}/data/{attempt}"
        rows.write.option("maxRecordsPerFile", self.chunk_rows).parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder).withColumn("_file", F.col("_metadata.file_name"))
        each = written.groupBy(F.col("_file").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).cast("string").alias("least"), F.max(key).cast("string").alias("greatest"), F.bit_xor(F.xxhash64(*rows.columns)).alias("digest"),
        )
        each.write.parquet(f"{self.path}/manifest/{attempt}")
        return attempt

    def publish(self, attempt: str, whole: bool, seen: int) -> int:
        """Make a staged attempt the version after ``seen``."""
        version = seen + 1
        try:
            stream = self._files.create(self._at(f"{self.path}/commits/{version:08d}"), False)
        except Py4JJavaError as error:
            raise FileExistsError(f"version {version} of {self.path} was published by another writer") from error
        stream.write(json.dumps({"attempt": attempt, "whole": whole, "key": self.key}).encode())
        stream.close()
        return version

    def add(self, df: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Publish the rows whose keys are not in the table; run again after a failure, it writes what is missing."""
        seen = self.version()
        rows = remaining(df, self.read(seen), self.key) if self._chunks(seen) else df
        return self.publish(self.stage(rows, make), False, seen)

    def replace(self, df: DataFrame) -> int:
        """Publish ``df`` in place of the rows of the same keys; the version before stays as a backup."""
        seen = self.version()
        kept = remaining(self.read(seen), df, self.key).unionByName(df) if self._chunks(seen) else df
        return self.publish(self.stage(kept), True, seen)

    def compact(self) -> int:
        """Publish the same rows as chunks of full size, all in the order of the key."""
        seen = self.version()
        return self.publish(self.stage(self.read(seen)), True, seen) if self._chunks(seen) else seen

    def vacuum(self, keep: int = 1) -> int:
        """Delete attempts that none of the last ``keep`` versions reads, staged ones too; no other writer may be at work. Returns how many went."""
        used = {a for c in self.commits()[-keep:] for a in self._attempts(c["version"])}
        there = {s.getPath().getName() for part in ("data", "manifest") if self._files.exists(self._at(f"{self.path}/{part}")) for s in self._files.listStatus(self._at(f"{self.path}/{part}"))}
        for attempt in there - used:
            for part in ("data", "manifest"):
                self._files.delete(self._at(f"{self.path}/{part}/{attempt}"), True)
        return len(there - used)

    def remove(self, part: str) -> None:
        """Delete a folder beside the table's own."""
        if part in ("data", "manifest", "commits"):
            raise ValueError(part)
        self._files.delete(self._at(f"{self.path}/{part}"), True)

    # Reading

    def _chunks(self, version: int | None) -> list[str]:
        """Paths of a version's chunks; a Spark driver lists the files it reads in any case."""
        return [f"{self.path}/data/{r.attempt}/{r.file}" for r in self.manifest(version).select("attempt", "file").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        chunks = self._chunks(version)
        if not chunks:
            raise FileNotFoundError(f"no rows in {self.path}")
        return self.spark.read.parquet(*chunks)

    def verify(self, version: int | None = None) -> DataFrame:
        """Chunks whose rows are not those that were published."""
        rows = self.read(version)
        now = rows.withColumn("_file", F.col("_metadata.file_name")).groupBy(F.col("_file").alias("file")).agg(F.bit_xor(F.xxhash64(*rows.columns)).alias("now"), F.count(F.lit(1)).alias("rows_now"))
        return self.manifest(version).join(now, "file", "left").where("not (digest <=> now) or not (rows <=> rows_now)")

    def holding(self, keys: DataFrame, version: int | None = None) -> list[str]:
        """The chunks whose range of keys has one of ``keys``; the ranges are broadcast, the keys stay where they are."""
        rows = self.manifest(version).select("attempt", "file", "least", "greatest").collect()
        if not rows:
            return []
        ranges = self.spark.sparkContext.broadcast((np.array([r.least.encode() for r in rows], object), np.array([r.greatest.encode() for r in rows], object)))

        def wanted(batches):
            need = np.zeros(len(ranges.value[0]), bool)
            for batch in batches:
                asked = np.sort(np.array([v.as_py().encode() for v in batch.column(0)], object))
                need |= np.searchsorted(asked, ranges.value[0], "left") < np.searchsorted(asked, ranges.value[1], "right")
            yield pa.RecordBatch.from_pydict({"chunk": np.flatnonzero(need)})

        found = keys.select(F.col(self.key).cast("string")).where(F.col(self.key).isNotNull()).mapInArrow(wanted, "chunk long").distinct().collect()
        return [f"{self.path}/data/{rows[r.chunk].attempt}/{rows[r.chunk].file}" for r in found]

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of ``keys``, from the chunks that can hold them only. The table's key is a string."""
        if dict(keys.dtypes)[self.key] != "string":
            raise TypeError("ranges of keys are those of strings")
        chunks = self.holding(keys, version)
        if not chunks:
            return self.read(version).limit(0)
        return self.spark.read.parquet(*chunks).join(keys.select(self.key).distinct(), self.key, "left_semi")
