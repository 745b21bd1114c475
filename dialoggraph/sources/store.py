"""A table of sessions that is replaced session by session, all or nothing.

Rows lie in folders by hash of the session.  A replacement writes the folders it touches anew, under
a version of their own, and then a pointer: one small file that names the version of every folder.
Readers follow the last pointer, so a write that fails or is killed leaves the store as it was, and
one that succeeds is seen as a whole.  The pointer's number makes writers exclude each other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_pointers"


class ConcurrentWrite(RuntimeError):
    """Another writer moved the pointer since this one read it."""


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM's objects: any store Spark can write to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = files(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that is there as a whole or not at all; False if another one is there already."""
    folder, _, name = path.rpartition("/")
    fs, aside = files(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    _, place = files(spark, path)
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, False)
        return False
    return True


def merged_sessions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new, and of all sessions that new does not have; columns by name, missing ones null."""
    kept = stored.join(new.select("session_id").distinct(), "session_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class SessionStore:
    """Rows with a ``session_id`` under ``path``, in ``buckets`` folders."""

    spark: SparkSession
    path: str
    buckets: int = 256

    def _pointer(self) -> tuple[int, dict[str, str]]:
        """Number and content of the last pointer; at most ``buckets`` entries."""
        fs, folder = files(self.spark, f"{self.path}/{POINTERS}")
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=0)
        if not last:
            return 0, {}
        return last, json.loads(read_text(self.spark, f"{self.path}/{POINTERS}/{last:012d}.json"))

    def _read(self, versions: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All rows as of the last pointer; None while nothing is stored."""
        return self._read(self._pointer()[1])

    def replace(self, rows: DataFrame) -> int:
        """Sessions of ``rows`` are replaced, all others stay; the number of the new pointer."""
        number, versions = self._pointer()
        new = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int"))
        touched = {str(r["bucket"]) for r in new.select("bucket").distinct().collect()}
        stored = self._read({b: v for b, v in versions.items() if b in touched})
        if stored is not None:
            new = merged_sessions(stored, rows).withColumn(
                "bucket", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int"))
        version = f"v-{uuid.uuid4().hex}"
        # A folder becomes one file or, if it is large, several: AQE cuts the shuffle by size.
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        self._point(number + 1, versions | dict.fromkeys(touched, version))
        return number + 1

    def _point(self, number: int, versions: dict[str, str]) -> None:
        text = json.dumps(versions, sort_keys=True)
        if not write_once(self.spark, f"{self.path}/{POINTERS}/{number:012d}.json", text):
            raise ConcurrentWrite(f"pointer {number} of {self.path} is taken")
