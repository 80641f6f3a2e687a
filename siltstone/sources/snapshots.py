"""A versioned table on plain files: every write is a new version, a pointer names the current one.

Versions live in `v=<n>` below the root; readers resolve the pointer once per query, writers write a whole version
and then add a pointer of the next number, which only one writer can claim. All access goes through Spark's file systems, so any store will do.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds after which a claim without a pointer is that of a writer that has died.
STALE = 600.0


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: once a table is there nobody needs those that led to it."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return self.spark.read.text(p.toString()).first()[0]

    def _write_text(self, name: str, value: str) -> None:
        """A small file (a tag) with a value."""
        tmp, to = self._path(f"{self.root}/.{name}.new"), self._path(f"{self.root}/{name}")
        out = self._fs.create(tmp, True)
        out.write(value.encode())
        out.close()
        self._fs.delete(to, False)
        self._fs.rename(tmp, to)

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, of which the largest counts; readers always find one."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [re.fullmatch(r"CURRENT-(\d+)-(\d+)", s.getPath().getName()) for s in self._fs.listStatus(self._path(self.root))]
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [re.fullmatch(r"v=(\d+)", s.getPath().getName()) for s in self._fs.listStatus(self._path(self.root))]
        done = [int(m[1]) for m in found if m and self._fs.exists(self._path(f"{self.root}/{m[0]}/_SUCCESS"))]
        return sorted(done)

    def current(self) -> int | None:
        found = self._pointers()
        return found[-1][1] if found else None

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no version in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={v}")

    def recover(self) -> DataFrame:
        """The newest version that can be read; the pointer moves to it."""
        for v in reversed(self.versions()):
            try:
                df = self.read(v)
                df.limit(1).collect()
            except (PySparkException, Py4JJavaError):  # missing or broken files
                continue
            self.promote(v)
            return df
        raise FileNotFoundError(f"no readable version in {self.root}")

    def write_shadow(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A version that readers do not see until it is promoted."""
        # A number is claimed by its folder, so two writers never write to the same one.
        v = max([0, *self.versions()]) + 1
        while not self._fs.mkdirs(self._path(f"{self.root}/v={v}")) or not self._own(v):
            v += 1
        w = df.write.mode("append").option("compression", "zstd")
        with tidy(self.spark):
            (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/v={v}")
        return v

    def _own(self, v: int) -> bool:
        try:
            self._fs.create(self._path(f"{self.root}/.version-{v}"), False).close()
        except Py4JJavaError:
            return False
        return True

    def promote(self, version: int, expected: int | None = -1) -> bool:
        """Makes a version the current one; where an expected version is given, only if that is current still.

        A pointer is a new empty file named by its number and version. Creating it fails if another writer had the
        number first, so of two writers that expect the same version one loses. A crash leaves the pointer before.
        """
        found = self._pointers()
        if expected != -1 and (found[-1][1] if found else None) != expected:
            return False
        n = found[-1][0] + 1 if found else 1
        while not self._claimed(n):
            # A writer that has died leaves a claim without a pointer; one that is at work is about to add it.
            if expected != -1 and self._age(n) < STALE:
                return False
            n += 1
        if expected != -1 and (now := self._pointers()) and now[-1][1] != expected:
            return False
        self._fs.create(self._path(f"{self.root}/CURRENT-{n}-{version}"), True).close()
        for old, v in found[:-1]:  # the one before stays for readers that listed it
            self._fs.delete(self._path(f"{self.root}/CURRENT-{old}-{v}"), False)
        return True

    def _age(self, n: int) -> float:
        """Seconds since a number was claimed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/.claim-{n}")).getModificationTime() / 1000

    def _claimed(self, n: int) -> bool:
        """Whether this writer is the first to claim a pointer's number."""
        try:
            self._fs.create(self._path(f"{self.root}/.claim-{n}"), False).close()
        except Py4JJavaError:  # it is there already
            return False
        return True

    restore = promote

    def replace(self, df: DataFrame) -> int:
        v = self.write_shadow(df)
        self.promote(v)
        return v

    def upsert(self, new: DataFrame, key: str = "doc_id", gone: DataFrame | None = None) -> int:
        """All rows of the documents in `new`, or else of those in `gone`, are replaced; columns that are new are empty in old rows."""
        if self.current() is None:
            return self.replace(new)
        old = self.read().join((new if gone is None else gone).select(key).distinct(), key, "left_anti")
        return self.replace(evolved(old, new))

    def insert_missing(self, new: DataFrame, key: str = "doc_id") -> int:
        """Rows of documents that are not there yet; a second time adds nothing."""
        if self.current() is None:
            return self.replace(new)
        old = self.read()
        return self.replace(evolved(old, new.join(old.select(key).distinct(), key, "left_anti")))

    def delete(self, keys: DataFrame, key: str = "doc_id") -> int:
        return self.replace(self.read().join(keys.select(key).distinct(), key, "left_anti"))

    def compare_and_set(self, value: str, expected: Column, changes: dict[str, Column], field: str = "chunk_uid") -> bool:
        """Changes one row if it still is as expected, and if nobody has written meanwhile; says whether it was changed."""
        seen = self.current()
        old = self.read(seen)
        hit = (F.col(field) == value) & expected
        if old.where(hit).limit(1).count() == 0:
            return False
        made = self.write_shadow(old.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in changes.items()}))
        return self.promote(made, expected=seen)

    def tag(self, name: str, version: int | None = None) -> None:
        self._write_text(f"tag-{name}", str(self.current() if version is None else version))

    def tags(self) -> dict[str, int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return {n[4:]: int(self._read_text(n)) for n in names if n.startswith("tag-")}

    def prune(self, older_than: float = 1800.0, now: float | None = None) -> list[int]:
        """Deletes versions older than that which are neither current nor tagged."""
        kept = {self.current(), *self.tags().values()}
        gone = []
        for v in self.versions():
            p = self._path(f"{self.root}/v={v}")
            age = (time.time() if now is None else now) - self._fs.getFileStatus(p).getModificationTime() / 1000
            if v not in kept and age >= older_than:
                self._fs.delete(p, True)
                gone.append(v)
        return gone

    def compact(self, files: int) -> int:
        """The same rows in fewer files."""
        return self.replace(self.read().coalesce(files))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both with all columns; text that a side lacks is empty, not null."""
    both = old.unionByName(new, allowMissingColumns=True)
    kinds = dict(both.dtypes)
    lacking = (set(old.columns) ^ set(new.columns)) & {c for c, t in kinds.items() if t == "string"}
    return both.na.fill("", sorted(lacking)) if lacking else both


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares: spark.checkpoint.dir, or else the warehouse."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder; the cluster's own stays."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
