"""Helpers of the training-data operators: shared storage, text tokens, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java and RE2 character class; the complement forms words.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    sc = spark.sparkContext
    if (d := sc.getConf().get("spark.checkpoint.dir", None)) or (d := spark.conf.get("spark.checkpoint.dir", None)):
        return d.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Stored:
    """A table written to the shared folder, which cuts the lineage: lost executors cost nothing that was written.

    It lies in a folder of the application's id, to be deleted with the application, or earlier by scope().
    """

    def __init__(self, df: DataFrame, *partition_by: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/t-{uuid.uuid4().hex}"
        # Once the table is written nobody needs the shuffle files that led to it.
        before = spark.conf.get(_CLEAN, "false")
        spark.conf.set(_CLEAN, "true")
        try:
            df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(self.path)
        finally:
            spark.conf.set(_CLEAN, before)
        self.df = spark.read.schema(df.schema).parquet(self.path).select(*[F.col(f"`{c}`") for c in df.columns])
        if _scopes:
            _scopes[-1].append(self)

    def drop(self) -> None:
        """Deletes the files; the frame must not be read any more."""
        jvm = self.df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


_scopes: list[list[Stored]] = []


@contextmanager
def scope() -> Iterator[list[Stored]]:
    """Tables stored within are deleted at the end, but for those taken off the list; frames made within must not be read after."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for t in _scopes.pop():
            t.drop()


def outward(t: Stored, within: list[Stored]) -> DataFrame:
    """The frame of a table that stays when this scope ends, and goes with the one around it, if any."""
    within.remove(t)
    if len(_scopes) > 1:
        _scopes[-2].append(t)
    return t.df


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    return Stored(df, *partition_by).df


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def deltas(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as their differences, byte by byte, compressed."""
    d = np.diff(a, prepend=np.uint64(0)).astype(np.uint64)
    return pack(d.view(np.uint8).reshape(-1, 8).T)


def undeltas(b: bytes) -> np.ndarray:
    raw = unpack(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to (member, smallest member of its group) for each member that is not the smallest."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of a link (a, b) of longs; component is the smallest node it reaches.

    Smallest labels travel along the links and then along labels (pointer jumping), so the rounds grow with the
    logarithm of a chain. Links and labels stay distributed; each round is a table in the shared folder, and the
    only value that reaches the driver is the number of labels that changed.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).select(F.explode(ends).alias("e")).select("e.*").distinct())
    now = Stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        far = both.join(now.df.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
        # Each end also tells its present root, so whole trees hook on at once.
        own = far.join(now.df.select(F.col("node").alias("a"), F.col("component").alias("root")), "a")
        told = own.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "c"), F.struct(F.col("root").alias("node"), "c"))).alias("s")).select("s.*")
        low = told.groupBy("node").agg(F.min("c").alias("c"))
        new = now.df.join(low, "node", "left").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        up = new.select(F.col("node").alias("c"), F.col("c").alias("top"))
        nxt = Stored(new.join(up, "c", "left").select("node", F.least("c", "top").alias("component"), "old"))
        changed = nxt.df.where("component <> old").limit(1).count()
        now.drop()
        now = nxt
        if not changed:
            return now.df.select("node", "component")
