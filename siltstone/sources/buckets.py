"""A keyed table in buckets: a write touches the buckets of its keys and no others.

Rows lie in folders by a hash of their key, and Spark replaces the folders that a write has rows for (dynamic partition overwrite).
Readers ask for keys by bucket, so other folders are not listed, and within a bucket rows are sorted by key. It keeps one state, without
versions: where those are needed (promotion, tags, recovery) there is SnapshotTable. Writers of the same bucket must take turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.numbering import checkpointed
from siltstone.sources.snapshots import evolved


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", buckets: int = 64):
        """buckets is the table's for good; a bucket should hold what one task can rewrite (some 100 MB)."""
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/_SUCCESS"))

    def read(self) -> DataFrame:
        """All rows; columns that were added later are null in rows of before."""
        return self.spark.read.option("mergeSchema", True).parquet(self.root).drop("bucket")

    def _in(self, touched: Sequence[int]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.root).where(F.col("bucket").isin(list(touched))).drop("bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of keys, of which there are no more than the table has."""
        return [r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]

    def rows(self, keys: Sequence) -> DataFrame:
        """Rows of a few keys: their buckets alone are listed, and of them the row groups that may hold one."""
        some = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {self.read().schema[self.key].dataType.simpleString()}")
        return self._in(self._touched(some)).where(F.col(self.key).isin(list(keys)))

    def _write(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """The rows in place of what stood in these buckets."""
        spread = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        if not self.exists():
            self._fs.create(self._path(f"{self.root}/_SUCCESS"), True).close()
        # A bucket that has lost its last row is not among those written.
        left = {r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()} if touched else set()
        for b in set(touched) - left:
            self._fs.delete(self._path(f"{self.root}/bucket={b}"), True)

    def replace(self, rows: DataFrame) -> None:
        self._write(rows, range(self.buckets) if self.exists() else [])

    def _change(self, keys: DataFrame, change) -> None:
        """Rewrites the buckets of keys (a column of the table's key) by a function of their rows; the new rows are set down first, as they come from what they replace."""
        touched = self._touched(keys)
        if touched:
            self._write(checkpointed(change(self._in(touched))), touched)

    def upsert(self, new: DataFrame) -> None:
        """All rows of the keys in `new` are replaced."""
        if not self.exists():
            return self.replace(new)
        self._change(new, lambda old: evolved(old.join(new.select(self.key).distinct(), self.key, "left_anti"), new))

    def insert_missing(self, new: DataFrame) -> None:
        """Rows of keys that are not there yet; a second time adds nothing and writes nothing."""
        if not self.exists():
            return self.replace(new)
        fresh = checkpointed(new.join(self._in(self._touched(new)).select(self.key).distinct(), self.key, "left_anti"))
        self._change(fresh, lambda old: evolved(old, fresh))

    def delete(self, keys: DataFrame) -> None:
        if self.exists():
            self._change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def compare_and_set(self, value, expected: Column, changes: dict[str, Column]) -> bool:
        """Changes the row of a key if it is as expected; says whether it was."""
        if self.rows([value]).where(expected).limit(1).count() == 0:
            return False
        hit = (F.col(self.key) == value) & expected
        one = self.rows([value]).select(self.key)
        self._change(one, lambda old: old.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in changes.items()}))
        return True
