"""Sinks: duplicate archives, reports, run metadata, events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import archive_name
from siltstone.operators.numbering import numbered


class Log:
    """Rows that are only ever added, numbered through: a run appends its files and touches no others."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame, order: list[str]) -> None:
        """Adds rows with an id each: the next whole numbers, in order."""
        last = self.read().agg(F.max("id")).first()[0] if self.exists() else None
        numbers = numbered(rows, order, name="id")
        numbers.withColumn("id", F.col("id") + F.lit((last or 0) + 1)).select("id", *rows.columns).write.mode("append").parquet(self.path)


#: Folders of an archive: their number is fixed, so that files do not grow with the documents that have duplicates.
FOLDERS = 16


def archive_duplicates(elected: DataFrame, path: str) -> None:
    """Rows of duplicates as JSON with the name of their canonical document, in folders by its hash."""
    dups = elected.where("dedupe_status = 'duplicate'").withColumn("canonical", archive_name(F.col("canonical_doc_id").cast("string")))
    dups.withColumn("folder", F.pmod(F.xxhash64("canonical"), F.lit(FOLDERS))).write.mode("append").partitionBy("folder").json(path)


def report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header and as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        df.write.mode("overwrite").json(f"{path}/{name}.json")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of a report, which has few rows, in Markdown."""
    rows = df.limit(most).collect()
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[clean(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def run_metadata(spark, path: str, values: dict) -> None:
    """One JSON row about a run."""
    spark.createDataFrame([(json.dumps(values, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def emit(df: DataFrame, send: Callable[[list[dict]], None], wanted: set[str] | None = None, size: int = 100) -> None:
    """Events (name, payload map) to a callback in batches, where the partitions are; a failed call is a warning. Private keys stay back."""
    some = df if wanted is None else df.where(F.col("name").isin(sorted(wanted)))
    public = some.select("name", F.map_filter("payload", lambda k, v: ~k.startswith("_")).alias("payload"))

    def post(rows):
        import warnings

        batch = []

        def flush():
            try:
                if batch:
                    send(list(batch))
            except Exception as e:  # a hook never stops a run
                warnings.warn(f"event sink: {e}", stacklevel=1)
            batch.clear()

        for r in rows:
            batch.append(r.asDict())
            if len(batch) >= size:
                flush()
        flush()

    public.foreachPartition(post)
