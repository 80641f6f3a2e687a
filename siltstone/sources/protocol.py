"""Sources: what can be scanned and extracted, and how a configuration names one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.providers import Registry, normalizer
from siltstone.functions.text import name_with_id
from siltstone.sources import files, tables


class Source(Protocol):
    """A named collection: scan lists its records, extract adds their text, close lets go of what it holds."""

    name: str

    def scan(self) -> DataFrame: ...

    def extract(self, records: DataFrame) -> DataFrame: ...

    def close(self) -> None: ...


@dataclass
class FilesystemSource:
    """Files below a folder; plug-ins read the types that have no reader here. A file that cannot be one of the index has a skip_reason."""

    spark: SparkSession
    name: str
    root: str
    include: Sequence[str] = ("**/*",)
    exclude: Sequence[str] = ()
    plug_ins: Mapping[str, Callable[[pd.Series], pd.Series]] = field(default_factory=dict)
    least: int = 1

    def _files(self, contents: bool) -> DataFrame:
        return files.scan(self.spark, self.root, self.include, self.exclude, contents)

    def scan(self) -> DataFrame:
        some = self._files(True)
        out = files.records(some, self.name).withColumn("rel_path", F.col("natural_key"))
        return out.withColumn("skip_reason", F.when(F.col("size") < self.least, "empty_file")).orderBy("rel_path")

    def extract(self, records: DataFrame) -> DataFrame:
        text = files.extract_text(self._files(True), self.plug_ins).select("rel_path", "text", "frontmatter")
        return records.join(text, "rel_path")

    def close(self) -> None:
        return None

    def names_with_ids(self, records: DataFrame) -> DataFrame:
        """(rel_path, wanted): the names that files have once their ids are in them."""
        return records.select("rel_path", name_with_id(F.col("rel_path"), F.col("doc_id")).alias("wanted"))


@dataclass
class TableSource:
    """Rows of queries over JDBC, or of a frame that stands for one; participants name the people in mentions."""

    spark: SparkSession
    name: str
    url: str
    specs: Sequence[tables.TableSpec]
    rows: Callable[[tables.TableSpec], DataFrame] | None = None
    participants: DataFrame | None = None

    def scan(self) -> DataFrame:
        out = None
        for spec in self.specs:
            rows = self.rows(spec) if self.rows else tables.read_jdbc(self.spark, self.url, spec)
            fix = normalizer(spec.text_normalizer)
            one = tables.table_records(fix(rows, self.participants), spec, self.name)
            out = one if out is None else out.unionByName(one)
        return out

    def extract(self, records: DataFrame) -> DataFrame:
        return records  # texts come with the rows

    def close(self) -> None:
        return None


SOURCES: Registry[Callable[..., Source]] = Registry("source type")


def _filesystem(spark: SparkSession, config: Mapping) -> Source:
    scan = config.get("scan", {})
    return FilesystemSource(spark, config["name"], config["root"], scan.get("include", ["**/*"]), scan.get("exclude", []), config.get("plug_ins", {}))


def _postgres(spark: SparkSession, config: Mapping) -> Source:
    return TableSource(spark, config["name"], config["dsn"], [tables.TableSpec(**t) for t in config.get("tables", [])], config.get("rows"), config.get("participants"))


SOURCES.add("filesystem", _filesystem)
SOURCES.add("postgres", _postgres)


def build_source(spark: SparkSession, config: Mapping) -> Source:
    """A source from its entry of a configuration: {type, name, …}; an unknown type is a ValueError, a missing key a KeyError."""
    return SOURCES.get(config.get("type"))(spark, config)


def union(sources: Sequence[Source]) -> DataFrame:
    """The records of several sources, their ids in the names of the sources."""
    return files.union_sources({s.name: s.scan() for s in sources})
