"""Relational sources: tables or queries as records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T


@dataclass
class TableSpec:
    """How rows of a query become records: `id_template` names columns in braces."""

    query: str
    id_template: str
    text_column: str
    mtime_column: str | None = None
    metadata_columns: list[str] = field(default_factory=list)
    salt: str = ""
    text_normalizer: str | None = None


def read_jdbc(spark: SparkSession, url: str, spec: TableSpec, fetch: int = 500, **options: str) -> DataFrame:
    """The rows of the query over JDBC; give partitionColumn, bounds and numPartitions as options to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=spec.query, fetchsize=str(fetch), **options).load()


def table_records(rows: DataFrame, spec: TableSpec, source: str, source_type: str = "pg_message") -> DataFrame:
    """Rows as records with their text; ids fill the template, hashes cover the text under the salt."""
    parts, rest = [], spec.id_template
    while "{" in rest:
        lead, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(lead), F.col(name).cast("string")]
    local = F.concat(*parts, F.lit(rest))
    meta = F.create_map(*[x for c in spec.metadata_columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]) if spec.metadata_columns else F.create_map().cast("map<string,string>")
    mtime = F.unix_micros(F.col(spec.mtime_column).cast("timestamp")) / 1e6 if spec.mtime_column else F.lit(0.0)
    text = F.coalesce(F.col(spec.text_column).cast("string"), F.lit(""))
    return rows.select(F.concat(F.lit(f"{source}::"), local).alias("doc_id"), F.lit(source_type).alias("source_type"), local.alias("natural_key"), mtime.alias("mtime"), F.octet_length(text).cast("long").alias("size"), meta.alias("metadata"), T.change_hash(text, spec.salt).alias("change_hash"), text.alias("text"))
