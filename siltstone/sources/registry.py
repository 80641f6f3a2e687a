"""The document registry as tables: upserts with an audit trail, tombstones, minted ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import base62
from siltstone.operators.numbering import numbered


def upsert(registry: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, events): rows of `seen` (doc_id, path, source_name, …) replace or join it; new ones are `registered`, others at another path `moved`.

    A source name that is not given stays as it was.
    """
    old = registry.select("doc_id", F.col("path").alias("_p"), F.col("source_name").alias("_s"), F.col("created").alias("_c"))
    both = seen.join(old, "doc_id", "left")
    new = both.withColumn("source_name", F.coalesce(F.nullif(F.col("source_name"), F.lit("")), "_s")).withColumn("created", F.coalesce("_c", "created"))
    kind = F.when(F.col("_c").isNull(), "registered").when(F.col("_p") != F.col("path"), "moved")
    events = both.select("doc_id", kind.alias("action"), F.col("path").alias("detail")).where("action is not null")
    kept = registry.join(seen.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(new.select(*registry.columns)), events


def retire(registry: DataFrame, retired: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, retired): keys go, their ids are never minted again; a key is a full id, or what stands after its source."""
    bare = F.regexp_replace("doc_id", r"^.*?::", "")
    k = keys.select(F.col("doc_id").alias("k")).distinct()
    exact = registry.join(k, registry.doc_id == k.k, "left_semi").select("doc_id")
    loose = registry.withColumn("_b", bare).join(k.join(exact.select(F.col("doc_id").alias("k")), "k", "left_anti"), F.col("_b") == F.col("k"), "left_semi").select("doc_id")
    gone = exact.unionByName(loose).distinct()
    return registry.join(gone, "doc_id", "left_anti"), retired.unionByName(gone.select("doc_id")).distinct()


def mint(new: DataFrame, registry: DataFrame, retired: DataFrame, start: int, order: str = "path") -> DataFrame:
    """Adds doc_id: counter values in base 62 that nothing has or had; new documents, in order.

    Ids come from a run of numbers as long as all that could be in the way, so one anti-join leaves enough. Both the new documents and the free ids are
    numbered by ranges, so no task sees all of them.
    """
    n = new.count()
    spark = new.sparkSession
    taken = registry.select(F.regexp_replace("doc_id", r"^.*?::", "").alias("id")).unionByName(retired.select(F.col("doc_id").alias("id"))).distinct()
    width = n
    while True:
        free = spark.range(start, start + width).select(F.col("id").alias("num"), base62(F.col("id")).alias("id")).join(taken, "id", "left_anti")
        if free.count() >= n:
            break
        width *= 2
    ids = numbered(free, ["num"], name="_r").select("_r", F.col("id").alias("doc_id")).where(F.col("_r") < n)
    return numbered(new, [order], name="_r").join(ids, "_r").drop("_r")


def mappings(registry: DataFrame, source: str | None = None) -> DataFrame:
    """(doc_id, path) of a source, ids with their source's name."""
    full = F.when((F.col("source_name") == "documents") | (F.instr("doc_id", "::") > 0), F.col("doc_id")).otherwise(F.concat_ws("::", "source_name", "doc_id"))
    own = registry if source is None else registry.where(F.col("source_name") == source)
    return own.select(full.alias("doc_id"), "path")


def rows(registry: DataFrame, doc_id: str | None = None, path: str | None = None, prefix: str | None = None, content_hash: str | None = None) -> DataFrame:
    """Registry rows by id, path, the beginning of a path or a hash; all of them without any."""
    for c, v in (("doc_id", doc_id), ("path", path), ("content_hash", content_hash)):
        registry = registry if v is None else registry.where(F.col(c) == v)
    return registry if prefix is None else registry.where(F.col("path").startswith(prefix))
