"""Exact duplicates: identity, election of a canonical document, merges, content groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import identity


def with_identity(df: DataFrame, content: str) -> DataFrame:
    """Adds size_bytes and content_hash."""
    return df.withColumn("_i", identity(F.col(content))).select(*df.columns, "_i.size_bytes", "_i.content_hash")


def elect(df: DataFrame, order: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Adds canonical_doc_id and dedupe_status: the first seen of equal (size, hash) is canonical, the others are duplicates.

    The election is a minimum, combined before the shuffle, and joins back; no window has to hold a large group.
    """
    first = df.where("content_hash is not null").groupBy("size_bytes", "content_hash").agg(F.min(F.struct(*dict.fromkeys([*order, key]))).alias("first"))
    joined = df.join(first, ["size_bytes", "content_hash"], "left")
    canon = F.coalesce(F.col(f"first.{key}"), F.col(key))
    return joined.select(*df.columns, canon.alias("canonical_doc_id"), F.when(canon == F.col(key), "canonical").otherwise("duplicate").alias("dedupe_status"))


COHORT = ["size_bytes", "content_hash"]


def stranding_writes(elected: DataFrame, writes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of writes (key, size_bytes, content_hash): a canonical document with duplicates may not move to another identity, as they would point to nothing.

    Refused ones can go through reelected(), which gives the duplicates that stay behind a canonical of their own.
    """
    led = elected.where("dedupe_status = 'duplicate'").select(F.col("canonical_doc_id").alias("_c")).distinct()
    old = elected.join(led, elected[key] == F.col("_c"), "left_semi").select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in COHORT])
    moved = ~(F.col("_size_bytes").eqNullSafe(F.col("size_bytes")) & F.col("_content_hash").eqNullSafe(F.col("content_hash")))
    strands = (writes[key] == F.col("_k")) & moved
    return writes.join(old, strands, "left_anti"), writes.join(old, strands, "left_semi")


def reelected(elected: DataFrame, changes: DataFrame, order: Sequence[str], key: str = "doc_id") -> DataFrame:
    """What an election has to be changed by: rows of elect() with `op` (put or delete), for documents that are written (op put: key, size_bytes, content_hash, order) or deleted.

    Only the cohorts that a change leaves or joins vote again, and only rows with another outcome are given back. A canonical document that is still
    there stays canonical, whoever joins; where it has gone, the first of the others in order follows.
    """
    place = list(dict.fromkeys([*order, key]))
    new = changes.where("op = 'put'")
    left = elected.join(changes.select(key), key, "left_semi").select(*COHORT)
    touched = left.unionByName(new.select(*COHORT)).where("content_hash is not null").distinct()
    stays = elected.join(touched, COHORT, "left_semi").join(changes.select(key), key, "left_anti").select(*place, *COHORT, F.col("canonical_doc_id").alias("_c"), F.col("dedupe_status").alias("_s"))
    members = stays.unionByName(new.select(*place, *COHORT), allowMissingColumns=True)
    lead = F.when(F.col("_s") == "canonical", 0).otherwise(1)
    first = members.where("content_hash is not null").groupBy(*COHORT).agg(F.min(F.struct(lead.alias("lead"), *place)).alias("first"))
    canon = F.coalesce(F.col(f"first.{key}"), F.col(key))
    status = F.when(canon == F.col(key), "canonical").otherwise("duplicate")
    voted = members.join(first, COHORT, "left").select(*place, *COHORT, canon.alias("canonical_doc_id"), status.alias("dedupe_status"), "_c", "_s")
    differs = ~(F.col("_c").eqNullSafe(F.col("canonical_doc_id")) & F.col("_s").eqNullSafe(F.col("dedupe_status")))
    gone = elected.join(changes.where("op = 'delete'").select(key), key, "left_semi").select(*place, *COHORT, "canonical_doc_id", "dedupe_status", F.lit("delete").alias("op"))
    return voted.where(differs).drop("_c", "_s").withColumn("op", F.lit("put")).unionByName(gone)


def duplicate_refs(elected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Canonical documents with their duplicates, in order."""
    return elected.where("dedupe_status = 'duplicate'").groupBy("canonical_doc_id").agg(F.array_sort(F.collect_list(key)).alias("duplicates"), F.count(F.lit(1)).alias("n"))


def merge_provenance(canonical: DataFrame, elected: DataFrame, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Canonical rows with the distinct values of their duplicates appended to list columns, and dup_count, which never falls."""
    seen = elected.where("dedupe_status = 'duplicate'").groupBy("canonical_doc_id").agg(*[F.array_sort(F.collect_set(f)).alias(f"_{f}") for f in fields], F.count(F.lit(1)).alias("_n"))
    joined = canonical.join(seen.withColumnRenamed("canonical_doc_id", key), key, "left")
    lists = {f"dup_{f}s": F.array_union(F.coalesce(F.col(f"dup_{f}s"), F.array().cast("array<string>")) if f"dup_{f}s" in canonical.columns else F.array().cast("array<string>"), F.coalesce(F.col(f"_{f}").cast("array<string>"), F.array().cast("array<string>"))) for f in fields}
    prior = F.coalesce("dup_count", F.lit(0)) if "dup_count" in canonical.columns else F.lit(0)
    return joined.withColumns({**lists, "dup_count": F.greatest(prior, F.coalesce("_n", F.lit(0)))}).drop("_n", *[f"_{f}" for f in fields])


def broken_election(elected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that break the rules: a duplicate of itself, or of something that is not canonical."""
    canon = elected.where("dedupe_status = 'canonical'").select(F.col(key).alias("canonical_doc_id"))
    dups = elected.where("dedupe_status = 'duplicate'")
    return dups.where(F.col(key) == F.col("canonical_doc_id")).unionByName(dups.join(canon, "canonical_doc_id", "left_anti").select(*elected.columns)).distinct()


def hash_duplicates(df: DataFrame, group: str) -> DataFrame:
    """Surplus copies by group: one less than the rows of each hash."""
    per = df.where("content_hash is not null").groupBy(group, "content_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(group).agg(F.sum(F.col("n") - 1).alias("hash_dups"))


def content_groups(df: DataFrame, tokens: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, group_id): documents that share any token (hash, natural path, …), directly or over others; the smallest key names a group.

    Each round passes the smallest label through the tokens; checkpoints cut the lineage, and only the
    number of changed labels reaches the driver.
    """
    pairs = F.array(*[F.concat_ws("\0", F.lit(t), F.col(t).cast("string")) for t in tokens])
    links = df.select(F.col(key).alias("k"), F.explode(F.filter(pairs, lambda x: F.instr(x, "\0") > 0)).alias("t")).distinct().checkpoint()
    labels = df.select(F.col(key).alias("k")).distinct().withColumn("g", F.col("k"))
    while True:
        low = links.join(labels, "k").groupBy("t").agg(F.min("g").alias("g"))
        nearest = links.join(low, "t").groupBy("k").agg(F.min("g").alias("n"))
        step = labels.join(nearest, "k", "left").select("k", "g", F.least("g", "n").alias("n"))
        jump = step.select(F.col("k").alias("n"), F.col("n").alias("up"))
        new = step.join(jump, "n", "left").select("k", "g", F.coalesce("up", "n").alias("n")).checkpoint()
        labels = new.select("k", F.col("n").alias("g"))
        if new.where("n <> g").limit(1).count() == 0:
            return labels.select(F.col("k").alias(key), F.col("g").alias("group_id"))
