"""Change detection, guards, ledgers and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import change_key, retry_delay, skip_due, source_name


def diff(scanned: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change): add, update, delete or same; both sides have change_hash and mtime.

    Hashes decide where both sides have one; only else the times do.
    """
    s = scanned.select(key, F.col("change_hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("in1"))
    t = stored.select(key, F.col("change_hash").alias("h2"), F.col("mtime").alias("m2"), F.lit(True).alias("in2"))
    both = F.coalesce("h1", F.lit("")) != "", F.coalesce("h2", F.lit("")) != ""
    changed = F.when(both[0] & both[1], F.col("h1") != F.col("h2")).otherwise(~F.col("m1").eqNullSafe(F.col("m2")))
    kind = F.when(F.col("in2").isNull(), "add").when(F.col("in1").isNull(), "delete").when(changed, "update").otherwise("same")
    return s.join(t, key, "full_outer").select(key, kind.alias("change"))


def guarded_deletes(changes: DataFrame, stored: DataFrame, least: int = 20, ratio: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Changes with the deletes of a source kept back where they are too large a part of what it has stored."""
    src = source_name(F.col(key))
    have = stored.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("have"))
    gone = changes.where("change = 'delete'").groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("gone"))
    blocked = have.join(gone, "source").where((F.col("have") >= least) & (F.col("gone") > ratio * F.col("have"))).select("source", F.lit(True).alias("blocked"))
    out = changes.withColumn("source", src).join(blocked, "source", "left")
    return out.select(key, F.when((F.col("change") == "delete") & F.col("blocked"), "kept").otherwise(F.col("change")).alias("change"))


def not_skipped(records: DataFrame, ledger: DataFrame, now: float, key: str = "doc_id") -> DataFrame:
    """Records but those that the skip ledger holds under the same change key and that are not due yet."""
    held = ledger.where(skip_due(F.col("skipped_at"), F.col(key)) > now).select(key, F.col("change_key").alias("ck"))
    mine = records.withColumn("ck", change_key(F.col("change_hash"), F.col("mtime")))
    return mine.join(held, [key, "ck"], "left_anti").select(*records.columns)


def degraded_buckets(ledger: DataFrame, records: DataFrame, stored: DataFrame, now: float, attempts: int = 12, runs: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, bucket): gone, resolved, changed, exhausted, waiting or due, the first that holds."""
    here = records.select(key, change_key(F.col("change_hash"), F.col("mtime")).alias("ck"), F.lit(True).alias("scanned"))
    ok = stored.select(key, F.lit(True).alias("healthy"))
    x = ledger.join(here, key, "left").join(ok, key, "left")
    bucket = (
        F.when(F.col("scanned").isNull(), "gone").when(F.col("healthy") & (F.col("unresolved_runs") >= runs), "resolved").when(F.col("ck") != F.col("change_key"), "changed")
        .when(F.col("attempts") >= attempts, "exhausted").when(F.col("last_try") + retry_delay(F.col("attempts")) > now, "waiting").otherwise("due")
    )
    return x.select(key, bucket.alias("bucket"))


def reap(registry: DataFrame, scanned: DataFrame, stored: DataFrame, least: int = 20, ratio: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Registry rows that are neither scanned nor stored, but of a source that would lose too large a part of its rows."""
    lost = registry.join(scanned.select(key), key, "left_anti").join(stored.select(key), key, "left_anti")
    have = registry.groupBy("source_name").agg(F.count(F.lit(1)).alias("have"))
    gone = lost.groupBy("source_name").agg(F.count(F.lit(1)).alias("gone"))
    safe = have.join(gone, "source_name").where((F.col("have") < least) | (F.col("gone") <= ratio * F.col("have"))).select("source_name")
    return lost.join(safe, "source_name", "left_semi").select(key)


def latest_requests(requests: DataFrame) -> DataFrame:
    """The queue of index requests: one row for each (table, source, target), its revision the number of requests for it."""
    return requests.groupBy("table_name", "source", "target").agg(F.count(F.lit(1)).alias("revision"), F.min("created_at").alias("created_at"), F.max(F.struct("created_at", "force")).alias("last")).select("table_name", "source", "target", "revision", "created_at", F.col("last.force").alias("force"))


def pending(queue: DataFrame, done: DataFrame, first: str | None = None, limit: int = 100) -> DataFrame:
    """Requests whose present revision is not done; a target that is asked for comes first, then the oldest."""
    open_ = queue.join(done.select("table_name", "source", "target", "revision"), ["table_name", "source", "target", "revision"], "left_anti")
    return open_.orderBy(F.when(F.col("target") == (first or ""), 0).otherwise(1), "created_at", "table_name", "source", "target").limit(limit)


def reset_capped(ledger: DataFrame, reason: str, cap: int = 12) -> DataFrame:
    """Entries at the cap of attempts whose reasons, of which there are some, are all of one kind, start again."""
    hit = (F.col("attempts") >= cap) & (F.size("reasons") > 0) & F.forall("reasons", lambda r: F.lower(r).contains(reason.lower()))
    return ledger.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts")))
