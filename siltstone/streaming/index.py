"""Incremental runs as streams: upserts, request queues, retry state, event-time helpers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siltstone.functions.text import retry_delay
from siltstone.operators.incremental import latest_requests
from siltstone.sources.snapshots import SnapshotTable


def started(writer, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream: what is there now, or again and again after so long ("30 seconds"), never two runs at once."""
    out = writer.option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def upsert_stream(records: DataFrame, target: SnapshotTable, checkpoint: str, key: str = "doc_id", order: str = "mtime", every: str | None = None) -> StreamingQuery:
    """Drains a stream of records into a table: of a key the newest record of a batch counts, and an older one than is stored is ignored.

    A batch that is run again after a failure gives the same table.
    """

    def apply(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        if target.current() is not None:
            stored = target.read().groupBy(key).agg(F.max(order).alias("_had"))
            newest = newest.join(stored, key, "left").where(F.col("_had").isNull() | (F.col(order) > F.col("_had"))).drop("_had")
        if newest.limit(1).count():
            target.upsert(newest, key)

    return started(records.writeStream.foreachBatch(apply), checkpoint, every)


def drain_requests(requests: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Requests of each batch, coalesced by target, handed to `work`; the checkpoint is the queue's durable state."""
    return started(requests.writeStream.foreachBatch(lambda df, _: work(latest_requests(df))), checkpoint, every)


def distinct_events(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, its state dropped when the watermark is past."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, time: str, size: str, by: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window (these windows are extras, the engine's own runs need none)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def complete_stream(result: DataFrame, target: SnapshotTable, checkpoint: str) -> StreamingQuery:
    """Drains a streaming aggregation into a table that always holds its whole result."""
    return started(result.writeStream.outputMode("complete").foreachBatch(lambda df, _: target.replace(df)), checkpoint)


def merged_retries(state: DataFrame | None, outcomes: DataFrame, key: str = "doc_id", cap: int = 12, batch: int = 0) -> DataFrame:
    """Retry state (attempts since the last success, last_ok, last_try, next_try in seconds, exhausted, batch) after more outcomes (key, ok, ts).

    Sums and maxima only: failures after the last success count, that of the batch or of the state. The time of the next try backs off with the attempts, of
    which `cap` is the last. batch is the number of the batch that a row has seen last; a row that has seen this one, or a later one, stays as it is,
    so a batch that is run again changes nothing.
    """
    fresh = outcomes
    if state is not None:
        state = state if "batch" in state.columns else state.withColumn("batch", F.lit(-1).cast("long"))
        known = state.select(key, F.col("last_ok").alias("old_ok"), F.col("batch").alias("seen"))
        fresh = outcomes.join(known, key, "left").where(F.col("seen").isNull() | (F.col("seen") < batch))
    else:
        fresh = outcomes.withColumn("old_ok", F.lit(None).cast(outcomes.schema["ts"].dataType))
    ok = fresh.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("new_ok"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("new_try"))
    last = F.greatest("new_ok", "old_ok")
    more = fresh.join(ok.select(key, "new_ok"), key).where(~F.col("ok") & (last.isNull() | (F.col("ts") > last))).groupBy(key).agg(F.count(F.lit(1)).alias("more"))
    x = ok.join(more, key, "left").na.fill(0, ["more"])
    if state is None:
        x = x.withColumns({"had": F.lit(0).cast("long"), "last_ok": F.col("new_ok"), "last_try": F.col("new_try"), "batch": F.lit(batch).cast("long")})
    else:
        old = state.select(key, F.col("attempts").alias("had"), F.col("last_ok").alias("old_ok"), F.col("last_try").alias("old_try"), F.col("batch").alias("seen"))
        touched = F.col("more").isNotNull()
        x = x.join(old, key, "full_outer").withColumn("batch", F.when(touched, F.lit(batch).cast("long")).otherwise(F.col("seen")))
        x = x.withColumns({"had": F.coalesce("had", F.lit(0)), "more": F.coalesce("more", F.lit(0)), "last_ok": F.greatest("new_ok", "old_ok"), "last_try": F.greatest("new_try", "old_try"), "new_ok": F.when(F.col("old_ok").isNull() | (F.col("new_ok") > F.col("old_ok")), F.col("new_ok"))})
    tries = F.least(F.when(F.col("new_ok").isNull(), F.col("had") + F.col("more")).otherwise(F.col("more")), F.lit(cap))
    due = F.when(F.col("last_try").isNotNull(), F.unix_micros(F.col("last_try").cast("timestamp")) / 1e6 + retry_delay(tries))
    return x.select(key, tries.alias("attempts"), "last_ok", "last_try", F.when(tries > 0, due).alias("next_try"), (tries >= cap).alias("exhausted"), "batch")


def retry_stream(outcomes: DataFrame, target: SnapshotTable, checkpoint: str, key: str = "doc_id", cap: int = 12) -> StreamingQuery:
    """Drains a stream of outcomes into a table of retry states, one row a key; a table belongs to one checkpoint, by whose batches its rows are numbered."""

    def apply(batch: DataFrame, number: int) -> None:
        target.replace(merged_retries(None if target.current() is None else target.read(), batch, key, cap, number))

    return started(outcomes.writeStream.foreachBatch(apply), checkpoint)


_RETRY = "attempts int, last_ok double, last_try double"


class Retries(StatefulProcessor):
    """Keeps the retry state of a key and wakes up when its next try is due, by event time."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retries", _RETRY)

    def _row(self, key, attempts: int, last_ok, last_try, due: bool) -> pd.DataFrame:
        wait = min(300.0 * 2.0**attempts, 21600.0)
        return pd.DataFrame({"doc_id": [key[0]], "attempts": [attempts], "last_ok": [last_ok], "last_try": [last_try], "next_try": [last_try + wait if attempts else None], "exhausted": [attempts >= self.cap], "due": [due]})

    def handleInputRows(self, key, rows, timerValues):
        attempts, last_ok, last_try = self.state.get() if self.state.exists() else (0, None, None)
        new = pd.concat(list(rows))
        good, bad = new.seconds[new.ok], new.seconds[~new.ok]
        if len(good) and (last_ok is None or good.max() > last_ok):
            # Failures that were counted before count on if they came after this success, which only a late success can bring about.
            attempts, last_ok = (attempts if last_try is not None and last_try > good.max() else 0), float(good.max())
        attempts = min(self.cap, attempts + int((bad > (last_ok if last_ok is not None else float("-inf"))).sum()))
        if len(bad):
            last_try = max(float(bad.max()), last_try if last_try is not None else float("-inf"))
        self.state.update((attempts, last_ok, last_try))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        out = self._row(key, attempts, last_ok, last_try, False)
        if attempts and attempts < self.cap:
            self.handle.registerTimer(int(out.next_try[0] * 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._row(key, *self.state.get(), True)

    def close(self) -> None:
        pass


def retry_timers(outcomes: DataFrame, cap: int = 12, late: str = "0 seconds") -> DataFrame:
    """A stream of retry states from a stream of outcomes (doc_id, ok, ts): a row (due = false) for each key of a batch, and one (due = true) when its next try is due.

    State and timers live in the state store (RocksDB, which the session must name as its provider), one row a key, by event time: a batch
    that is run again begins from the state before it. Keys that are used up (cap) wait for a success.
    """
    timed = outcomes.select(F.col("doc_id").cast("string").alias("doc_id"), "ok", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.withColumn("seconds", F.unix_micros("ts") / 1e6)
    return rows.groupBy("doc_id").transformWithStateInPandas(Retries(cap), "doc_id string, attempts int, last_ok double, last_try double, next_try double, exhausted boolean, due boolean", "Update", "EventTime")


def progress(query: StreamingQuery) -> list[dict]:
    """What a run has done so far: batch, rows read and how long each took, for a supervisor to show."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"], "at": p["timestamp"]} for p in query.recentProgress]
