"""Retry states: batches that run again, late outcomes, timers."""

import datetime as dt

from pyspark.sql import functions as F

from siltstone.sources.snapshots import SnapshotTable
from siltstone.streaming import index


def outcomes(spark, rows):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    return spark.createDataFrame([(k, ok, at(s)) for k, ok, s in rows], "doc_id string, ok boolean, ts timestamp")


def states(df):
    return {r.doc_id: (r.attempts, r.exhausted) for r in df.collect()}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    first = outcomes(spark, [("a", False, 1), ("a", False, 2), ("b", True, 1), ("b", False, 5), ("c", False, 3)])
    second = outcomes(spark, [("a", False, 9), ("b", False, 0), ("c", True, 8), ("d", False, 1)])
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    for number, batch in ((0, first), (0, first), (1, second), (1, second), (0, first)):
        table.replace(index.merged_retries(None if table.current() is None else table.read(), batch, cap=3, batch=number))
    # b's second failure is older than its success and does not count.
    assert states(table.read()) == {"a": (3, True), "b": (1, False), "c": (0, False), "d": (1, False)}


def test_a_stream_that_fails_between_its_table_and_its_checkpoint(spark, tmp_path):
    outcomes(spark, [("a", False, 1), ("b", False, 1)]).write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema("doc_id string, ok boolean, ts timestamp").parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    index.retry_stream(read, table, f"{tmp_path}/c").awaitTermination()
    for f in (tmp_path / "c" / "commits").iterdir():  # as if it had died before it could note that the batch was done
        f.unlink()
    index.retry_stream(read, table, f"{tmp_path}/c").awaitTermination()
    assert states(table.read()) == {"a": (1, False), "b": (1, False)} and table.current() == 2


def test_timers_tell_when_a_try_is_due(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema("doc_id string, ok boolean, ts timestamp").parquet(f"{tmp_path}/in")
    start = dt.datetime(2026, 1, 1).replace(tzinfo=dt.UTC).timestamp()
    seen = []

    def run(rows):
        outcomes(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = []
        keep = lambda df, _: got.extend(df.withColumn("next_try", F.col("next_try") - start).collect())
        index.started(index.retry_timers(read, cap=3).writeStream.outputMode("update").foreachBatch(keep), f"{tmp_path}/c").awaitTermination()
        seen.append(sorted((r.doc_id, r.attempts, r.next_try, r.exhausted, r.due) for r in got))

    try:
        run([("a", False, 10), ("b", False, 20), ("b", False, 21)])
        run([("clock", True, 700), ("b", True, 600)])  # a is due at 610; b has succeeded
        run([("a", False, 705), ("a", False, 706), ("clock", True, 9000)])  # used up: no more timers
        run([("clock", True, 90000)])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen[0] == [("a", 1, 610.0, False, False), ("b", 2, 1221.0, False, False)]
    assert ("b", 0, None, False, False) in seen[1] and ("a", 1, 610.0, False, True) in seen[1]
    assert [r for r in seen[2] if r[0] == "a"] == [("a", 3, 706 + 2400.0, True, False)]
    assert [r for rows in seen for r in rows if r[4]] == [("a", 1, 610.0, False, True)]
