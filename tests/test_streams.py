"""A stream's context against that of the whole table, from late and reordered files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siltstone.operators.context import context_windows
from siltstone.streaming.context import context_stream
from siltstone.streaming.index import started


def test_context_of_late_and_reordered_messages(spark, tmp_path):
    draw, start = random.Random(7), dt.datetime(2026, 1, 1)
    rows = [(draw.choice("ab"), k, start + dt.timedelta(seconds=draw.choice([0, 20, 100, 700]) + 25 * k), draw.choice(["", " ", "hi", "there"])) for k in range(160)]
    schema = "chan string, message_id int, sent_at timestamp, text string"
    table = spark.createDataFrame(rows, schema)
    order = sorted(rows, key=lambda r: r[1] + draw.randint(-12, 12))
    clock = [("z", 1000, start + dt.timedelta(days=1), "x"), ("z", 1001, None, "no time")]
    got_at = []
    for n, part in enumerate([order[:60], order[60:110], order[110:], clock, [("a", 2000, start, "too late")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = context_stream(read, ["chan"], minutes=5, late="20 minutes")
        started(out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/c").awaitTermination()
        got_at.append(spark.read.schema("chan string, message_id int, sent timestamp, before array<int>, after array<int>").parquet(f"{tmp_path}/out").count())
    got = spark.read.parquet(f"{tmp_path}/out")
    want = context_windows(table, ["chan"], ["sent_at", "message_id"], minutes=5)
    plain = lambda df: sorted((r.chan, r.message_id, r.before, r.after) for r in df.where("chan <> 'z'").collect())
    assert plain(got) == plain(want)
    assert 0 < got_at[2] < 160 and got_at[3] >= 160 and got.where("message_id >= 1001").count() == 0
    assert got.groupBy("message_id").count().agg(F.max("count")).first()[0] == 1


def test_context_keeps_a_row_of_state_for_many_messages(spark, tmp_path):
    draw, start = random.Random(8), dt.datetime(2026, 1, 1)
    rows = [(draw.choice("ab"), k, start + dt.timedelta(seconds=draw.choice([0, 20, 100, 400]) + 15 * k), draw.choice(["", "", "", " ", "hi"])) for k in range(200)]
    schema = "chan string, message_id int, sent_at timestamp, text string"
    clock = [("z", 1000, start + dt.timedelta(days=1), "x")]
    # One message is sent twice: it counts once, for itself and as a neighbour.
    spark.createDataFrame(rows + [rows[77]] + clock, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = sorted((r.message_id, r.before, r.after) for r in context_windows(spark.createDataFrame(rows, schema), ["chan"], ["sent_at", "message_id"], before=3, after=2, minutes=5).collect())
    for hold in (1, 8):
        out = context_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["chan"], before=3, after=2, minutes=5, hold=hold)
        run = started(out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out{hold}"), f"{tmp_path}/c{hold}")
        run.awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out{hold}").where("chan <> 'z'")
        assert sorted((r.message_id, r.before, r.after) for r in got.collect()) == want
        held = [p.stateOperators for p in run.recentProgress if p.stateOperators]
        assert max(sum(s.numRowsTotal for s in states) for states in held) <= len(rows) / 4  # a join of the stream holds it twice, and each pair
