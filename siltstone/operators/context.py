"""Conversation context: neighbours of a message by order and time, and the nearest that say something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.functions.providers import NORMALIZERS


def context_windows(messages: DataFrame, scope: Sequence[str], order: Sequence[str], before: int = 5, after: int = 5, minutes: float = 15, gap: float = 3.0, extra: float = 60.0, key: str = "message_id", time: str = "sent_at", text: str = "text") -> DataFrame:
    """(scope, key, ids): the messages around each one, within the time window, without those much farther than the nearest.

    The nearest non-empty message on either side is always there if it is within the window. A message without a
    time is never too far, and where the message itself has none, nothing is. Frames are bounded (rows that other
    scopes cannot reach), so a long conversation streams through its window.
    """
    w = W.partitionBy(*scope).orderBy(*order)
    me = F.struct(F.col(key).alias("id"), F.col(time).cast("timestamp").cast("double").alias("t"))
    said = F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) != "", me)
    full = messages.withColumns({
        "_b": F.collect_list(me).over(w.rowsBetween(-before, -1)), "_a": F.collect_list(me).over(w.rowsBetween(1, after)), "_t": F.col(time).cast("timestamp").cast("double"),
        "_nb": F.last(said, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "_na": F.last(said, ignorenulls=True).over(W.partitionBy(*scope).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)),
    })
    far = lambda x: F.abs(x["t"] - F.col("_t"))
    near = lambda x: F.coalesce(far(x) <= minutes * 60, F.lit(True))
    full = full.withColumn("_b", F.filter("_b", near)).withColumn("_a", F.filter("_a", near)).withColumn("_m", F.array_min(F.transform(F.concat("_b", "_a"), far)))
    kept = lambda x: F.coalesce(far(x) <= F.greatest(F.col("_m") * gap, F.col("_m") + extra), F.lit(True))
    one = lambda c: F.when(F.col(c).isNotNull() & near(F.col(c)), F.array(F.col(f"{c}.id"))).otherwise(F.array().cast(f"array<{messages.schema[key].dataType.simpleString()}>"))
    ids = lambda c: F.transform(F.filter(c, kept), lambda x: x["id"])
    lead = F.concat(F.array_except(one("_nb"), ids("_b")), ids("_b"))
    tail = F.concat(ids("_a"), F.array_except(one("_na"), ids("_a")))
    return full.select(*scope, key, lead.alias("before"), tail.alias("after"))


def nearest_said(messages: DataFrame, scope: Sequence[str], order: Sequence[str], key: str = "message_id", text: str = "text") -> DataFrame:
    """(scope, key, said_before, said_after): the nearest non-empty messages by order."""
    said = F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) != "", F.col(key))
    up, down = W.partitionBy(*scope).orderBy(*order), W.partitionBy(*scope).orderBy(*[F.desc(c) for c in order])
    prior = lambda w: F.last(said, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return messages.select(*scope, key, prior(up).alias("said_before"), prior(down).alias("said_after"))


def expand_mentions(messages: DataFrame, participants: DataFrame, text: str = "text", key: str = "message_id") -> DataFrame:
    """Mentions like {@123} in texts as the participants' names; unknown ones stay, texts of mentions alone are dropped."""
    only = F.trim(F.regexp_replace(text, r"\{@\d+\}", "")) == ""
    some = messages.where(~(only & F.col(text).contains("{@")))
    found = some.select(key, "source", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{@(\d+)\}"), F.lit(1)))).alias("participant_key"))
    names = found.join(participants.select("source", "participant_key", "display_name"), ["source", "participant_key"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("participant_key", "display_name"))).alias("_n"))
    parts = F.split(F.col(text), r"(?=\{@\d+\})|(?<=\{@\d{1,18}\})")
    name = lambda x: F.coalesce(F.try_element_at("_n", F.regexp_extract(x, r"^\{@(\d+)\}$", 1)), x)
    joined = some.join(names, key, "left")
    return joined.withColumn(text, F.when(F.col("_n").isNull(), F.col(text)).otherwise(F.array_join(F.transform(parts, name), ""))).drop("_n")


NORMALIZERS.add("zoho_cliq_mentions", expand_mentions)


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user that a gap ends (not a retrieval operator; it comes with the streaming helpers)."""
    return events.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
