"""Conversation context of a stream: each message with its neighbours, as soon as no more of them can come."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def context_stream(messages: DataFrame, scope: Sequence[str], before: int = 5, after: int = 5, minutes: float = 15, gap: float = 3.0, extra: float = 60.0, late: str = "10 minutes", key: str = "message_id", time: str = "sent_at", text: str = "text", hold: int = 1) -> DataFrame:
    """(scope, key, sent, before, after): context_windows of a stream of messages, ordered by time and key; `sent` is the message's time.

    Messages of a scope are collected in windows that overlap by twice `minutes`. Those `minutes` and more from both ends of a window have all
    their neighbours in it, and each message is so in one window, with which it is given out once, when the watermark has passed its end; then its state goes.
    A window gives out the messages of `hold` times `minutes` and has (hold + 2) / hold copies of each in the state, so a larger one costs less and
    waits longer. A message that comes more than `late` behind is left out of the windows that have closed; those without a time are left out. A message that is sent twice counts once.
    """
    timed = messages.select(*scope, F.col(key).alias("_id"), F.col(time).cast("timestamp").alias("_at"), (F.coalesce(F.trim(F.col(text)), F.lit("")) != "").alias("_said")).where("_at is not null").withWatermark("_at", late)
    span = minutes * 60
    edge = math.floor(span) + 1  # whole seconds, and more than the span, whatever rounding does to a difference of times
    window = F.window("_at", f"{(hold + 2) * edge} seconds", f"{hold * edge} seconds")
    one = F.struct(F.col("_at").cast("double").alias("t"), F.col("_id").alias("id"), F.col("_said").alias("said"), F.col("_at").alias("at"))
    held = timed.groupBy(window.alias("_w"), *scope).agg(F.array_sort(F.collect_set(one)).alias("_n"))
    start = F.col("_w.start").cast("double") + edge
    own = lambda x: (x["t"] >= start) & (x["t"] < start + hold * edge)

    def context(x: Column, i: Column) -> Column:
        far = lambda y: F.abs(y["t"] - x["t"])
        near = lambda c: F.filter(c, lambda y: far(y) <= span)
        said = lambda c: F.filter(c, lambda y: y["said"] & (far(y) <= span))
        lead, tail = near(F.slice("_n", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)))), near(F.slice("_n", i + 2, after))

        def around(b: Column, a: Column) -> Column:
            # Beyond the nearest ones there is something to look for only if these are all near and none of them says anything.
            nb = F.coalesce(F.try_element_at(said(b), F.lit(-1)), F.when(F.size(b) == before, F.try_element_at(said(F.slice("_n", 1, F.greatest(i - before, F.lit(0)))), F.lit(-1))))
            na = F.coalesce(F.try_element_at(said(a), F.lit(1)), F.when(F.size(a) == after, F.try_element_at(said(F.slice("_n", i + 2 + after, F.size("_n"))), F.lit(1))))
            ids = lambda c, m: F.transform(F.filter(c, lambda y: far(y) <= F.greatest(m * gap, m + extra)), lambda y: y["id"])
            alone = lambda y, c: F.array_except(F.transform(F.filter(F.array(y), lambda z: z.isNotNull()), lambda z: z["id"]), c)
            kept = _let(F.array_min(F.transform(F.concat(b, a), far)), lambda m: F.struct(ids(b, m).alias("b"), ids(a, m).alias("a")))
            return _let(kept, lambda k: F.struct(x["id"].alias("id"), x["at"].alias("at"), F.concat(alone(nb, k["b"]), k["b"]).alias("b"), F.concat(k["a"], alone(na, k["a"])).alias("a")))

        return _let(F.struct(lead.alias("b"), tail.alias("a")), lambda p: around(p["b"], p["a"]))

    # An outer explode brings no filter on its array, which would compute the array again.
    each = F.filter(F.transform("_n", lambda x, i: F.when(own(x), context(x, i))), lambda c: c.isNotNull())
    out = held.select(*scope, F.explode_outer(each).alias("_c")).where("_c is not null")
    return out.select(*scope, F.col("_c.id").alias(key), F.col("_c.at").alias("sent"), F.col("_c.b").alias("before"), F.col("_c.a").alias("after"))
