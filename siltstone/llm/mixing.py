"""Mixing sources to target weights by subset-sum budget fitting.

The sources share a word budget by weight; no source may exceed `most` times its size, and what it cannot take is
shared again by weight until no target is above its limit (water filling, in closed form over sorted limits). Within a
source every document is taken `rounds` whole times. The rest of the budget is fitted on the histogram of exact document
lengths: a proportional part of each length, then the largest lengths until the gap is small, then a bounded-knapsack
dynamic programme that comes as near to the gap from below as the lengths left allow. Documents of a length are
selected by a seeded hash, so reruns agree.

Only histograms meet in one task: lengths of one source, and up to 256 hash buckets of one length. Documents are ranked
within a bucket of a length, so a length that holds a third of all rows is spread as well. Nothing reaches the driver.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows are
documents of their own, and where id and text are equal it does not matter which is taken. Documents are drawn by a hash of id and text, so rows
without an id are spread as well. Texts may be of any length: lengths are numbers here. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.llm.shared import WORD, stored

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7
BUCKETS = 256
#: The gap, in words, that the dynamic programme closes; its table has one bit and one entry a word.
GAP = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words in a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size): one row for each source, sources in code point order, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", share).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(W.partitionBy(F.lit(1))) - before) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    # With the sources of lower limits filled, the level that the rest would reach rises up to the true one and falls after it.
    top = F.max("level").over(W.partitionBy(F.lit(1)))
    return s.withColumn("level", level).withColumn("target", F.least("cap", F.col("w") * top)).select("source", "source_size", "target")


def fit(length: np.ndarray, count: np.ndarray, budget: int, gap: int = GAP) -> np.ndarray:
    """How many of each distinct positive length to take: their total is at most budget, and as near as the steps find."""
    total = int((length * count).sum())
    if budget >= total:
        return count.copy()
    take = (count * budget) // total
    rest = budget - int((take * length).sum())
    for i in np.argsort(-length, kind="stable"):
        if rest <= gap:
            break
        k = min(int(count[i] - take[i]), (rest - gap // 2) // int(length[i]))
        take[i] += k
        rest -= k * int(length[i])
    rest = min(rest, total)
    if rest > 8 * gap:
        # Each length left is above rest - gap / 2 here, so one document fits at most: the longest that does.
        fits = np.flatnonzero((count > take) & (length <= rest))
        if len(fits):
            take[fits[np.argmax(length[fits])]] += 1
        return take
    # Bounded knapsack: bit s of `reach` says that some items add up to s; `made` has the item that reached it first.
    mask, reach, items = (1 << (rest + 1)) - 1, 1, []
    made = np.full(rest + 1, -1, np.int32)
    for i in np.argsort(-length, kind="stable"):
        left, k = min(int(count[i] - take[i]), rest // int(length[i])), 1
        while left > 0 and not reach >> rest & 1:
            k = min(k, left)
            new = (reach << k * int(length[i])) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((rest >> 3) + 1, "little"), np.uint8), bitorder="little")
                made[np.flatnonzero(bits)] = len(items)
                items.append((i, k))
                reach |= new
            left, k = left - k, 2 * k
    at = reach.bit_length() - 1
    while at > 0:
        i, k = items[made[at]]
        take[i] += k
        at -= k * int(length[i])
    return take


def _fit_source(key, pdf: pd.DataFrame) -> pd.DataFrame:
    size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    own, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    rounds = min(int(target // own), MOST) if own else 0
    extra = min(max(int(np.floor(target - rounds * own + 0.5)), 0), own)
    some = size > 0
    k = np.zeros(len(size), np.int64)
    if rounds < MOST and extra:
        k[some] = fit(size[some], n[some], extra)
    return pd.DataFrame({"skey": key[0], "size": size, "rounds": rounds, "k": k})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """row (all columns of docs), size, source_size, target and copies for each row of docs."""
    key = docs.select(F.struct("*").alias("row")).withColumn("size", word_count(F.col("row.text").cast("string"))).withColumn("skey", source_key(F.col("row.source").cast("string")))
    h = F.xxhash64(F.col("row.doc_id").cast("long"), F.lit(seed), F.xxhash64(F.col("row.text").cast("string")))
    dealt = key.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    counts = stored(dealt.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sizes.select(F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")).alias("source"), "source_size")
    targets = stored(source_targets(named, weights, most).select(source_key(F.col("source")).alias("skey"), "source_size", "target"))
    lengths = counts.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(targets, "skey")
    plan = lengths.groupBy("skey").applyInPandas(_fit_source, "skey string, size long, rounds int, k long")
    before = F.sum("n").over(W.partitionBy("skey", "size").orderBy("bucket")) - F.col("n")
    share = counts.join(plan, ["skey", "size"]).withColumn("part", F.least(F.greatest(F.col("k") - before, F.lit(0)), F.col("n")))
    share = stored(share.join(targets, "skey").select("skey", "size", "bucket", "rounds", "part", "source_size", "target"))
    rank = F.row_number().over(W.partitionBy("skey", "size", "bucket").orderBy("h", "row.doc_id"))
    ranked = dealt.withColumn("rank", rank).join(share, ["skey", "size", "bucket"])
    return ranked.select("row", "size", "source_size", "target", (F.col("rounds") + (F.col("rank") <= F.col("part")).cast("int")).alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the document, repeats counted)."""
    m = mix(docs.select("doc_id", "text", "source"))
    return m.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * F.col("copies")).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, name: str = "mix_copies") -> DataFrame:
    """The documents that the mix takes, with the number of copies of each in a column of a name that is free."""
    while name in docs.columns:
        name += "_"
    return mix(docs).where("copies > 0 and size > 0").select("row.*", F.col("copies").alias(name))
