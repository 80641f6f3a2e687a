"""Consecutive numbers in an order, dealt without a window that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.sources.snapshots import checkpoint_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "idx", keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """df with a long `name`: 0, 1, … within each group of `by`, in ascending order (nulls first).

    Rows are cut into ranges, sorted within them, and each range starts where those before it end: only the number of rows by range
    and group is summed up. A group may span all ranges. `keep` materialises the sorted rows, so that numbers stay
    what they were if a task runs again. Rows that are equal in all of `order` may come either way round.
    """
    keys = [*by, *order]
    spread = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = keep(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33).cast("int"))
    own = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    names = [f"_by{k}" for k in range(len(by))]
    sizes = placed.groupBy(*own, F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    if by:
        before = F.sum("_n").over(W.partitionBy(*names).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
        starts = sizes.select(*names, "_r", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    else:
        # One row a range.
        total, rows = 0, []
        for r in sorted(sizes.collect(), key=lambda x: x["_r"]):
            rows.append((r["_r"], total - r["_first"]))
            total += r["_n"]
        starts = F.broadcast(df.sparkSession.createDataFrame(rows, "_r int, _shift long"))
    met = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        met = met & placed[c].eqNullSafe(F.col(f"_by{k}"))
    return placed.join(starts, met).select(*[placed[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))
