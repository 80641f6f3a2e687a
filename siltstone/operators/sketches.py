"""Sketches by group that are stored once and merged when they are read: distinct values and quantiles.

The sketches are Spark's own: HyperLogLog with 2 ** bits registers (relative standard error 1.04 / sqrt(2 ** bits)) and KLL
with parameter k (rank error about 1.7 % at k = 200). Merging sketches of parts gives the sketch of the whole, so a report over any set of days or
sources reads a row for each of them and no data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, KLL = 12, 200


def sketches(df: DataFrame, by: Sequence[str], distinct: str, value: str, bits: int = BITS, k: int = KLL) -> DataFrame:
    """by, n, distinct_sketch and value_sketch of each group; nulls are not counted in sketches, and a group without a value has a null one."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, bits).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("value_sketch"))


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches taken together by fewer columns."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def distinct_count(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
