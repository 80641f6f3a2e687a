"""Read-only SQL over registered views, with a row cap and plain serialisers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS, CELL = 1000, 500


def _inner(sql: str | None) -> str:
    return (sql or "").strip().rstrip(";").strip()


def check(sql: str | None) -> str | None:
    """Why a statement is refused, or None."""
    s = _inner(sql)
    if not s:
        return "empty query"
    return None if s.lower().startswith(("select", "with")) else "only a single SELECT or WITH query is allowed"


def whole(spark: SparkSession, sql: str) -> DataFrame:
    """All rows of a query, for those who do not bring them to the driver.

    The query stands in parentheses, where the parser takes nothing but a query.
    """
    if why := check(sql):
        raise ValueError(why)
    return spark.sql(f"SELECT * FROM (\n{_inner(sql)}\n) AS _sub")


def guarded(spark: SparkSession, sql: str, limit: int = 50) -> tuple[DataFrame, int]:
    """The rows of a query, one more than the limit at most, and the limit."""
    most = max(1, min(int(limit), MOST_ROWS))
    return whole(spark, sql).limit(most + 1), most


def cell(c: Column, width: int = CELL) -> Column:
    """A value as text on one line, cut to a width."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\t\r\n]", " ")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("…"))).otherwise(s)


def tsv(df: DataFrame, width: int = CELL) -> DataFrame:
    """One text column: the cells of each row between tabs."""
    return df.select(F.concat_ws("\t", *[cell(F.col(f"`{c}`"), width) for c in df.columns]).alias("line"))


def answer(df: DataFrame, most: int, fmt: str = "tsv") -> str:
    """A guarded result as text, with a note where rows are missing."""
    rows = df.collect()  # most + 1 rows at most
    shown = rows[:most]
    if fmt == "json":
        short = lambda v: v[:CELL] + "…" if isinstance(v, str) and len(v) > CELL else v
        body = json.dumps([{k: short(v) for k, v in r.asDict().items()} for r in shown], default=str, ensure_ascii=False)
    else:
        lines = tsv(df.sparkSession.createDataFrame(shown, df.schema)).collect() if shown else []
        body = "\n".join(["\t".join(df.columns), *[r.line for r in lines]]) if shown else "(0 rows)"
    return f"[{most} of >{most} rows shown — add LIMIT or narrow the WHERE]\n{body}" if len(rows) > most else body


def schema_text(spark: SparkSession, views: list[str]) -> str:
    """Tables and their columns as text."""
    return "\n".join(f"{v}({', '.join(f'{c} {t}' for c, t in spark.table(v).dtypes)})" for v in sorted(views))


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
