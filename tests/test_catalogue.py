"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from siltstone.plans import catalogue, engine_queries, upkeep_queries  # noqa: F401
from siltstone.plans.registered import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries without SQL and the tests that hold their operators against plain code.
BY_HAND = {"phrase_matching": "test_upkeep.test_phrases_against_a_plain_matching", "round_robin_select": "test_upkeep.test_round_robin_takes_turns"}


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows and name in BY_HAND  # held against plain code in the tests named there
        return
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([tuple(plain(r[c]) for c in cols) for r in rows], key=repr) == sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=repr)


def test_chunks_of_searches_are_joined_once(spark, data):
    """What a search reads several times is a table, not a join that would shuffle the texts each time."""
    for rare in (False, True):
        x = catalogue._chunks(spark, data, rare)
        assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    vectors = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.id: r.text for r in x.select("id", "text").collect()} == {k: t for k, t in docs.items() if k in vectors}
