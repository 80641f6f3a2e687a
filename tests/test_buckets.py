"""Writes to a table in buckets touch the buckets of their keys."""

from pyspark.sql import functions as F

from siltstone.sources.buckets import BucketTable


def files(path):
    return {str(p.relative_to(path)) for p in path.glob("bucket=*/*.parquet")}


def test_a_write_of_one_key_rewrites_one_bucket(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", buckets=8)
    t.upsert(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("v")))
    before = files(tmp_path / "t")
    assert len({f.split("/")[0] for f in before}) == 8
    for change in (lambda: t.upsert(spark.createDataFrame([(7, "b")], "doc_id long, v string")), lambda: t.delete(spark.createDataFrame([(8,)], "doc_id long")), lambda: t.compare_and_set(9, F.col("v") == "a", {"v": F.lit("c")}), lambda: t.insert_missing(spark.createDataFrame([(7, "x"), (1000, "new")], "doc_id long, v string"))):
        was = files(tmp_path / "t")
        change()
        now = files(tmp_path / "t")
        assert len({f.split("/")[0] for f in was ^ now}) == 1
    was = files(tmp_path / "t")
    assert not t.compare_and_set(9, F.col("v") == "a", {"v": F.lit("lost")})
    t.insert_missing(spark.createDataFrame([(7, "x")], "doc_id long, v string"))
    assert files(tmp_path / "t") == was
    got = {r.doc_id: r.v for r in t.read().collect()}
    assert len(got) == 200 and (got[7], got[9], got[1000], got[10]) == ("b", "c", "new", "a") and 8 not in got
    plan = t.rows([7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_emptied_buckets_new_columns_and_replacement(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", key="k", buckets=4)
    t.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"))
    t.upsert(spark.createDataFrame([("a", 5, "x")], "k string, n int, more string"))
    assert sorted((r.k, r.n, r.more or "") for r in t.read().collect()) == [("a", 5, "x"), ("b", 2, "")]
    t.delete(spark.createDataFrame([("b",)], "k string"))
    assert [r.k for r in t.read().collect()] == ["a"]
    t.replace(spark.createDataFrame([("c", 1)], "k string, n int"))
    assert [r.k for r in t.read().collect()] == ["c"] and len(files(tmp_path / "t")) == 1
