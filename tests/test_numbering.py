import random

from siltstone.operators.numbering import numbered


def test_numbers_by_group_and_over_all(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, "a", "b", "b", "b", "c"]), draw.choice([None, *range(40)]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(7)
    low = lambda x: (x is not None, x or 0)
    got = numbered(df, ["o", "k"], ["g"], "n").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (low(r[1]), r[2]))
        assert [(r.o, r.k) for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == [(r[1], r[2]) for r in own]
        assert sorted(r.n for r in got if r.g == g) == list(range(len(own)))
    every = numbered(df, ["o", "k"]).collect()
    assert [r.k for r in sorted(every, key=lambda r: r.idx)] == [r[2] for r in sorted(rows, key=lambda r: (low(r[1]), r[2]))]


def test_one_hot_value_spreads_and_no_rows_give_none(spark):
    from pyspark.sql import functions as F

    same = spark.range(4000).select(F.lit("x").alias("g"), F.lit(1).alias("o"))
    got = numbered(same, ["o"], ["g"])
    assert sorted(r.idx for r in got.collect()) == list(range(4000))
    assert numbered(same.limit(0), ["o"], ["g"]).collect() == [] and numbered(same.limit(0), ["o"]).collect() == []
