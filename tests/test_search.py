"""Hand-computed numbers for the retrieval stages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import filters, lookup, search, sqlguard


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_fusion_keeps_first_appearance_on_ties(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0), ("x", 8.0), ("z", 1.0)], "id string, score double")
    rows = search.fuse([a, b]).orderBy("pos").collect()
    assert [r.id for r in rows] == ["x", "y", "z"]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62) and rows[2].score == pytest.approx(1 / 63)


def test_score_factors(spark):
    r = one(spark, search.length_norm(F.lit(1.0), F.lit(800)), search.length_norm(F.lit(1.0), F.lit(3200)), search.importance_weight(F.lit(1.0), F.lit("1.0")),
            search.importance_weight(F.lit(1.0), F.lit("bad")), search.importance_weight(F.lit(1.0), F.lit("NaN")), search.importance_weight(F.lit(1.0), F.lit("-3")))
    assert list(r) == pytest.approx([1.0, 0.5, 1.0, 0.85, 0.85, 0.7])
    day = 86400.0
    r = one(spark, search.recency(F.lit(1.0), F.lit(90 * day), 180 * day), search.recency(F.lit(1.0), F.lit(0.0), 5.0), search.recency(F.lit(1.0), F.lit(9 * day), day))
    e = math.exp(-1)
    assert list(r) == pytest.approx([0.5 + 0.5 * e + 0.3 * e, 1.0, 1.3])


def test_media_words_and_quota(spark):
    assert search.media_types("163 Washington video walkthrough PICS") == ["img", "video"]
    rows = [(k, "video" if k in (12, 15, 17) else "md", 1.0 - k / 20, k) for k in range(1, 18)]
    pool = spark.createDataFrame(rows, "id int, source_type string, score double, pos int")
    got = search.media_quota(pool.where("pos <= 10"), pool, "video").orderBy("pos").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 12, 15]
    assert got[8].score == pytest.approx(0.6 * 0.99) and got[9].score == pytest.approx(0.6 * 0.99 * 0.25 / 0.4)
    assert search.media_quota(pool.where("pos <= 10"), pool, "text").count() == 10


def test_diversity_against_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 4))
    v = [(base[rng.integers(6)] + 0.05 * rng.normal(size=4)).tolist() for _ in range(30)]
    rows = [(k, k + 1, None if k % 11 == 5 else v[k]) for k in range(30)]
    got = search.diversify(spark.createDataFrame(rows, "id int, pos int, vector array<double>"), 10).orderBy("pos").collect()
    unit = [None if r[2] is None else np.array(r[2]) / np.linalg.norm(r[2]) for r in rows]
    chosen, later = [], []
    for k in range(20):
        near = k >= 3 and unit[k] is not None and any(unit[i] is not None and unit[i] @ unit[k] > 0.95 for i in chosen)
        (later if near else chosen).append(k)
    assert [r.id for r in got] == chosen + later + list(range(20, 30))
    assert all((r.deferred_by is not None) == (r.id in later) for r in got)


def test_rerank_drops_what_is_beyond_the_pool(spark):
    x = spark.createDataFrame([(1, "a b", 3.0, 1), (2, "q", 2.0, 2), (3, "a", 1.0, 3)], "id int, text string, score double, pos int")
    got = search.rerank_blend(x, search.overlap_rerank_score("a b", F.col("text")), 2).orderBy("pos").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]


def test_nearest_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    assert [(r.id, r.score) for r in search.nearest(df, [1.0, 0.0], 5).collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert [r.id for r in search.nearest(df, [1.0, 0.0], 1, "l2").collect()] == [1]
    with pytest.raises(ValueError):
        search.nearest(df, [1.0], 1, "dot")
    assert search.bm25(df.select("id", F.lit("x").alias("text")), " !! ", 5).collect() == []


@pytest.mark.parametrize("bad", [{}, {"eq": {}}, {"and": []}, {"in": {"a": []}}, {"near": {"a": 1}}, {"eq": {"a": 1}, "ne": {"a": 1}}, {"eq": {"a; drop": 1}}, {"not": []}])
def test_filters_refuse(bad):
    with pytest.raises(ValueError):
        filters.compile_filter(bad)


def test_filters_and_globs(spark):
    df = spark.createDataFrame([("A%b", "x/y.md"), ("acb", "x/z/w.md"), (None, "q.txt")], "name string, rel_path string")
    names = lambda f, **k: [r.rel_path for r in df.where(filters.compile_filter(f, **k)).collect()]
    assert names({"eq": {"name": "ACB"}}) == ["x/z/w.md"]
    assert names({"contains": {"name": "a%b"}}) == ["x/y.md"] and len(names({"contains": {"name": "a%b"}}, wildcards=True)) == 2
    assert names({"prefix": {"rel_path": "X"}}) == [] and len(names({"prefix": {"rel_path": "x"}})) == 2
    assert names({"ne": {"name": "acb"}}) == ["x/y.md"]
    glob = lambda i, e=(): [r.rel_path for r in df.where(filters.glob_filter(F.col("rel_path"), list(i), list(e))).collect()]
    assert glob(["**/*.md"]) == ["x/y.md", "x/z/w.md"] and glob(["*"]) == ["q.txt"] and glob(["**/*"], ["x/**"]) == ["q.txt"]


@pytest.mark.parametrize(("sql", "ok"), [("select 1", True), (" WITH a AS (SELECT 1) SELECT * FROM a;", True), ("", False), ("drop table x", False), (None, False), ("insert into x select 1", False)])
def test_sql_guard(sql, ok):
    assert (sqlguard.check(sql) is None) == ok


def test_sql_answers(spark):
    df, most = sqlguard.guarded(spark, "select id, 'a\tb' as t from range(5) order by id", 2)
    assert sqlguard.answer(df, most).startswith("[2 of >2 rows shown") and sqlguard.answer(df, most).endswith("id\tt\n0\ta b\n1\ta b")
    assert sqlguard.answer(sqlguard.guarded(spark, "select 1 as x where false")[0], 5) == "(0 rows)"
    with pytest.raises(Exception):  # noqa: B017
        sqlguard.guarded(spark, "select 1) as a; drop table x; select (1", 5)[0].collect()

def test_registered_sql_has_all_its_rows(spark, tmp_path):
    """The cap of answers is not one of tables."""
    from siltstone.plans import catalogue

    n = sqlguard.MOST_ROWS + 500
    for t in ["region", "nation", "customer", "supplier", "orders", "events", "documents"]:
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.range(n).selectExpr("id as p_partkey", "'b' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id as l_partkey", "50.0D as l_quantity", "0.0D as l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalogue.QUERIES["sor_semi_anti"](spark, str(tmp_path)).count() == n
    assert sqlguard.guarded(spark, f"select * from range({n})", n)[0].count() == sqlguard.MOST_ROWS + 1


def test_lookup_verdicts(spark):
    docs = spark.createDataFrame([(1, "Alice Cooper callback at (484) 735-8527", 0.5), (2, "Alice Jones", 0.9), (3, "nothing", 0.99)], "id int, text string, score double")
    ask = lambda q: lookup.verdict(lookup.evidence(docs, q, F.col("text")), q).first()
    assert (ask("+1 484-735-8527")["verdict"], ask("+1 484-735-8527")["top"]) == ("found", 1)
    assert ask("zzzq unobtanium")["verdict"] == "not_found"
    assert ask("missed call from alice jones")["top"] == 1
    assert ask("alice jones")["verdict"] == "found" and ask("alice jones")["top"] == 2
    assert ask("alice xenia bob zoe tim")["verdict"] == "not_found"
    assert lookup.question("call 4847358527 or +1 (484) 735 8527")["phones"] == ["4847358527"]


def test_nearest_join_against_plain_code(spark, monkeypatch):
    """Ties, zero and missing vectors, other dimensions, several blocks of queries, batches shorter than k."""
    import numpy as np

    rng = np.random.default_rng(3)
    some = rng.integers(-2, 3, (90, 4)).astype(float).tolist()
    rows = [(k, v) for k, v in enumerate(some)] + [(900, None), (901, [1.0, 2.0]), (902, [0.0] * 4), (903, [1.0, 2.0]), (904, [])]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = table.where("id % 3 = 0 or id > 890")
    for metric, size in (("cosine", 64 << 20), ("l2", 200)):
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        for others in (False, True):
            got = search.nearest_join(asked, table, 7, metric, others=others).collect()
            for q, v in [(i, v) for i, v in rows if v and (i % 3 == 0 or i > 890)]:
                def score(x, v=v):
                    a, b = np.array([x]), np.array([v])
                    if metric == "l2":
                        return float(1 - ((a - b) ** 2).sum(axis=1)[0])
                    n = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
                    return float((a * b).sum(axis=1)[0] / n[0]) if n[0] else 0.0

                want = sorted(((score(x), i) for i, x in rows if x and len(x) == len(v) and not (others and i == q)), key=lambda r: (-r[0], r[1]))[:7]
                assert [(r.score, r.id) for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == want
    words = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    assert [(r.query, r.id, r["rank"]) for r in search.nearest_join(words, words, 2).orderBy("query", "rank").collect()] == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2), ("c", "c", 1), ("c", "a", 2)]


def test_words_alone_put_no_row_behind(spark):
    """Without a vector to ask with, rows of one text stay where their words put them."""
    rows = [(k, "lease " * (9 - k) + "x " * k, [1.0, 0.0]) for k in range(8)]
    df = spark.createDataFrame(rows, "id int, text string, vector array<double>")
    got = search.hybrid_search(df, "lease", None, 8, rerank=None).orderBy("pos").collect()
    assert all(r.deferred_by is None for r in got)
    assert any(r.deferred_by is not None for r in search.hybrid_search(df, "lease", [1.0, 0.0], 8, rerank=None).collect())


def test_many_pairs_are_scored_in_bounded_memory(monkeypatch):
    """Scoring gathers the vectors of a few pairs at a time; with all of these pairs at once it took over 400 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "CELLS", 1 << 18)
    v = np.random.default_rng(3).normal(size=(512, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(v.tolist())], ["key", "v"])
    tracemalloc.start()
    got = pa.Table.from_batches(search._best_of(list(range(512)), v, 512, "cosine", False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak", peak)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    want = (unit @ unit.T)[got["query"].to_numpy(), got["key"].to_numpy()]
    assert got.num_rows == 512 * 512 and np.allclose(got["score"].to_numpy(), want)
    assert peak < 200e6
