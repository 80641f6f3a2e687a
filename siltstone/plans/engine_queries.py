"""Queries of the engine's functions over an index that is built from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.plans import search_sql
from siltstone.plans.registered import query
from siltstone.session import table
from siltstone.sources.snapshots import shared_folder

_built: dict[tuple[str, str], Engine] = {}


def _records(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    doc_id = F.concat_ws("::", "source", F.col("doc_id").cast("string"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("md")
    return docs.select(doc_id.alias("doc_id"), "text", path.alias("rel_path"), kind.alias("source_type"), F.col("source").alias("source_name"), F.col("n_chars").cast("double").alias("mtime"), F.sha2("text", 256).alias("change_hash"))


_ID = "concat(source, '::', doc_id)"


def _engine(spark, d) -> Engine:
    """An index of all documents, built once a session and dataset; the second run leaves it as it is."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        e = Engine(spark, shared_folder(spark))
        e.file_index_update(_records(spark, d))
        e.file_index_update(_records(spark, d))
        _built[key] = e
    return _built[key]


def _frame(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@query(f"SELECT {_ID} AS doc_id, n_chars::DOUBLE AS mtime, concat(lang, '/', doc_id, '.md') AS rel_path FROM documents ORDER BY n_chars DESC, {_ID} LIMIT 20")
def engine_recent(spark, d):
    return _frame(spark, _engine(spark, d).file_recent(20), "doc_id string, mtime double, rel_path string")


@query(f"SELECT {_ID} AS doc_id, (SELECT count(*) FROM documents WHERE lower(source) = 'src1') AS total FROM documents WHERE lower(source) = 'src1' ORDER BY {_ID} LIMIT 10 OFFSET 5")
def engine_list_documents(spark, d):
    return _frame(spark, _engine(spark, d).file_list_documents(10, 5, source_name="SRC1"), "doc_id string, total long")


@query("SELECT 'source_type' AS field, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'md' END AS value, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'source_name', source, count(*) FROM documents GROUP BY 2")
def engine_facets(spark, d):
    f = _engine(spark, d).file_facets(["source_type", "source_name"])
    return _frame(spark, [{"field": k, **r} for k, v in f.items() for r in v], "field string, value string, count long")


@query("SELECT lang AS folder, count(*) AS n FROM documents GROUP BY 1")
def engine_folders(spark, d):
    return _frame(spark, _engine(spark, d).file_folders(), "folder string, n long")


@query("SELECT source AS source_name, count(*) AS n, 'ok' AS state FROM documents GROUP BY 1")
def engine_status(spark, d):
    s = _engine(spark, d).file_status()
    return _frame(spark, [{"source_name": k, "n": n, "state": s["health"][k]["state"]} for k, n in s["sources"].items()], "source_name string, n long, state string")


_CHUNKS = f"""t AS (SELECT {_ID} AS doc_id, lang, doc_id AS n, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents WHERE trim(text) <> ''),
c AS (SELECT *, unnest(range(0, greatest(ceil((length(body) - 200) / 1600.0), 1)::BIGINT)) AS i FROM t),
ch AS (SELECT doc_id, concat(doc_id, '::c:', i) AS id, concat('c:', i) AS loc, CASE WHEN n % 3 = 0 THEN 'pdf' ELSE 'md' END AS kind, substring(body, i * 1600 + 1, 1800) AS text FROM c WHERE trim(substring(body, i * 1600 + 1, 1800)) <> '')"""


@query(f"WITH {_CHUNKS} SELECT doc_id, loc, text FROM ch")
def engine_chunks(spark, d):
    """All chunks, of which the functions give those of a document and one by its place."""
    e = _engine(spark, d)
    for r in table(spark, d, "documents").where("doc_id % 500 = 1").select("doc_id", "source").limit(3).collect():
        own = e.file_get_doc_chunks(f"{r.source}::{r.doc_id}")
        assert [c["loc"] for c in own] == [f"c:{k}" for k in range(len(own))] and all(e.file_get_chunk(c["doc_id"], c["loc"])["text"] == c["text"] for c in own[-1:])  # a document without text has none
    return e.chunks.read().select("doc_id", "loc", "text")


_SOUGHT = "the license thing"


@query(f"WITH {_CHUNKS}, {search_sql.bm25(_SOUGHT.split(), 'b', 'true', 50)} SELECT id, round(score, 6) AS score FROM b")
def engine_keyword_list(spark, d):
    """What a search finds by words, from the postings that indexing keeps."""
    e = _engine(spark, d)
    assert e.postings.version == e.chunks.current()
    return e._keyword(e.chunks.read().withColumn("id", F.col("chunk_uid")))(_SOUGHT, 50, None).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CHUNKS}, {search_sql.bm25(_SOUGHT.split(), 'b', "kind = 'pdf'", 50)}, r AS (SELECT ch.*, b.score AS s, row_number() OVER (ORDER BY b.score DESC, id) AS r FROM b JOIN ch USING (id)),
f1 AS (SELECT *, CASE WHEN length(text) > 800 THEN 1 / (60 + r) / (1 + 0.5 * log2(length(text) / 800.0)) ELSE 1 / (60 + r) END AS x FROM r),
f2 AS (SELECT *, row_number() OVER (ORDER BY x DESC, r) AS p, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(left(text, 4000)), '\\s+')), {sorted(_SOUGHT.split())})) / 3.0, 6) AS rr FROM f1),
f3 AS (SELECT doc_id, loc, p, 0.6 * CASE WHEN max(rr) OVER () > min(rr) OVER () THEN (rr - min(rr) OVER ()) / (max(rr) OVER () - min(rr) OVER ()) ELSE 1 END + 0.4 * CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) ELSE 1 END AS score FROM f2 WHERE p <= 60)
SELECT doc_id, loc, round(score, 4) AS score FROM f3 ORDER BY f3.score DESC, p LIMIT 10""")
def engine_file_search(spark, d):
    """A search by words alone (its embedder is away) under a filter, through all stages; no two chunks are held to be alike without vectors."""
    e = _engine(spark, d)

    def away(_):
        raise RuntimeError("no model")

    alone = Engine(spark, e.root, embedder=away)
    got = alone.file_search(_SOUGHT, 10, source_type="PDF", now=None)
    assert got["diagnostics"]["degraded"] and got["total"] == len(got["results"])
    return _frame(spark, got["results"], "doc_id string, loc string, score double")


@query(f"SELECT {_ID} AS doc_id, 'add' AS action, row_number() OVER (ORDER BY {_ID})::BIGINT AS id FROM documents")
def engine_audit(spark, d):
    """The log of the runs: every document added once and numbered; the second run changed nothing."""
    return _engine(spark, d).audit.read().select("doc_id", "action", "id")


@query("SELECT r_name AS line FROM region UNION ALL SELECT 'r_name'")
def engine_sor_query(spark, d):
    table(spark, d, "region").createOrReplaceTempView("region")
    return spark.createDataFrame([(x,) for x in _engine(spark, d).sor_query("SELECT r_name FROM region").split("\n")], "line string")


_NAMES = ("region", "nation", "customer", "supplier")


@query(f"""SELECT concat(table_name, '(', string_agg(concat(column_name, ' ', CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END), ', ' ORDER BY ordinal_position), ')') AS line
FROM information_schema.columns WHERE table_name IN {_NAMES} GROUP BY table_name""")
def engine_sor_schema(spark, d):
    """The columns of the tables that statements may use."""
    for n in _NAMES:
        table(spark, d, n).createOrReplaceTempView(n)
    lines = _engine(spark, d).sor_schema().split("\n")
    return spark.createDataFrame([(x,) for x in lines if x.split("(")[0] in _NAMES], "line string")


@query("SELECT concat('tag:', n_name) AS id, n_name AS name, CASE WHEN n_nationkey = 1 THEN 'retired' ELSE 'active' END AS status FROM nation WHERE n_nationkey <> 2")
def engine_taxonomy(spark, d):
    """Entries imported, one changed and one deleted."""
    e = _engine(spark, d)
    names = [r.n_name for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    e.taxonomy_import([{"kind": "tag", "name": n, "description": f"about {n}"} for n in names])
    e.taxonomy_add(kind="tag", name=names[3], description="again")
    e.taxonomy_update(f"tag:{names[1]}", status="retired")
    e.taxonomy_delete(f"tag:{names[2]}")
    assert e.taxonomy_get(f"tag:{names[3]}")["description"] == "again"
    return _frame(spark, e.taxonomy_list("tag", None), "id string, name string, status string")


@query("WITH e AS (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, concat(source, '::', doc_id)) AS r FROM documents) SELECT concat(source, '::', doc_id) AS doc_id FROM e WHERE r = 1")
def engine_exact_dedupe(spark, d):
    """Of equal texts the first alone is indexed."""
    e = Engine(spark, shared_folder(spark))
    whole = table(spark, d, "documents").select(F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("doc_id"), F.col("text"), F.lit("x.md").alias("rel_path"), F.lit("md").alias("source_type"), F.col("source").alias("source_name"), F.col("n_chars").cast("double").alias("mtime"), F.sha2("text", 256).alias("change_hash"))
    e.file_index_update(whole, dedupe_exact=True)
    return e.changes.read().select("doc_id")


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks FROM ch WHERE doc_id = (SELECT {_ID} FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1) GROUP BY 1")
def engine_index_document(spark, d):
    """The longest document by itself."""
    e, rec = Engine(spark, shared_folder(spark)), _records(spark, d)
    key = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").select(F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("k")).first().k
    return spark.createDataFrame([(key, e.file_index_document(rec, key)["chunks"])], "doc_id string, chunks long")
