"""Registered queries of records, registries, snapshots, hits, enrichment and upkeep, with their SQL.

Columns of the tables stand in for what the operators take: `documents` for records and chunks, `part` for items and labels,
`events` for logs and times, `conversations` for messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import enrichment, providers
from siltstone.functions import text as T
from siltstone.operators import browse, dedupe, evaluate, filters, incremental, lookup, sketches, sqlguard, taxonomy, upkeep
from siltstone.plans.registered import query
from siltstone.session import table
from siltstone.sources import extract, files, protocol, registry, sinks, tables
from siltstone.sources.buckets import BucketTable
from siltstone.sources.snapshots import SnapshotTable, shared_folder
from siltstone.streaming import index as streams

NOW = 1706659200.0


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _part(spark, d) -> DataFrame:
    return table(spark, d, "part")


def _fresh(spark, name: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{shared_folder(spark)}/{name}")


# ---- snapshot tables ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM documents")
def insert_if_absent(spark, d):
    t, ids = _fresh(spark, "t"), _docs(spark, d).select("doc_id")
    t.replace(ids.where("doc_id % 2 = 0").withColumn("v", F.lit("old")))
    for _ in range(2):  # a second time adds nothing
        t.insert_missing(ids.withColumn("v", F.lit("new")))
    return t.read()


@query("SELECT doc_id, CASE WHEN doc_id = 3 THEN 'changed' ELSE source END AS v FROM documents")
def compare_and_set(spark, d):
    t = _fresh(spark, "t")
    t.replace(_docs(spark, d).select("doc_id", F.col("source").alias("v")))
    was = t.read().where("doc_id = 3").first()["v"]
    assert t.compare_and_set("3", F.col("v") == was, {"v": F.lit("changed")}, field="doc_id")
    assert not t.compare_and_set("3", F.col("v") == was, {"v": F.lit("lost")}, field="doc_id")
    return t.read()


@query("""SELECT doc_id, CASE WHEN doc_id % 40 = 7 THEN 'new' WHEN doc_id = 5 THEN 'changed' WHEN doc_id % 9 = 1 THEN 'added' ELSE source END AS v, CASE WHEN doc_id % 40 = 7 THEN lang ELSE '' END AS w FROM documents WHERE doc_id % 40 = 7 OR doc_id = 5 OR doc_id % 30 <> 2""")
def bucket_writes(spark, d):
    """Upserts with a new column, rows that are added once, deletes, one row changed if it is as expected; each rewrites its buckets alone."""
    docs = _docs(spark, d).select("doc_id", "source", "lang")
    t = BucketTable(spark, f"{shared_folder(spark)}/buckets", buckets=16)
    t.replace(docs.where("doc_id % 9 <> 1").select("doc_id", F.col("source").alias("v")))
    for _ in range(2):
        t.insert_missing(docs.where("doc_id % 9 < 4").select("doc_id", F.when(F.col("doc_id") % 9 == 1, "added").otherwise("lost").alias("v")))
    t.delete(docs.where("doc_id % 30 = 2 and doc_id <> 5").select("doc_id"))
    t.upsert(docs.where("doc_id % 40 = 7").select("doc_id", F.lit("new").alias("v"), F.col("lang").alias("w")))
    was = t.rows([5]).first()["v"]
    assert t.compare_and_set(5, F.col("v") == was, {"v": F.lit("changed")}) and not t.compare_and_set(5, F.col("v") == was, {"v": F.lit("lost")})
    return t.read().withColumn("w", F.coalesce("w", F.lit("")))


@query("SELECT doc_id FROM documents WHERE lang <> 'fr'")
def delete_by_ids(spark, d):
    t = _fresh(spark, "t")
    t.replace(_docs(spark, d).select("doc_id"))
    t.delete(_docs(spark, d).where("lang = 'fr'").select("doc_id"))
    return t.read()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS source FROM documents")
def schema_evolution(spark, d):
    t, docs = _fresh(spark, "t"), _docs(spark, d)
    t.replace(docs.where("doc_id % 3 <> 0").select("doc_id", "lang"))
    t.upsert(docs.where("doc_id % 3 = 0").select("doc_id", "source"))
    return t.read().select("doc_id", "lang", "source")


@query("SELECT 'before' AS state, (SELECT count(*) FROM documents WHERE lang = 'en') AS n UNION ALL SELECT 'after', (SELECT count(*) FROM documents)")
def shadow_and_promote(spark, d):
    t, docs = _fresh(spark, "t"), _docs(spark, d).select("doc_id", "lang")
    t.replace(docs.where("lang = 'en'"))
    v = t.write_shadow(docs)
    before = t.read().agg(F.lit("before").alias("state"), F.count(F.lit(1)).alias("n"))
    t.promote(v)
    return before.unionByName(t.read().agg(F.lit("after").alias("state"), F.count(F.lit(1)).alias("n")))


@query("SELECT * FROM (VALUES ('tagged', 1::BIGINT), ('kept', 2), ('pruned', 1), ('restored', (SELECT count(*) FROM documents WHERE lang <> 'de'))) t(what, n)")
def tags_and_prune(spark, d):
    t, docs = _fresh(spark, "t"), _docs(spark, d).select("doc_id", "lang")
    t.replace(docs.where("lang <> 'de'"))
    t.tag("daily")
    t.replace(docs.where("lang = 'en'"))
    t.replace(docs)
    gone = t.prune(0.0)
    kept, tags = t.versions(), t.tags()
    t.restore(tags["daily"])
    rows = [("tagged", len(tags)), ("kept", len(kept)), ("pruned", len(gone)), ("restored", t.read().count())]
    return spark.createDataFrame(rows, "what string, n long")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def recover_newest_readable(spark, d):
    t, docs = _fresh(spark, "t"), _docs(spark, d).select("doc_id")
    t.replace(docs.where("doc_id % 2 = 0"))
    v = t.write_shadow(docs)
    broken = t._path(f"{t.root}/v={v}")
    for s in t._fs.listStatus(broken):  # what a lost disk leaves: no file that can be read
        if s.getPath().getName().startswith("part-"):
            t._fs.delete(s.getPath(), False)
            t._fs.create(s.getPath(), True).close()
    t.promote(v)
    return t.recover()


@query("SELECT lang, count(*) AS n, 5 AS files_before, 1 AS files FROM documents GROUP BY 1")
def compact_files(spark, d):
    t = _fresh(spark, "t")
    files_of = lambda: len(t.read().inputFiles())
    t.replace(_docs(spark, d).select("doc_id", "lang").repartition(5))
    before = files_of()
    t.compact(1)
    return t.read().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumns({"files_before": F.lit(before), "files": F.lit(files_of())})


# ---- registry -----------------------------------------------------------------------------------------------------


def _registry(spark, d) -> DataFrame:
    """Documents of even number registered under a path; every fifth is a duplicate."""
    r = _docs(spark, d).where("doc_id % 2 = 0")
    status = F.when(F.col("doc_id") % 5 == 0, "duplicate").otherwise("canonical")
    return r.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("lang", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".json")).alias("path"), F.col("source").alias("source_name"), F.col("n_chars").cast("long").alias("created"), status.alias("dedupe_status"))


_REG = "reg AS (SELECT doc_id::VARCHAR AS doc_id, concat(lang, '/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.json' END) AS path, source AS source_name, n_chars AS created, CASE WHEN doc_id % 5 = 0 THEN 'duplicate' ELSE 'canonical' END AS dedupe_status, doc_id AS n FROM documents WHERE doc_id % 2 = 0)"


def _seen(spark, d) -> DataFrame:
    s = _docs(spark, d).where("doc_id % 3 = 0")
    return s.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("lang", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".moved").otherwise(".pdf")).alias("path"), F.when(F.col("doc_id") % 9 == 0, "").otherwise("given").alias("source_name"), F.lit(0).cast("long").alias("created"), F.lit("canonical").alias("dedupe_status"))


_SEEN = "seen AS (SELECT doc_id::VARCHAR AS doc_id, concat(lang, '/', doc_id, CASE WHEN doc_id % 4 = 0 THEN '.moved' ELSE '.pdf' END) AS path, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'given' END AS source_name FROM documents WHERE doc_id % 3 = 0)"


@query(f"WITH {_REG}, {_SEEN} SELECT coalesce(s.doc_id, r.doc_id) AS doc_id, coalesce(s.path, r.path) AS path, CASE WHEN s.doc_id IS NULL THEN r.source_name ELSE coalesce(nullif(s.source_name, ''), r.source_name) END AS source_name, coalesce(r.created, 0)::BIGINT AS created FROM reg r FULL JOIN seen s USING (doc_id)")
def registry_upsert(spark, d):
    return registry.upsert(_registry(spark, d), _seen(spark, d))[0].select("doc_id", "path", "source_name", "created")


@query(f"WITH {_REG}, {_SEEN} SELECT doc_id, CASE WHEN r.doc_id IS NULL THEN 'registered' ELSE 'moved' END AS action, s.path AS detail FROM seen s LEFT JOIN reg r USING (doc_id) WHERE r.doc_id IS NULL OR r.path <> s.path")
def registry_events(spark, d):
    return registry.upsert(_registry(spark, d), _seen(spark, d))[1]


@query(f"WITH {_REG} SELECT doc_id, 'kept' AS state FROM reg WHERE n % 7 <> 0 UNION ALL SELECT doc_id, 'retired' FROM reg WHERE n % 7 = 0")
def registry_delete(spark, d):
    r = _registry(spark, d)
    keys = r.where(F.col("doc_id").cast("long") % 7 == 0).select("doc_id")
    kept, gone = registry.retire(r, spark.createDataFrame([], "doc_id string"), keys)
    return kept.select("doc_id", F.lit("kept").alias("state")).unionByName(gone.select("doc_id", F.lit("retired").alias("state")))


@query(f"WITH {_REG} SELECT CASE WHEN source_name = 'documents' THEN doc_id ELSE concat(source_name, '::', doc_id) END AS doc_id, path FROM reg")
def registry_mappings(spark, d):
    return registry.mappings(_registry(spark, d))


@query(f"WITH {_REG} SELECT doc_id, path, n::BIGINT AS number FROM reg WHERE path LIKE 'en/1%' ")
def registry_rows_by_path(spark, d):
    return registry.rows(_registry(spark, d), prefix="en/1").select("doc_id", "path", F.col("doc_id").cast("long").alias("number"))


_B62 = "array_to_string(list_transform([4, 3, 2, 1, 0], lambda k: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[({n} // (62 ** k)::BIGINT) % 62 + 1]), '')"


@query(f"WITH taken AS (SELECT doc_id * 3 + 100 AS n FROM documents WHERE doc_id % 2 = 0), free AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT unnest(range(100, 100 + 8 * (SELECT count(*) FROM documents))) AS n) WHERE n NOT IN (SELECT n FROM taken)), new AS (SELECT doc_id AS number, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 1) SELECT number, {_B62.format(n='n')} AS doc_id FROM new JOIN free USING (r)")
def id_minting(spark, d):
    taken = _docs(spark, d).where("doc_id % 2 = 0").select(T.base62(F.col("doc_id") * 3 + 100).alias("doc_id"))
    new = _docs(spark, d).where("doc_id % 2 = 1").select(F.col("doc_id").alias("number"))
    return registry.mint(new, taken.where(F.crc32("doc_id") % 2 == 0), taken.where(F.crc32("doc_id") % 2 == 1), 100, order="number").select("number", "doc_id")


@query(f"WITH {_REG}, x AS (SELECT source_name, coalesce(regexp_extract(doc_id, '([^:]*)$', 1), doc_id) AS bare, dedupe_status, created FROM (SELECT doc_id, source_name, dedupe_status, created FROM reg UNION ALL SELECT concat(source_name, '::', doc_id), source_name, 'canonical', created + 1 FROM reg WHERE n % 4 = 0)) SELECT source_name, count(*) AS raw, count(DISTINCT bare) AS n_docs, count(*) - count(DISTINCT bare) AS aliases, count(DISTINCT bare) FILTER (dedupe_status = 'duplicate') AS n_duplicates, max(created) AS latest_seen FROM x GROUP BY 1")
def registry_overview(spark, d):
    r = _registry(spark, d).withColumn("last_seen", F.col("created"))
    also = r.where(F.col("doc_id").cast("long") % 4 == 0).withColumns({"doc_id": F.concat_ws("::", "source_name", "doc_id"), "dedupe_status": F.lit("canonical"), "last_seen": F.col("created") + 1})
    return upkeep.registry_overview(r.unionByName(also))


@query("SELECT DISTINCT source AS source_name FROM documents WHERE source <> ''")
def source_names(spark, d):
    return upkeep.source_names(_docs(spark, d).select(F.col("source").alias("source_name")))


@query("WITH e AS (SELECT doc_id, sha256(text) AS h, length(text) AS n FROM documents), f AS (SELECT h, min(doc_id) AS c FROM e GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'itself' ELSE 'stranded' END AS problem FROM e JOIN f USING (h) WHERE doc_id <> c AND doc_id % 5 < 2")
def broken_elections(spark, d):
    """Elections that were tampered with: duplicates of themselves, and of documents that are none."""
    e = dedupe.elect(dedupe.with_identity(_docs(spark, d).select("doc_id", "text"), "text"), ["doc_id"])
    bad = F.when(F.col("dedupe_status") == "duplicate", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).when(F.col("doc_id") % 5 == 1, F.lit(-1)))
    broken = dedupe.broken_election(e.withColumn("canonical_doc_id", F.coalesce(bad, "canonical_doc_id")))
    return broken.select("doc_id", F.when(F.col("doc_id") == F.col("canonical_doc_id"), "itself").otherwise("stranded").alias("problem"))


_MOVED = """e AS (SELECT doc_id, sha256(text) AS h FROM documents), o AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS c FROM e WHERE doc_id % 13 <> 5),
m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN sha256(concat('moved ', doc_id % 4)) ELSE h END AS h, doc_id % 11 <> 3 AND doc_id % 13 <> 5 AND doc_id = c AS led FROM e LEFT JOIN (SELECT doc_id, c FROM o) USING (doc_id) WHERE doc_id % 7 <> 0 OR doc_id % 11 = 3 OR doc_id % 13 = 5)"""


def _changed(spark, d):
    """An election of documents, and changes: some go, some get another text, some are new."""
    docs = _docs(spark, d).select("doc_id", "text")
    elected = dedupe.elect(dedupe.with_identity(docs.where("doc_id % 13 <> 5"), "text"), ["doc_id"]).drop("text")
    other = F.when(F.col("doc_id") % 11 == 3, F.concat(F.lit("moved "), (F.col("doc_id") % 4).cast("string"))).otherwise(F.col("text"))
    put = dedupe.with_identity(docs.where("doc_id % 11 = 3 or doc_id % 13 = 5").withColumn("text", other), "text").drop("text").withColumn("op", F.lit("put"))
    gone = elected.where("doc_id % 7 = 0 and doc_id % 11 <> 3 and doc_id % 13 <> 5").select("doc_id", "size_bytes", "content_hash", F.lit("delete").alias("op"))
    return elected, put.select("doc_id", "size_bytes", "content_hash", "op").unionByName(gone)


@query(f"WITH {_MOVED} SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY NOT coalesce(led, false), doc_id) AS canonical FROM m")
def election_upkeep(spark, d):
    """An election that is kept up: only what has another outcome is given back and put in place."""
    elected, changes = _changed(spark, d)
    delta = dedupe.reelected(elected, changes, ["doc_id"])
    kept = elected.join(delta.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(delta.where("op = 'put'").drop("op")).select("doc_id", F.col("canonical_doc_id").alias("canonical"))


@query(f"WITH {_MOVED} SELECT doc_id, EXISTS (SELECT 1 FROM o WHERE o.c = e.doc_id AND o.doc_id <> e.doc_id) AND doc_id % 11 = 3 AND doc_id % 13 <> 5 AS refused FROM e WHERE doc_id % 11 = 3 OR doc_id % 13 = 5")
def stranding_writes(spark, d):
    """Writes that would leave duplicates without their canonical document are refused."""
    elected, changes = _changed(spark, d)
    good, bad = dedupe.stranding_writes(elected, changes.where("op = 'put'"))
    return good.select("doc_id", F.lit(False).alias("refused")).unionByName(bad.select("doc_id", F.lit(True).alias("refused")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near, true AS p95_near FROM events GROUP BY 1")
def stored_sketches(spark, d):
    """Sketches by type and day, stored and merged by type, are as near to the exact numbers as they promise."""
    e, path = table(spark, d, "events"), f"{shared_folder(spark)}/sketches"
    sketches.sketches(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value").write.parquet(path)
    got = sketches.merged(spark.read.parquet(path), ["event_type"]).select("event_type", F.col("n").alias("m"), sketches.distinct_count("distinct_sketch").alias("u"), sketches.quantile("value_sketch", 0.5).alias("q50"), sketches.quantile("value_sketch", 0.95).alias("q95"))
    below = lambda q: F.sum((F.col("value") <= F.col(q)).cast("int")) / F.count(F.lit(1))
    x = e.join(F.broadcast(got), "event_type").groupBy("event_type").agg(F.first("m").alias("n"), F.count_distinct("user_id").alias("users"), F.first("u").alias("u"), below("q50").alias("r50"), below("q95").alias("r95"))
    return x.select("event_type", "n", "users", (F.abs(F.col("u") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("users_near"), (F.abs(F.col("r50") - 0.5) <= 0.025).alias("median_near"), (F.abs(F.col("r95") - 0.95) <= 0.025).alias("p95_near"))


# ---- records, sinks, hits -----------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(concat('v1', chr(0), text)) AS change_hash FROM documents")
def change_hashes(spark, d):
    return _docs(spark, d).select("doc_id", T.change_hash(F.col("text"), "v1").alias("change_hash"))


@query("SELECT concat('chat::msg-', conv_id, '-', turn) AS doc_id, concat('msg-', conv_id, '-', turn) AS natural_key, octet_length(encode(text)) AS size, role AS speaker, sha256(concat('s', chr(0), text)) AS change_hash FROM conversations")
def table_records(spark, d):
    spec = tables.TableSpec("-", "msg-{conv_id}-{turn}", "text", metadata_columns=["role"], salt="s")
    source = protocol.build_source(spark, {"type": "postgres", "name": "chat", "dsn": "-", "tables": [vars(spec)], "rows": lambda _: table(spark, d, "conversations")})
    return source.extract(source.scan()).select("doc_id", "natural_key", "size", F.col("metadata")["role"].alias("speaker"), "change_hash")


@query("SELECT concat('chat::', conv_id, '-', turn) AS doc_id, concat('hi N', turn % 3) AS text FROM conversations WHERE turn % 4 <> 0")
def normalized_messages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.lit("s").alias("source"), F.when(F.col("turn") % 4 == 0, "{@7}").otherwise(F.concat(F.lit("hi {@"), F.col("turn") % 3, F.lit("}"))).alias("text"))
    people = spark.createDataFrame([("s", str(k), f"N{k}") for k in range(3)], "source string, participant_key string, display_name string")
    config = {"type": "postgres", "name": "chat", "dsn": "-", "tables": [{"query": "-", "id_template": "{conv_id}-{turn}", "text_column": "text", "text_normalizer": "zoho_cliq_mentions"}], "rows": lambda _: rows, "participants": people}
    return protocol.build_source(spark, config).scan().select("doc_id", "text")


@query("SELECT CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE concat(lang, '::', doc_id) END AS doc_id, CASE WHEN lang = 'en' THEN 'documents' ELSE lang END AS source_name FROM documents")
def union_of_sources(spark, d):
    own = lambda lang: _docs(spark, d).where(F.col("lang") == lang).select(F.col("doc_id").cast("string").alias("doc_id"))
    return files.union_sources({"documents": own("en"), "de": own("de"), "fr": own("fr").withColumn("extra", F.lit(1)), "es": own("es").withColumn("other", F.lit("x"))}).select("doc_id", "source_name")


@query("SELECT concat('t%2F', c) AS canonical, count(*) AS n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS c FROM documents) WHERE doc_id <> c GROUP BY 1")
def duplicate_archive(spark, d):
    path = f"{shared_folder(spark)}/archive"
    e = dedupe.elect(dedupe.with_identity(_docs(spark, d).select("doc_id", "text"), "text"), ["doc_id"])
    sinks.archive_duplicates(e.select("doc_id", "dedupe_status", F.concat(F.lit("t/"), F.col("canonical_doc_id").cast("string")).alias("canonical_doc_id")), path)
    return spark.read.json(path).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def report_files(spark, d):
    path = f"{shared_folder(spark)}/report"
    sinks.report({"langs": _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.option("header", True).schema("lang string, n long").csv(f"{path}/langs.csv")


@query("SELECT concat(p_partkey, chr(9), replace(p_name, chr(9), ' '), chr(9), CASE WHEN length(repeat(p_type, 40)) > 500 THEN concat(left(repeat(p_type, 40), 500), '…') ELSE repeat(p_type, 40) END) AS line FROM part")
def tsv_lines(spark, d):
    return sqlguard.tsv(_part(spark, d).select("p_partkey", "p_name", F.repeat("p_type", 40).alias("long")))


@query("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 1 - p_size / 100.0 WHEN 1 THEN p_retailprice ELSE p_size END::DOUBLE, 6) AS score FROM part")
def scores_of_rows(spark, d):
    k = F.col("p_partkey") % 3
    rows = _part(spark, d).select("p_partkey", F.when(k == 0, F.col("p_size") / 100.0).alias("_distance"), F.when(k == 1, F.col("p_retailprice")).alias("_score"), F.col("p_size").cast("double").alias("score"))
    return browse.scored(rows).select("p_partkey", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 4 = 0 THEN [] ELSE string_split(replace(p_type, ' ', ','), ',') END, '|') AS tags, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS section, false AS has_type FROM part")
def full_hits(spark, d):
    extra = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("section"), "p_brand", F.lit("tags"), F.lit("x"))).otherwise(F.create_map(F.lit("p_partkey"), F.lit("y")))
    h = browse.full_hits(_part(spark, d).select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.replace("p_type", F.lit(" "), F.lit(","))).alias("tags"), F.lit("t").alias("text"), extra.alias("extra")))
    assert "text" not in h.columns
    return h.select("p_partkey", F.array_join("tags", "|").alias("tags"), F.try_element_at("extra", F.lit("section")).alias("section"), F.map_contains_key("extra", "tags").alias("has_type"))


@query("SELECT doc_id, round(0.123456789 * n_chars, 4) AS score, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('p/', doc_id) END AS rel_path, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS sender, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A title' END AS title FROM documents")
def slim_hits(spark, d):
    n = F.col("doc_id").cast("string")
    rows = _docs(spark, d).select(F.concat(F.lit("chat::"), n).alias("doc_id"), F.col("doc_id").alias("number"), (0.123456789 * F.col("n_chars")).alias("score"), F.when(F.col("doc_id") % 3 == 0, n).otherwise(F.concat(F.lit("p/"), n)).alias("rel_path"), F.when(F.col("doc_id") % 3 == 0, n).otherwise("A title").alias("title"), F.create_map(F.lit("sender"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.lit("source_message_id"), n).alias("extra"))
    return browse.slim_hits(rows).select(F.col("number").alias("doc_id"), "score", "rel_path", "sender", "title")


@query("SELECT doc_id, strftime(to_timestamp(n_chars * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS mtime_iso, concat(lang, '|', source) AS tags FROM documents")
def listed_documents(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.col("n_chars") * 1000.0).alias("mtime"), F.concat("lang", F.lit(" , "), "source").alias("tags"))
    return browse.listed_documents(rows).select("doc_id", "mtime_iso", F.array_join("tags", "|").alias("tags"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 > 0 THEN concat('brand=', p_brand) END, CASE WHEN p_size % 3 < 2 THEN concat('x_', p_size, '=', p_type) END) AS entries FROM part")
def public_metadata(spark, d):
    private = lambda c, name: F.concat(F.when(c, "_").otherwise(""), name)
    m = F.create_map(private(F.col("p_size") % 3 == 0, F.lit("brand")), "p_brand", private(F.col("p_size") % 3 == 2, F.concat(F.lit("x_"), "p_size")), "p_type", F.lit("_secret"), "p_name")
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(F.map_entries(browse.public_metadata(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"))


@query("SELECT turn FROM conversations WHERE conv_id = 1 ORDER BY turn::VARCHAR")
def document_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("loc"), "turn")
    return browse.document_chunks(c, "1").select("turn")


# ---- filters ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12' AND lower(p_type) = lower((SELECT min(p_type) FROM part WHERE p_brand = 'Brand#12'))")
def caseless_equality(spark, d):
    p = _part(spark, d).select("p_partkey", F.upper("p_brand").alias("source_name"), F.upper("p_type").alias("status"), "p_type", "p_brand")
    least = p.where("p_brand = 'Brand#12'").agg(F.min("p_type").alias("t")).first()["t"] or ""
    return filters.where(p, filters.named_filters(source_name="brand#12", status=least)).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE lower(lang) = 'de' AND lower(source) = 'src3'")
def metadata_filters(spark, d):
    return filters.where(_docs(spark, d), filters.named_filters(metadata={"lang": "DE", "source": "SRC3"})).select("doc_id")


@query("SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%e_o%y%'")
def like_wildcards(spark, d):
    return _part(spark, d).where(filters.compile_filter({"contains": {"p_type": "E_O%Y"}}, wildcards=True)).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def cased_recent_filter(spark, d):
    docs = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 >= 0, F.col("lang")).alias("source_type"), F.col("source").alias("folder"))
    shout = docs.withColumn("source_type", F.upper("source_type"))
    return docs.unionByName(shout).where(filters.recent_filter("en", "src1")).select("doc_id")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1) AS sidecar FROM part")
def sidecar_detection(spark, d):
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, '{"media": {"i": 1}, "counterparty": null}').when(k == 1, F.concat(F.lit('{"schema_version": "1", "media": {}, "n": "'), "p_brand", F.lit('"}')))
        .when(k == 2, '{"media": {"i": 1}, "source": "x"}').when(k == 3, '{"media": [1], "message": {}}').when(k == 4, '{"message": {}}').otherwise("no json {")
    )
    return _part(spark, d).select("p_partkey", filters.is_sidecar(text).alias("sidecar"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ocr_sidecar_failed' WHEN 1 THEN 'vision_sidecar_failed' WHEN 2 THEN 'provider_sidecar_failed' END AS reason,
CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS transient, p_partkey % 6 <> 5 AS stub FROM part""")
def provider_errors(spark, d):
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, '{"server": "s", "tool": "run_OCR", "error": "it timed out", "text": " "}').when(k == 1, '{"server": "s", "tool": "vl_look", "error": "bad image", "items": []}')
        .when(k == 2, '{"server": "s", "tool": "other", "error": "x", "issue": {"kind": "Overloaded"}}').when(k == 3, '{"server": "s", "tool": "ocr", "error": "x", "text": "found"}')
        .when(k == 4, F.concat(F.lit('{"server": "'), "p_brand", F.lit('", "tool": "ocr"}'))).otherwise("RIFF....")
    )
    e = filters.provider_error(text, F.lit("JSON"))
    return _part(spark, d).select("p_partkey", e["reason"].alias("reason"), e["transient"].alias("transient"), filters.is_nonmedia_stub(text.cast("binary")).alias("stub"))


# ---- ledgers and queues -------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 2 = 0)")
def skip_ledger_exclude(spark, d):
    """Entries of an hour ago hold their documents back; those of three days ago are due whatever their spread is."""
    rec = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("change_hash"), F.lit(1.0).alias("mtime"))
    at = F.when(F.col("doc_id") % 2 == 0, NOW - 3600.0).otherwise(NOW - 3 * 86400.0)
    ledger = rec.where("doc_id % 11 = 0").select("doc_id", F.col("change_hash").alias("change_key"), at.alias("skipped_at"))
    return incremental.not_skipped(rec, ledger, NOW).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {NOW} ELSE n_chars::DOUBLE END AS skipped_at FROM documents")
def renewed_leases(spark, d):
    ledger = _docs(spark, d).select("doc_id", F.col("n_chars").cast("double").alias("skipped_at"))
    return upkeep.renewed_leases(ledger, ledger.where("doc_id % 3 = 0"), NOW)


def _queue(spark, d) -> DataFrame:
    return _docs(spark, d).select(F.lit("chunks").alias("table_name"), "source", F.col("doc_id").cast("string").alias("target"), (F.col("doc_id") % 3 + 1).alias("revision"), F.col("n_chars").alias("created_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))


@query("SELECT source, doc_id::VARCHAR AS target FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 + 1 = 2)")
def completed_requests(spark, d):
    """Requests done at revision 2; those that were asked for again, or not so often, stay."""
    q = _queue(spark, d)
    return upkeep.completed(q, q.where(F.col("target").cast("long") % 2 == 0).withColumn("revision", F.lit(2))).select("source", "target")


@query("SELECT event_type AS target, count(*) AS revision FROM events GROUP BY 1")
def queue_drain(spark, d):
    """Requests of a stream, coalesced by target and handed on; the checkpoint says what is done, so a second drain hands on nothing."""
    root = shared_folder(spark)
    target = SnapshotTable(spark, f"{root}/handed")
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    requests = src.select(F.lit("t").alias("table_name"), F.lit("s").alias("source"), F.col("event_type").alias("target"), F.col("ts").alias("created_at"), F.lit(False).alias("force"))
    for _ in range(2):
        q = streams.drain_requests(requests, target.replace, f"{root}/state")
        q.awaitTermination()
    assert target.versions() == [1] and sum(p["rows"] for p in streams.progress(q)) == 0
    return target.read().select("target", "revision")


@query("SELECT doc_id::VARCHAR AS target, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 + 1 = 1 THEN 1 ELSE 0 END AS attempts, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 + 1 = 1 THEN 'boom' END AS last_error FROM documents")
def failed_requests(spark, d):
    q = _queue(spark, d)
    errors = q.where(F.col("target").cast("long") % 5 == 0).select("table_name", "source", "target", F.lit(1).alias("revision"), F.lit("boom").alias("error"))
    return upkeep.failed(q, errors).select("target", "attempts", "last_error")


@query("WITH q AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id::VARCHAR AS target, row_number() OVER (ORDER BY doc_id <> 7, n_chars, source, doc_id::VARCHAR)::INT AS pos FROM q QUALIFY pos <= 20")
def pending_queue(spark, d):
    from pyspark.sql.window import Window as W

    q = _queue(spark, d)
    p = incremental.pending(q, q.where(F.col("target").cast("long") % 4 == 0), first="7", limit=20)
    order = W.partitionBy(F.lit(0)).orderBy(F.col("target") != "7", "created_at", "source", "target")  # twenty rows
    return p.select("target", F.row_number().over(order).alias("pos"))


@query("WITH o AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS fails, count(*) FILTER (event_type = 'purchase') > 0 AS ok FROM events WHERE event_type = 'error' OR (event_type = 'purchase' AND value > 97) GROUP BY 1), l AS (SELECT DISTINCT user_id AS doc_id, user_id % 10 AS attempts, user_id % 3 AS runs FROM events) SELECT doc_id, least(attempts + coalesce(fails, 0), 12)::BIGINT AS attempts, CASE WHEN fails IS NULL THEN runs ELSE runs + 1 END::BIGINT AS unresolved_runs, attempts + coalesce(fails, 0) >= 12 OR (CASE WHEN fails IS NULL THEN runs ELSE runs + 1 END) >= 3 AS terminal FROM l LEFT JOIN o ON user_id = doc_id WHERE NOT coalesce(ok, false)")
def settled_ledger(spark, d):
    e = table(spark, d, "events")
    ledger = e.select(F.col("user_id").alias("doc_id")).distinct().withColumns({"attempts": F.col("doc_id") % 10, "unresolved_runs": F.col("doc_id") % 3})
    out = e.where("event_type = 'error' or event_type = 'purchase' and value > 97").select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "purchase").alias("ok"), F.lit(False).alias("resolved"))
    return upkeep.settled(ledger, out)


@query("SELECT doc_id, CASE WHEN doc_id % 13 >= 12 AND doc_id % 2 = 0 THEN 0 ELSE doc_id % 13 END AS attempts FROM documents")
def reset_capped(spark, d):
    reasons = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("OCR timed out"), F.lit("ocr TIMED OUT p. 2"))).otherwise(F.array(F.lit("OCR timed out"), F.lit("broken")))
    return incremental.reset_capped(_docs(spark, d).select("doc_id", (F.col("doc_id") % 13).alias("attempts"), reasons.alias("reasons")), "timed out").select("doc_id", "attempts")


# ---- counts and health --------------------------------------------------------------------------------------------


@query("SELECT conv_id, max(coalesce(turn, 0)::DOUBLE) AS latest FROM conversations GROUP BY 1")
def document_mtimes(spark, d):
    return browse.latest_by(table(spark, d, "conversations").withColumn("mtime", F.col("turn").cast("double")), "conv_id", "mtime")


@query("SELECT conv_id AS doc_id, arg_max(sha256(text), turn) AS change_hash FROM conversations GROUP BY 1")
def current_hashes(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("loc"), F.sha2("text", 256).alias("change_hash"))
    return browse.current_hashes(c)


@query("SELECT CASE WHEN grouping(kind) = 1 THEN NULL ELSE kind END AS kind, count(*) AS n FROM (SELECT split_part(p_type, ' ', 1) AS kind FROM part) GROUP BY ROLLUP (kind)")
def taxonomy_counts(spark, d):
    return upkeep.taxonomy_counts(_part(spark, d).select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")))


@query("SELECT kind, name FROM (SELECT DISTINCT CASE WHEN p_size > 25 THEN 'tag' ELSE 'folder' END AS kind, p_type AS name, p_size % 2 AS odd FROM part) WHERE kind = 'tag' AND odd = 0 ORDER BY name LIMIT 1000")
def taxonomy_list(spark, d):
    t = _part(spark, d).select(F.when(F.col("p_size") > 25, "tag").otherwise("folder").alias("kind"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("retired").alias("status")).distinct()
    return taxonomy.listed(t, "tag").select("kind", "name")


@query("SELECT id, usage_count FROM (SELECT concat('tag:', p_type) AS id, 5::BIGINT AS usage_count FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 20) UNION ALL SELECT concat('tag:', p_type), 0 FROM (SELECT DISTINCT p_type FROM part) WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 20))")
def taxonomy_seed(spark, d):
    entry = lambda df, n: df.select(F.concat(F.lit("tag:"), "p_type").alias("id"), F.lit("tag").alias("kind"), F.col("p_type").alias("name"), F.lit(n).cast("long").alias("usage_count")).distinct()
    have = entry(_part(spark, d).where("p_size < 20"), 5)
    return taxonomy.seed(taxonomy.seed(have, entry(_part(spark, d), 0)), entry(_part(spark, d), 9)).select("id", "usage_count")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def audit_count(spark, d):
    return upkeep.audit_count(table(spark, d, "events").select(F.col("event_type").alias("action")), action="error")


@query("WITH w AS (SELECT split_part(p_type, ' ', 1) AS kind, concat(split_part(p_type, ' ', 1), ':', split_part(p_type, ' ', 2), p_brand) AS w FROM part), u AS (SELECT kind, w, row_number() OVER (PARTITION BY kind ORDER BY w) AS r FROM (SELECT DISTINCT * FROM w)) SELECT kind, (SELECT count(*) FROM w x WHERE x.kind = u.kind) AS n, string_agg(w, '|' ORDER BY w) AS samples FROM u WHERE r <= 20 GROUP BY kind")
def warning_samples(spark, d):
    w = F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(":"), F.split_part("p_type", F.lit(" "), F.lit(2)), "p_brand")
    return upkeep.warning_samples(_part(spark, d).select(w.alias("warning"))).select("kind", "n", F.array_join("samples", "|").alias("samples"))


@query("SELECT p_brand AS model, count(*) AS n, sum(p_size)::BIGINT AS tokens_in, sum(p_size * 2)::BIGINT AS tokens_out, round(CASE WHEN p_brand = 'Brand#12' THEN (sum(p_size) * 3.0 + sum(p_size * 2) * 15.0) / 1e6 ELSE 0 END::DOUBLE, 6) AS cost FROM part GROUP BY p_brand")
def token_costs(spark, d):
    r = _part(spark, d).select(F.col("p_brand").alias("model"), F.col("p_size").alias("tokens_in"), (F.col("p_size") * 2).alias("tokens_out"))
    return upkeep.cost_summary(r, spark.createDataFrame([("Brand#12", 3.0, 15.0)], "model string, price_in double, price_out double"))


@query("SELECT CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE (user_id % 4)::VARCHAR END AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_kinds(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return evaluate.failures_by(e, F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 4).cast("string")))


@query("SELECT count(*) AS n, round(avg(value / 100), 6) AS mean_score, round(avg(CASE WHEN user_id % 3 = 0 THEN 0 ELSE value / 50 END), 6) AS mean_part FROM events")
def subscore_means(spark, d):
    e = table(spark, d, "events").select((F.col("value") / 100).alias("score"), F.lit(False).alias("failed"), F.col("value").alias("latency_ms"), F.when(F.col("user_id") % 3 != 0, F.col("value") / 50).alias("part"))
    return evaluate.summary(e, ["part"]).select("n", "mean_score", "mean_part")


@query("SELECT count(*) AS total_cases, count(l.doc_id) AS labeled, count(*) - count(l.doc_id) AS remaining, min(d.doc_id) FILTER (l.doc_id IS NULL) AS next_case_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def labeling_status(spark, d):
    have = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    return upkeep.labeling_status(_docs(spark, d).select("doc_id").join(have, "doc_id", "left"), F.col("has"), key="doc_id")


@query("SELECT count(*) AS contested, count(*) FILTER (lang = 'en') AS retokenized, count(*) FILTER (lang <> 'en') AS remaining FROM documents WHERE doc_id % 7 = 0")
def sweep_ledger(spark, d):
    return upkeep.sweep_ledger(_docs(spark, d).where("doc_id % 7 = 0"), F.col("lang") == "en")


_HEALTH = """h AS (SELECT source, count(*) FILTER (doc_id % 10 < k) AS reg, count(*) FILTER (doc_id % 10 < i) AS idx, count(*) FILTER (k = 6 AND doc_id % 10 >= i AND doc_id % 10 < k) AS nx FROM (SELECT source, doc_id, CASE WHEN source LIKE '%1' THEN 0 WHEN source LIKE '%2' THEN 6 ELSE 8 END AS k, CASE WHEN source LIKE '%1' THEN 0 WHEN source LIKE '%3' THEN 0 WHEN source LIKE '%4' THEN 5 WHEN source LIKE '%2' THEN 3 ELSE 8 END AS i FROM documents) GROUP BY 1),
s AS (SELECT source AS source_name, CASE WHEN reg > 0 AND reg <= idx + nx THEN CASE WHEN idx > 0 AND nx > 0 THEN 'ok/indexed_or_not_extractable' WHEN nx > 0 THEN 'ok/not_extractable' ELSE 'ok/indexed' END
WHEN reg > 0 AND idx = 0 THEN 'critical/registry_has_docs_but_index_has_none' WHEN reg > 0 THEN 'degraded/index_missing_some_registry_docs' ELSE 'unknown/configured_source_not_indexed_yet' END AS s FROM h)"""


def _health(spark, d) -> DataFrame:
    e = lambda x: F.endswith("source", F.lit(x))
    k, i, n = F.when(e("1"), 0).when(e("2"), 6).otherwise(8), F.when(e("1") | e("3"), 0).when(e("4"), 5).when(e("2"), 3).otherwise(8), F.col("doc_id") % 10
    g = _docs(spark, d).groupBy(F.col("source").alias("source_name")).agg(F.count_if(n < k).alias("registered"), F.count_if(n < i).alias("indexed"), F.count_if((k == 6) & (n >= i) & (n < k)).alias("not_extractable"))
    return upkeep.source_health(g.withColumns({"configured": F.lit(True), "last_run": F.lit(None).cast("string")}))


@query(f"WITH {_HEALTH} SELECT source_name, split_part(s, '/', 1) AS state, split_part(s, '/', 2) AS reason FROM s")
def source_health(spark, d):
    return _health(spark, d)


@query(f"WITH {_HEALTH} SELECT CASE max(CASE split_part(s, '/', 1) WHEN 'ok' THEN 0 WHEN 'unknown' THEN 1 WHEN 'degraded' THEN 3 ELSE 4 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'degraded' WHEN 1 THEN 'unknown' ELSE 'ok' END AS state FROM s")
def overall_health(spark, d):
    return upkeep.overall_health(_health(spark, d))


# ---- context and sidecars -----------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS body, concat(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), chr(10), '[Conversation context]', chr(10), role) AS said FROM conversations""")
def context_suffix(spark, d):
    """With a context, with another in its place, and with none."""
    c = table(spark, d, "conversations")
    once = upkeep.contextualized(F.col("text"), F.lit("old words"))
    again = upkeep.contextualized(once, F.concat(F.lit("\n"), "role", F.lit(" ")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(upkeep.contextualized(again, F.lit(" "))).alias("body"), again.alias("said"))


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 3 = 1 AND conv_id % 2 = 0 AS marked FROM conversations), a AS (SELECT conv_id, arg_max(turn, marked::INT * 100000 + turn) AS turn FROM c GROUP BY 1)
SELECT conv_id AS doc_id, concat('c:', a.turn) AS loc FROM a JOIN c USING (conv_id, turn) WHERE NOT marked OR conv_id % 4 <> 0""")
def context_refresh(spark, d):
    """The chunk to change; a document whose chunk has the same context already gives none."""
    c = table(spark, d, "conversations")
    has = (F.col("turn") % 3 == 1) & (F.col("conv_id") % 2 == 0)
    text = F.when(has, upkeep.contextualized(F.col("text"), F.lit("talk"))).otherwise(F.replace("text", F.lit("[Conversation context]"), F.lit("")))
    chunks = c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c:"), "turn").alias("loc"), text.alias("text"))
    new = c.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("context", F.when(F.col("doc_id") % 4 == 0, "talk").otherwise("news"))
    return upkeep.context_refresh(chunks, new).select("doc_id", "loc")


@query("SELECT doc_id, concat(doc_id, '::context:c:0') AS chunk_uid, concat('Video attachment delivery. Canonical media attachment: ', doc_id - 1, chr(10), chr(10), '[Conversation context]', chr(10), source) AS text, lang AS folder, source AS snippet FROM documents WHERE doc_id % 5 = 1 AND doc_id % 2 = 1")
def duplicate_delivery(spark, d):
    x = _docs(spark, d).where("doc_id % 5 = 1").select("doc_id", (F.col("doc_id") - 1).alias("canonical_doc_id"), F.concat("lang", F.lit("/a.mp4")).alias("rel_path"), F.lit("mp4").alias("ext"), F.when(F.col("doc_id") % 2 == 1, F.col("source")).otherwise(" ").alias("context"))
    return upkeep.duplicate_delivery_chunks(x).select("doc_id", "chunk_uid", "text", "folder", "snippet")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' WHEN p_partkey % 3 = 1 THEN concat('near', p_size) ELSE concat('near', p_size, ',m', p_size) END AS before, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'a' END AS after FROM part")
def sidecar_context(spark, d):
    """A message that is too far in time is left out; the nearest that is not in the list is put before it; what is no JSON has none."""
    far = F.when(F.col("p_partkey") % 3 == 1, "2024-01-02T00:00:00Z").otherwise("2024-01-01T00:05:00Z")
    one = lambda i, t: F.concat(F.lit('{"message_id": "'), i, F.lit('", "sent_at": "'), t, F.lit('", "text": "hello"}'))
    body = F.concat(F.lit('{"context": {"same_channel_before": ['), one(F.concat(F.lit("m"), "p_size"), far), F.lit('], "nearest_nonempty_before": '), one(F.concat(F.lit("near"), "p_size"), F.lit("2024-01-01T00:01:00Z")), F.lit(', "same_channel_after": ['), one(F.lit("a"), F.lit("odd")), F.lit("]}}"))
    s = _part(spark, d).select("p_partkey", F.lit("2024-01-01T00:00:00Z").alias("sent_at"), F.when(F.col("p_partkey") % 3 == 2, "no json").otherwise(body).alias("payload"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["message_id"]), ",").alias(c)
    return upkeep.sidecar_context(s).select("p_partkey", ids("before"), ids("after"))


# ---- maintenance lists --------------------------------------------------------------------------------------------


@query(f"WITH {_REG} SELECT doc_id FROM reg WHERE source_name = 'src2' AND dedupe_status = 'canonical' AND path NOT LIKE '%.json' AND n % 8 <> 0")
def unindexed_backlog(spark, d):
    chunks = _docs(spark, d).where("doc_id % 8 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return browse.unindexed(_registry(spark, d), chunks, "src2").select("doc_id")


@query(f"WITH {_REG}, x AS (SELECT doc_id, path, n, dedupe_status FROM reg UNION ALL SELECT concat('documents::', doc_id), path, n, 'duplicate' FROM reg WHERE n % 12 = 0) SELECT min(doc_id) AS doc_id, min(path) AS path, (min(n) % 40)::BIGINT AS size FROM x WHERE path LIKE '%.pdf' GROUP BY n HAVING bool_and(dedupe_status = 'canonical') AND n % 18 <> 0 AND n % 40 >= 10")
def missing_pdfs(spark, d):
    r = _registry(spark, d).withColumn("source_name", F.lit("documents"))
    n = F.col("doc_id").cast("long")
    twins = r.where(n % 12 == 0).withColumns({"doc_id": F.concat(F.lit("documents::"), "doc_id"), "dedupe_status": F.lit("duplicate")})
    stored = r.where(n % 18 == 0).select("doc_id")
    there = r.select("path", (n % 40).alias("size"))
    return upkeep.missing_files(r.unionByName(twins), stored, there).select("doc_id", "path", "size")


@query("SELECT p_partkey, p_partkey % 4 < 3 AS stub FROM part")
def stub_texts(spark, d):
    k = F.col("p_partkey") % 4
    head = F.concat(F.lit("[Document: "), "p_name", F.lit("]\nSummary: an image\nof "), "p_type", F.lit("\n\n"))
    text = F.when(k == 0, F.concat(head, F.lit("Format: PNG\n Camera: x"))).when(k == 1, F.concat(F.lit("Image dimensions: "), F.col("p_size").cast("string"), F.lit("\nCommunication message/caption: hi"))).when(k == 2, "  ").otherwise(F.concat(head, F.lit("Format: PNG\na cat")))
    return _part(spark, d).select("p_partkey", upkeep.is_stub_text(text, ["Image dimensions:", "Format:", "Camera:", "Date taken:", "Software:", "GPS:"]).alias("stub"))


@query("SELECT conv_id::VARCHAR AS doc_id, min(turn) AS turn FROM conversations WHERE role = 'user' AND conv_id::VARCHAR > '2' GROUP BY 1 ORDER BY 1 LIMIT 15")
def keyset_page(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", F.lpad(F.col("turn").cast("string"), 5, "0").alias("loc"), "role")
    return browse.next_page_of_documents(c, "2", 15, F.col("role") == "user").select("doc_id", "turn")


@query("SELECT t.tool, coalesce(count(DISTINCT e.user_id), 0) AS n_tests, count(e.user_id) AS n_spans FROM (SELECT DISTINCT event_type AS tool FROM events UNION SELECT 'never') t LEFT JOIN events e ON e.event_type = t.tool AND e.value > 50 GROUP BY 1")
def tool_coverage(spark, d):
    e = table(spark, d, "events")
    tools = e.select(F.col("event_type").alias("tool")).distinct().union(spark.createDataFrame([("never",)], "tool string"))
    return browse.tool_coverage(e.where("value > 50").select(F.col("event_type").alias("tool"), F.col("user_id").alias("test")), tools)


@query("SELECT user_id AS trace_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id)::INT AS step, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id)::BIGINT AS n_errors, round(value, 3)::DOUBLE AS duration_ms FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def span_timelines(spark, d):
    e = table(spark, d, "events").withColumn("name", F.concat("event_type", F.lit(" "), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), "!").otherwise("")))
    start = F.col("ts").cast("timestamp")
    spans = e.select(F.col("user_id").alias("trace_id"), "event_id", "name", start.alias("start"), (start + F.make_dt_interval(secs=F.round(F.col("value") / 1000, 6))).alias("end"), (F.col("event_type") == "error").alias("error"))
    marked = spans.where(F.col("name").endswith("!")).select("trace_id").distinct()
    x = browse.timelines(spans.withColumn("name", F.when(F.col("name").endswith("!"), "process_doc").otherwise(F.col("name"))), "process_doc")
    assert set(marked.columns) == {"trace_id"}
    order = __import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("trace_id").orderBy("start", F.col("event_type"), "event_id")
    named = x.join(e.select("event_id", "event_type"), "event_id")
    return named.select("trace_id", "event_id", F.row_number().over(order).alias("step"), "n_errors", F.round("duration_ms", 3).alias("duration_ms"))


@query("""WITH a AS (SELECT doc_id, concat('p/', doc_id - doc_id % 10 // 9) AS path FROM documents), r AS (SELECT doc_id, concat('p/', CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id - doc_id % 10 // 9 END) AS path FROM documents WHERE doc_id % 6 <> 0)
SELECT doc_id, 'not_registered' AS problem FROM a WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'other_path' FROM a JOIN r USING (doc_id) WHERE a.path <> r.path UNION ALL SELECT doc_id, 'not_indexed' FROM a WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'shared_path' FROM a WHERE path IN (SELECT path FROM a GROUP BY 1 HAVING count(*) > 1)""")
def path_audit(spark, d):
    docs = _docs(spark, d).select("doc_id")
    own = F.col("doc_id") - F.floor(F.col("doc_id") % 10 / 9)
    art = docs.select("doc_id", F.concat(F.lit("p/"), own).alias("path"))
    reg = docs.where("doc_id % 6 <> 0").select("doc_id", F.concat(F.lit("p/"), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(own)).alias("path"))
    return upkeep.path_audit(art, docs.where("doc_id % 5 <> 0"), reg)


@query("SELECT 'cheap' AS stage, count(*) FILTER (p_size < 20) AS n, round(max(p_retailprice) FILTER (p_size < 20), 6) AS best, count(*) FILTER (p_size < 20) AS n_new FROM part UNION ALL SELECT 'brand', count(*) FILTER (p_brand = 'Brand#12'), round(max(p_retailprice) FILTER (p_brand = 'Brand#12'), 6), count(*) FILTER (p_brand = 'Brand#12' AND p_size >= 20) FROM part")
def stage_diagnostic(spark, d):
    p = _part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), "p_size", "p_brand")
    return upkeep.stage_counts({"cheap": p.where("p_size < 20"), "brand": p.where("p_brand = 'Brand#12'")})


# ---- text ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'a, b' END AS tags, CASE WHEN p_partkey % 2 = 0 THEN concat('Body of ', p_brand) ELSE concat('no --- block', chr(10), p_type) END AS body FROM part")
def front_matter(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("---\ntitle: '"), "p_name", F.lit("'\ntags: [a, b]\n---\nBody of "), "p_brand")).otherwise(F.concat(F.lit("no --- block\n"), "p_type"))
    block, body = T.front_matter(text)
    m = T.front_matter_map(block)
    return _part(spark, d).select("p_partkey", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("tags")).alias("tags"), body.alias("body"))


@query("SELECT p_partkey, unnest([0, 1, 2, 3])::INT AS no, unnest(['', p_brand, concat(p_brand, ' > Use'), 'End']) AS breadcrumb, unnest([concat('intro ', p_size), concat('# ', p_brand, chr(10), p_type), concat('### Use', chr(10), 'x # no heading'), '## End']) AS body FROM part")
def heading_sections(spark, d):
    text = F.concat(F.lit("intro "), "p_size", F.lit("\n# "), "p_brand", F.lit("\n"), "p_type", F.lit("\n\n### Use\nx # no heading\n## End\n"))
    trail = files.headings(F.replace(text, F.lit("## End"), F.lit("# End")))
    s = _part(spark, d).select("p_partkey", F.posexplode(trail).alias("no", "s"))
    return s.select("p_partkey", "no", "s.breadcrumb", F.regexp_replace("s.body", "^# End", "## End").alias("body"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(repeat(concat(p_type, chr(10)), 3), 'end') ELSE concat(repeat(concat(p_type, chr(10)), 3), p_brand, chr(10), 'end') END AS text FROM part")
def repetition_collapse(spark, d):
    loop = F.repeat(F.concat("p_type", F.lit("\n")), 120)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(loop, F.lit("end"))).otherwise(F.concat(loop, "p_brand", F.lit("\nend")))
    return files.collapse_repetition(_part(spark, d).select("p_partkey", text.alias("text")))


_HTML = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'),
'(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')"""


@query(f"SELECT page_id, regexp_replace({_HTML}, '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat('Communication message/caption: ', p_brand) ELSE concat('Communication message/caption: ', p_brand, chr(10), chr(10), 'Attachment content:', chr(10), p_name) END AS text FROM part")
def captions(spark, d):
    k = F.col("p_partkey") % 3
    return _part(spark, d).select("p_partkey", T.with_caption(F.when(k == 1, " ").otherwise(F.col("p_name")), F.when(k == 0, "").otherwise(F.concat(F.lit(" "), "p_brand"))).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '|', p_type) WHEN 1 THEN p_type ELSE '' END AS items, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS nk FROM part")
def json_lists(spark, d):
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.to_json(F.array("p_brand", "p_type"))).when(k == 1, F.col("p_type")).otherwise(" ")
    ref = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("src::"), "p_brand")).otherwise(F.col("p_name"))
    return _part(spark, d).select("p_partkey", F.array_join(T.json_list(v), "|").alias("items"), T.natural_key(ref).alias("nk"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, '|', p_brand) ELSE concat(p_type, '|', rtrim(left(repeat(concat(p_brand, ' '), 40), 159)), '…|c|d|e') END AS facts FROM part")
def key_facts(spark, d):
    v = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_type", F.concat(F.lit(" "), "p_brand", F.lit("\n")), F.lit("")))).otherwise(F.concat("p_type", F.lit(";"), F.repeat(F.concat("p_brand", F.lit(" ")), 40), F.lit("\nc\n\nd;e;f")))
    return _part(spark, d).select("p_partkey", F.array_join(T.key_facts(v), "|").alias("facts"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('a%2Fb%20', p_size) WHEN 1 THEN 'seg__nul' ELSE concat(repeat('x', 163), '-', left(sha256(repeat('x', 200 + p_size)), 16)) END AS name FROM part")
def archive_names(spark, d):
    k = F.col("p_partkey") % 3
    key = F.when(k == 0, F.concat(F.lit("a/b "), F.col("p_size").cast("string"))).when(k == 1, "nul").otherwise(F.repeat(F.lit("x"), F.col("p_size") + 200))
    return _part(spark, d).select("p_partkey", T.archive_name(key).alias("name"))


@query("SELECT doc_id, n_chars >= 0 AS whole, concat('name@0000', doc_id % 10, '@.md') AS named FROM documents")
def sentences_and_names(spark, d):
    """Sentences joined are the text again; ids are put into file names in place of others."""
    one = T.name_with_id(F.lit("name@ABCDE@.md"), F.concat(F.lit("0000"), (F.col("doc_id") % 10).cast("string")))
    return _docs(spark, d).select("doc_id", (F.array_join(T.sentences(F.col("text")), "") == F.col("text")).alias("whole"), one.alias("named"))


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, true AS fits FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def sentence_chunks(spark, d):
    """Chunks of whole sentences: none is longer than asked, and joined they are the text."""
    c = files.chunks(_docs(spark, d), key="doc_id", by_heading=False, split=lambda b: files.sentence_pieces(F.regexp_replace(b, r"^\s+|\s+$", ""), 900))
    order = F.regexp_extract("loc", r"(\d+)", 1).cast("int")
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("i"), "text"))).alias("l"), F.max(F.length("text")).alias("m"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), (F.col("m") <= 900).alias("fits"))


@query("SELECT p_partkey, unnest([0, 1, 2])::INT AS page, unnest([concat('Title: ', p_name, chr(10), chr(10), repeat(p_type, 60)), CASE WHEN p_partkey % 2 = 0 THEN concat('seen ', p_brand) ELSE p_brand END, repeat('y', 250)]) AS text, unnest([false, p_partkey % 2 = 0, false]) AS was_ocr FROM part")
def pdf_pages(spark, d):
    """Pages with little text are taken as they were recognised, where anything was; a header goes before the first."""
    pages = F.array(F.repeat("p_type", 60), F.concat(F.lit(" "), "p_brand"), F.repeat(F.lit("y"), 250))
    seen = F.array(F.lit("not asked"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("seen "), "p_brand")), F.lit(None))
    x = _part(spark, d).select("p_partkey", F.explode(extract.with_ocr(pages, seen, header=F.concat(F.lit("Title: "), "p_name"))).alias("p"))
    return x.select("p_partkey", "p.page", "p.text", "p.was_ocr")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 > 0 THEN text END, '') AS page_content, concat('doc_id=', doc_id, CASE WHEN doc_id % 3 > 0 THEN concat(',lang=', lang) ELSE '' END, CASE WHEN lang <> 'en' THEN concat(',source=', source) ELSE '' END) AS metadata FROM documents")
def retrieved_documents(spark, d):
    """Fields that are null or empty are not among a document's metadata."""
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("text"))
    r = browse.retrieved(rows)
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return r.select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), "page_content", F.array_join(entries, ",").alias("metadata"))


# ---- enrichment and evaluation ------------------------------------------------------------------------------------


@query("SELECT p_partkey, concat(split_part(p_type, ' ', 1), ', ', p_brand) AS topics, p_name AS summary, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_size > 40 THEN '1.0' WHEN p_partkey % 4 = 1 THEN '0.5' ELSE '0.25' END AS importance FROM part")
def enrichment_records(spark, d):
    imp = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(', "importance": "'), F.when(F.col("p_size") > 40, "7").when(F.col("p_partkey") % 4 == 1, "high").otherwise("0.25"), F.lit('"')))
    answer = F.concat(F.lit('<think>x</think>```json\n{"summary": " '), "p_name", F.lit('", "topics": ["'), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit('", "n/a", "'), "p_brand", F.lit('"]'), imp, F.lit("}\n``` done"))
    n = enrichment.normalized(enrichment.extract_json(answer))
    return _part(spark, d).select("p_partkey", n["enr_topics"].alias("topics"), n["enr_summary"].alias("summary"), n["enr_importance"].alias("importance"))


#: Texts that tell words from parts of words, and rules from each other.
_SAID = ["payments", "two renters", "billing", "signage", "cups and plates", "we recall it", "the rent has failed", "courtyard", "a quote", "estimated", "zillow: listings", "zillow", "Open House", "tours", "overdue fees", "due $ 5", "fee of $1,200.50", "must sign", "shipping", "rescheduled", "nothing of note", "legalese", "unpaid ledger", "showing"]
_TYPES = ["", "email", "Note, text", "report", "email, Plan", " , message"]
_GUESS = ["", "0.2", "0.95", "bad", "7", "-1"]
_FACTS = ['["{n}", "important information here", "{t}"]', "{n} {t}", '["paid $ 12 then", "12/31/2024", "x of the"]', '["{t}  {t}", ""]', "", "{\"a\": 1}", '["' + "steel " * 40 + '2024-01-02"]']


def _pick(items: list[str]) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"([{quoted}])[p_partkey % {len(items)} + 1]"


def _any(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


_E = enrichment
_REPAIRS = f"""WITH s AS (SELECT p_partkey, lower(concat('Title', chr(10), 'md', chr(10), {_pick(_SAID)}, chr(10), p_type, ' ', {_pick(_TYPES)}, '    ')) AS c, {_pick(_TYPES)} AS t, {_pick(_GUESS)} AS g, replace(replace({_pick(_FACTS)}, '{{n}}', p_name), '{{t}}', lower(p_type)) AS f FROM part),
x AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda v: trim(v)), lambda v: v <> '') AS v, CASE WHEN {_any('c', _E.LEGAL)} THEN 'legal notice' WHEN {_any('c', _E.PAYMENT)} AND {_any('c', ['failed', 'due', 'overdue', 'balance', 'payment'])} THEN 'payment notice' WHEN {_any('c', _E.LEASE)} THEN 'lease administration'
WHEN contains(c, 'zillow') AND {_any('c', _E.LISTING)} THEN 'listing report' WHEN {_any('c', _E.INQUIRY)} THEN 'rental inquiry' WHEN {_any('c', _E.DELIVERY)} THEN 'delivery notification' WHEN {_any('c', _E.ESTIMATE)} THEN 'estimate' END AS kind,
CASE WHEN {_any('c', _E.LEGAL)} THEN 0.9 WHEN {_any('c', ['failed', 'overdue', 'unpaid'])} AND {_any('c', _E.PAYMENT)} THEN 0.85 WHEN {_any('c', _E.LEASE)} AND {_any('c', ['due', 'must', 'sign', 'renewal'])} THEN 0.8
WHEN {_any('c', _E.PAYMENT)} AND (regexp_matches(c, '\\$\\s?\\d') OR contains(c, 'due')) THEN 0.75 WHEN {_any('c', _E.ACTION)} THEN 0.7 WHEN {_any('c', _E.ESTIMATE + _E.DELIVERY)} THEN 0.6 ELSE 0.5 END AS h,
CASE WHEN f LIKE '[%' THEN from_json(f, '["VARCHAR"]') WHEN f = '' THEN []::VARCHAR[] ELSE [f] END AS fs FROM s)
SELECT p_partkey, array_to_string(list_slice(CASE WHEN kind IS NULL OR len(list_filter(v, lambda y: lower(y) NOT IN ('document', 'email', 'image', 'message', 'note', 'notification', 'text'))) > 0 THEN v ELSE list_append(v, kind) END, 1, 5), ', ') AS types,
round(greatest(CASE WHEN try_cast(g AS DOUBLE) IS NULL THEN 0.5 ELSE greatest(0, least(1, try_cast(g AS DOUBLE))) END, h), 2)::DOUBLE AS importance,
list_transform(list_filter(list_filter(fs, lambda y: trim(y) <> ''), lambda y: NOT {_any('lower(y)', _E.GENERIC_FACTS)} AND (regexp_matches(y, '\\$\\s?\\d') OR regexp_matches(y, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})\\b')
OR len(list_filter(regexp_extract_all(lower(y), '[a-z0-9$,.#/-]+'), lambda w: NOT list_contains({_E.FACT_STOP}, w) AND contains(c, w))) >= 2)),
lambda y: CASE WHEN length(regexp_replace(trim(y), '\\s+', ' ', 'g')) > 180 THEN concat(rtrim(left(regexp_replace(trim(y), '\\s+', ' ', 'g'), 177)), '...') ELSE regexp_replace(trim(y), '\\s+', ' ', 'g') END)[1:6] AS facts FROM x"""


@query(_REPAIRS)
def enrichment_repairs(spark, d):
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("p_partkey") % len(items) + 1).cast("int"))
    facts = F.replace(F.replace(pick(_FACTS), F.lit("{n}"), F.col("p_name")), F.lit("{t}"), F.lower("p_type"))
    record = {"enr_summary": F.col("p_type"), "enr_doc_type": pick(_TYPES), "enr_importance": pick(_GUESS), "enr_key_facts": facts}
    text = F.concat(F.lit("prompt Document text:\n "), pick(_SAID), F.lit("\nNEARBY SAME-CHANNEL CONTEXT CANDIDATES eviction"))
    r = enrichment.repaired(record, text, F.lit("Title"), F.lit("md"))
    return _part(spark, d).select("p_partkey", r["enr_doc_type"].alias("types"), r["enr_importance"].cast("double").alias("importance"), F.from_json(r["enr_key_facts"], "array<string>").alias("facts"))


@query("SELECT p_partkey, p_brand AS only_there, p_partkey % 2 = 0 AS mentions, CASE WHEN p_partkey % 2 = 0 THEN 'ambiguous' ELSE 'high' END AS confidence FROM part")
def context_repairs(spark, d):
    said = F.when(F.col("p_partkey") % 2 == 0, "Based on context it might be so").otherwise("it is so")
    values, primary, ctx = F.concat("p_name", F.lit(", "), "p_brand", F.lit(", nowhere")), F.col("p_name"), F.concat("p_name", F.lit(" and "), "p_brand")
    return _part(spark, d).select("p_partkey", enrichment.from_context(values, primary, ctx).alias("only_there"), enrichment.mentions_context(said).alias("mentions"), enrichment.consistent_confidence(F.lit("high"), said).alias("confidence"))


@query(f"""WITH r AS (SELECT p_partkey, [p_brand, 'Ann'] AS people, CASE WHEN p_size % 2 = 0 THEN concat('ann wrote of ', p_name) ELSE p_name END AS own, CASE WHEN p_size % 3 = 0 THEN 'From Context it seems' ELSE p_type END AS summary,
CASE WHEN p_size % 5 = 0 THEN 'rent' ELSE '' END AS topics, CASE WHEN p_size % 7 = 0 THEN 'High' ELSE '' END AS conf, CASE WHEN p_size % 4 = 0 THEN 'possibly a reply' ELSE '' END AS rel,
CASE WHEN p_size % 11 > 0 THEN [concat('[message_id=m', p_partkey, '] ', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END), concat('[source_message_id=s', p_size, '] hello ', CASE WHEN p_partkey % 3 = 0 THEN 'ann' ELSE 'bob' END), 'no id'] ELSE [] END AS ctx FROM part),
x AS (SELECT *, list_filter(people, lambda v: contains(lower(array_to_string(ctx, chr(10))), lower(v)) AND NOT contains(lower(own), lower(v))) AS solely FROM r),
y AS (SELECT *, len(ctx) > 0 AND (len(solely) > 0 OR (p_fits AND topics = '' AND conf = '' AND rel = '')) AS mend, list_filter(ctx, lambda c: len(solely) = 0 OR len(list_filter(solely, lambda v: contains(lower(c), lower(v)))) > 0) AS telling FROM (SELECT *, summary = 'From Context it seems' AS p_fits FROM x)),
z AS (SELECT *, CASE WHEN conf <> '' THEN conf WHEN mend THEN 'medium' ELSE '' END AS c, CASE WHEN mend THEN '{enrichment.OMITTED}' ELSE '' END AS w, CASE WHEN rel <> '' THEN rel WHEN mend THEN '{enrichment.USED}' ELSE '' END AS l FROM y)
SELECT p_partkey, array_to_string(solely, ', ') AS people, l AS relationship, CASE WHEN len(ctx) > 0 AND c = 'High' AND contains(l, 'possibly') THEN 'ambiguous' ELSE c END AS confidence,
CASE WHEN len(ctx) > 0 AND c = 'High' AND contains(l, 'possibly') AND w = '' THEN '{enrichment.DOUBTFUL}' ELSE w END AS warning,
CASE WHEN mend THEN array_to_string(list_filter(list_transform(telling, lambda c: regexp_extract(c, 'message_id=([^\\]\\s]+)', 1)), lambda i: i <> ''), ', ') ELSE '' END AS ids FROM z""")
def context_omissions(spark, d):
    """Records that used their context without saying so, and others that said so, had none or doubt."""
    n, when = F.col("p_size"), lambda c, v: F.when(c, v).otherwise(F.lit(""))
    own = F.concat(when(n % 2 == 0, F.lit("ann wrote of ")), "p_name")
    lines = [F.concat(F.lit("[message_id=m"), F.col("p_partkey").cast("string"), F.lit("] "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))), F.concat(F.lit("[source_message_id=s"), n.cast("string"), F.lit("] hello "), F.when(F.col("p_partkey") % 3 == 0, "ann").otherwise("bob")), F.lit("no id")]
    record = {
        "enr_entities_people": F.concat("p_brand", F.lit(", Ann")), "enr_summary": F.when(n % 3 == 0, "From Context it seems").otherwise(F.col("p_type")), "enr_context_topics": when(n % 5 == 0, F.lit("rent")),
        "enr_context_confidence": when(n % 7 == 0, F.lit("High")), "enr_context_relationship": when(n % 4 == 0, F.lit("possibly a reply")),
    }
    r = enrichment.repaired_context(record, own, F.when(n % 11 > 0, F.concat_ws("\n", *lines)))
    named = {"people": "entities_people", "relationship": "relationship", "confidence": "confidence", "warning": "warning", "ids": "source_message_ids"}
    return _part(spark, d).select("p_partkey", *[r[f"enr_context_{v}"].alias(k) for k, v in named.items()])


def _weighted(cols):
    return evaluate.case_score({"doc_type": cols["a"], "topics": cols["b"], "summary": F.lit(None).cast("double")})


providers.TASKS.add("enrichment", providers.Task(_weighted, ("default", "audit")))


@query("SELECT p_partkey, round(round(p_size / 100.0 * 0.18, 6) + round(p_size / 200.0 * 0.18, 6), 6)::DOUBLE AS score FROM part")
def task_scores(spark, d):
    cases = _part(spark, d).select("p_partkey", (F.col("p_size") / 100).alias("a"), (F.col("p_size") / 200).alias("b"))
    return providers.score_cases(cases, "enrichment").select("p_partkey", "score")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE round((1.0 / 2 + CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END) / 2, 6) END::DOUBLE AS tags FROM part")
def audit_tags(spark, d):
    own = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.lit("zz")))
    gold = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(F.array("p_brand", F.lit("other")))
    return _part(spark, d).select("p_partkey", evaluate.audit_tags_score(own, gold, F.array(F.lit("more"))).alias("tags"))


_ASKS = ["thing queue tion", "missed call about the thing", "zzzq unobtanium"]
_CALL = lookup.CALL_WORDS


def _verdict_sql(q: str, words: list[str], call: bool) -> str:
    hit = " + ".join(rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}')::INT" for w in words)
    called = f"list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), {_CALL})" if call else "false"
    return f"""SELECT '{q}' AS question, CASE WHEN n = 0 THEN 'not_found' WHEN {call} AND NOT c THEN 'ambiguous' WHEN c OR o >= 0.6 THEN 'found' ELSE 'ambiguous' END AS verdict, top, n AS n_real, n = 0 OR ({call} AND NOT c) AS sql_needed
FROM (SELECT count(*) AS n, arg_min(doc_id, r) AS top, arg_min(c, r) AS c, arg_min(o, r) AS o FROM (SELECT *, row_number() OVER (ORDER BY c DESC, o DESC, doc_id) AS r FROM (SELECT doc_id, {hit} AS m, ({hit}) / {len(words)}.0 AS o, {called} AS c FROM documents) WHERE o >= 0.34 OR m >= 2))"""


@query(" UNION ALL ".join([_verdict_sql(_ASKS[0], ["thing", "queue", "tion"], False), _verdict_sql(_ASKS[1], ["missed", "call", "thing"], True), _verdict_sql(_ASKS[2], ["zzzq", "unobtanium"], False)]))
def comm_verdict(spark, d):
    """Verdicts of three questions: one that is answered, one about a call, one about nothing."""
    docs, out = _docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.lit(1.0).alias("score")), None
    for q in _ASKS:
        one = lookup.verdict(lookup.evidence(docs, q, F.col("text")), q).select(F.lit(q).alias("question"), "verdict", "top", "n_real", "sql_needed")
        out = one if out is None else out.unionByName(one)
    return out
