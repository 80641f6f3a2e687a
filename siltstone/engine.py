"""The engine's functions behind one object: search, lookups, SQL, browsing, taxonomy, indexing.

Failures that a caller can mend come back as {error, code, message, fix}. Tables are snapshot tables: chunks
(doc_id, loc, chunk_uid, text, vector, rel_path, source_type, source_name, mtime, …), registry, taxonomy. Indexing keeps postings beside the
chunks, which searches read in place of texts; where they are not those of the chunks' version, texts are scanned until the next run mends that.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from siltstone.functions.providers import with_retries
from siltstone.functions.text import source_name
from siltstone.operators import browse, dedupe, filters, incremental, lookup, search, sqlguard, taxonomy, upkeep
from siltstone.operators.postings import Postings
from siltstone.sources import files
from siltstone.sources.sinks import Log
from siltstone.sources.snapshots import SnapshotTable

MODES, SORTS, MOST = ("slim", "compact", "full"), ("relevance", "recent"), 100


def error(code: str, message: str, fix: str) -> dict:
    return {"error": True, "code": code, "message": message, "fix": fix}


def hash_embeddings(texts: Sequence[str | None], size: int = 64) -> list[np.ndarray]:
    """Deterministic unit vectors from the words of texts, in place of a model. A word is hashed once, however often the texts have it."""
    split = [(t or "").lower().split() for t in texts]
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64)
    h = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[:5] for w in known), np.uint8).reshape(-1, 5)
    at, sign = h[:, :4].copy().view(">u4").ravel().astype(np.int64) % size, np.where(h[:, 4] & 1, 1.0, -1.0)
    row = np.repeat(np.arange(len(split)), [len(words) for words in split])
    sums = np.bincount(row * size + at[code], sign[code], len(split) * size).astype(float).reshape(len(split), size)
    return [v / n if (n := np.sqrt((v * v).sum())) else v for v in sums]


def hash_embedding(text: str, size: int = 64) -> list[float]:
    return hash_embeddings([text], size)[0].tolist()


def embed(text: Column, size: int = 64) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(hash_embeddings(s.tolist(), size), index=s.index, dtype=object)

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[str], Sequence[float]] = hash_embedding, embed_column: Callable[[Column], Column] = embed, reranker: search.Rerank | None = search.overlap_rerank_score):
        self.spark, self.root, self.embedder, self.embed_column, self.reranker = spark, root, embedder, embed_column, reranker
        self.chunks, self.registry, self.taxonomy = (SnapshotTable(spark, f"{root}/{n}") for n in ("chunks", "registry", "taxonomy"))
        self.audit = Log(spark, f"{root}/audit")
        self.postings = Postings(spark, f"{root}/postings")
        self.changes = SnapshotTable(spark, f"{root}/changes")
        self.bare = SnapshotTable(spark, f"{root}/bare")  # documents of which no chunk is made

    # ---- search

    def file_search(self, query: str, top_k: int = 8, mode: str = "slim", sort: str = "relevance", width: int = 10000, filter_json: str | None = None, now: float | None = None, source: str | None = None, **named: str | None) -> dict:
        """{results, total, diagnostics} or an error."""
        mode, sort = (mode or "slim").strip().lower(), (sort or "relevance").strip().lower()
        if not query or not query.strip():
            return error("empty_query", "the query is empty", "ask for something in words")
        if mode not in MODES or sort not in SORTS or not isinstance(width, int) or width < 0:
            return error("invalid_parameter", f"mode is one of {MODES}, sort one of {SORTS}, width a number from 0", "change the parameter")
        if (kind := named.get("source_type")) is not None:
            try:
                filters.checked_source_type(kind)
            except ValueError as e:
                return error("invalid_parameter", str(e), "use letters, digits, - and _")
        try:
            ast = json.loads(filter_json) if filter_json else None
            cond = filters.named_filters(filters=ast, **named)
        except ValueError as e:
            return error("invalid_parameter", f"filters: {e}", "one operator a node, one field a leaf")
        if source:
            own = source_name(F.col("doc_id")) == source
            cond = own if cond is None else cond & own
        k = max(1, min(int(top_k), MOST))
        try:
            table = self.chunks.read()
        except FileNotFoundError:
            return error("index_empty", "nothing is indexed yet", "run file_index_update")
        table = table.withColumn("id", F.col("chunk_uid"))
        note: dict = {"sort": sort, "degraded": False}
        vector = None
        try:
            vector = list(with_retries(lambda: self.embedder(query), attempts=2, waits=(0.25,)))
        except Exception as e:  # keyword search alone still answers
            note |= {"degraded": True, "reason": f"embedding: {e}"}
        keyword = self._keyword(table)
        try:
            lists = self._lists(table, query, vector, cond, keyword, note)
            if lists is None:
                return error("search_failed", note["reason"], "see the index's health")
            hits = search.hybrid_search(table, query, vector, k, where=cond, now=now, sort=sort, rerank=self.reranker, filtered_type=named.get("source_type") is not None, notes=note, hits=lists, keyword=keyword)
            shown = browse.hits(hits.drop("vector", "id"))
            shown = browse.compact_hits(shown, width) if mode == "compact" else browse.slim_hits(shown.drop("text")) if mode == "slim" else shown
            rows = [{c: v for c, v in r.asDict().items() if v not in (None, "")} for r in shown.orderBy("pos").collect()]
        except PySparkException as e:
            return error("search_failed", str(e)[:300], "check the filters' fields")
        return {"results": rows, "total": len(rows), "diagnostics": note}

    def _keyword(self, table: DataFrame) -> search.Keyword:
        """A search for words over the kept index if it is that of the chunks, or else over their texts."""
        if self.postings.version != self.chunks.current():
            return lambda query, k, cond: search.bm25(table, query, k, where=cond)

        def run(query: str, k: int, cond: Column | None) -> DataFrame:
            scope = None if cond is None else table.where(cond).select(F.col("id").alias("key"))
            return self.postings.keyword_search(query, k, scope).withColumnRenamed("key", "id")

        return run

    def _lists(self, table: DataFrame, query: str, vector: list | None, cond: Column | None, keyword: search.Keyword, note: dict, pool: int = 50) -> list[DataFrame] | None:
        """The nearest chunks and those with the query's words, each of `pool` rows; one that fails even when tried again is left out, with a note. None if both fail."""
        scoped = table if cond is None else table.where(cond)
        made = {"keyword": (lambda: keyword(query, pool, cond), 3, (0.25, 0.5))}
        if vector is not None:
            made = {"vector": (lambda: search.nearest(scoped, vector, pool), 2, (0.0,))} | made
        lists = []
        for name, (make, attempts, waits) in made.items():
            try:
                rows, schema = with_retries(lambda make=make: ((d := make()).collect(), d.schema), attempts, waits, transient=lambda e: not isinstance(e, AnalysisException))
                lists.append(self.spark.createDataFrame(rows, schema))
            except AnalysisException:  # the filter names a field that is not there
                raise
            except Exception as e:
                note |= {"degraded": True, "reason": f"{name}: {str(e)[:200]}", f"{name}_search_active": False}
        return lists or None

    def comm_lookup(self, query: str, limit: int = 3, sort: str = "relevance", **named: str | None) -> dict:
        """A verdict with its evidence, within a budget of characters."""
        limit = max(1, min(int(limit), 5))
        found = self.file_search(query, 20, "compact", sort, 600, **named)
        if found.get("error"):
            return found if found["code"] in ("empty_query", "invalid_parameter") else {"verdict": "not_found", "sql_needed": True, "note": found["message"]}
        if not found["results"]:
            return {"verdict": "not_found", "sql_needed": True}
        rows = self.spark.createDataFrame([(k, json.dumps(r, default=str), " ".join(str(r.get(c, "")) for c in ("title", "snippet", "content", "sender")), float(r.get("score", 0))) for k, r in enumerate(found["results"])], "id int, hit string, text string, score double")
        ev = lookup.evidence(rows, query, F.col("text"))
        v = lookup.verdict(ev, query).first()
        ordered = [json.loads(r.hit) for r in lookup.by_evidence(ev).orderBy("pos").limit(limit).collect()]
        return lookup.trim_to_budget({"verdict": v["verdict"], "sql_needed": v["sql_needed"], "hits": [{c: h.get(c) for c in ("doc_id", "title", "score")} for h in ordered], "source_ids": [h.get("doc_id") for h in ordered], "snippet": (ordered[0].get("snippet") or "")[:400] if ordered else ""})

    # ---- SQL

    def sor_query(self, sql: str, limit: int = 50, fmt: str = "tsv") -> str | dict:
        if why := sqlguard.check(sql):
            return error("invalid_parameter", why, "pass one SELECT")
        try:
            return sqlguard.answer(*sqlguard.guarded(self.spark, sql, limit), fmt)
        except PySparkException as e:
            return error("search_failed", str(e)[:300], "see sor_schema")

    def sor_schema(self) -> str:
        return sqlguard.schema_text(self.spark, [t.name for t in self.spark.catalog.listTables()])

    # ---- browsing

    def file_get_chunk(self, doc_id: str, loc: str) -> dict:
        row = self.chunks.read().where((F.col("doc_id") == doc_id) & (F.col("loc") == loc)).drop("vector").first()
        return row.asDict() if row else error("not_found", f"{doc_id}::{loc}", "list the document's chunks")

    def file_get_doc_chunks(self, doc_id: str) -> list[dict]:
        return [r.asDict() for r in browse.document_chunks(self.chunks.read().drop("vector"), doc_id).collect()]

    def file_list_documents(self, limit: int = 50, offset: int = 0, **named: str | None) -> list[dict]:
        docs = filters.where(self._listed(), filters.named_filters(**named)).groupBy("doc_id").agg(F.max("mtime").alias("mtime"), F.max("rel_path").alias("rel_path"))
        return [r.asDict() for r in browse.page(docs, [F.col("doc_id")], limit, offset).collect()]

    def file_recent(self, limit: int = 20, source_type: str | None = None, folder: str | None = None, **named: str | None) -> list[dict]:
        """The newest documents; source_type and folder mind case, other filters are those of a search."""
        some = filters.where(self._listed(), filters.named_filters(**named))
        some = filters.where(some, filters.recent_filter(source_type, folder))
        fields = [c for c in ("rel_path", "source_type", "source_name", "title") if c in some.columns]
        return [r.asDict() for r in browse.listed_documents(browse.recent_documents(some, fields, limit)).collect()]

    def file_facets(self, fields: Sequence[str]) -> dict:
        """Values with counts by field, most frequent first."""
        rows = browse.facets(self._listed(), fields).orderBy("field", F.desc("n"), "value").collect()
        return {f: [{"value": r.value, "count": r.n} for r in rows if r.field == f] for f in fields}

    def file_folders(self) -> list[dict]:
        docs = self._listed().select("doc_id", "rel_path").distinct()
        return [r.asDict() for r in browse.folder_counts(docs, "rel_path").collect()]

    def file_status(self) -> dict:
        """Counts by source, with the version that is read, and the health of the sources and of all."""
        table = self.chunks.read()
        by = browse.counts_by(self._listed().select("doc_id").distinct(), source_name(F.col("doc_id")), "source_name")
        known = self.registry.read().groupBy("source_name").agg(F.count(F.lit(1)).alias("registered")) if self.registry.current() else by.withColumnRenamed("n", "registered")
        rows = by.join(known, "source_name", "full_outer").select("source_name", F.coalesce("n", F.lit(0)).alias("indexed"), "registered", F.lit(0).alias("not_extractable"), F.lit(True).alias("configured"), F.lit(None).cast("string").alias("last_run"))
        state = upkeep.source_health(rows)
        counts = {r.source_name: r.indexed for r in rows.orderBy("source_name").collect()}
        health = {r.source_name: {"state": r.state, "reason": r.reason} for r in state.collect()}
        return {"chunks": table.count(), "documents": sum(counts.values()), "sources": counts, "version": self.chunks.current(), "health": health, "overall": upkeep.overall_health(state).first()["state"]}

    def file_audit_log(self, limit: int = 50, offset: int = 0, action: str | None = None) -> list[dict]:
        return [r.asDict() for r in browse.audit_page(self.audit.read(), action, None, limit, offset).collect()]

    # ---- taxonomy

    def taxonomy_list(self, kind: str | None = None, status: str | None = "active") -> list[dict]:
        return [r.asDict() for r in taxonomy.listed(self.taxonomy.read(), kind, status).collect()]

    def taxonomy_get(self, entry: str) -> dict:
        row = self.taxonomy.read().where(F.col("id") == entry).first()
        return row.asDict() if row else error("not_found", entry, "see taxonomy_list")

    def taxonomy_search(self, query: str, kind: str | None = None, k: int = 10) -> list[dict]:
        """Entries by words and by vectors, fused."""
        own = taxonomy.listed(self.taxonomy.read(), kind).withColumn("text", F.concat_ws(" ", "name", "description"))
        hit = search.bm25(own, query, k)
        if hit.limit(1).count():
            near = search.nearest(own.withColumn("vector", self.embed_column(F.col("text"))), list(self.embedder(query)), k).where("score > 0")
            hit = search.fuse([near, hit]).orderBy("pos").limit(k).select("id", "score")
        return [r.asDict() for r in own.drop("text").join(F.broadcast(hit), "id").orderBy(F.desc("score"), "id").collect()]

    def _entries(self, rows: Sequence[dict]) -> DataFrame:
        full = [(f"{r['kind']}:{r['name']}", r["kind"], r["name"], r.get("description", ""), list(r.get("aliases", [])), r.get("status", "active"), int(r.get("usage_count", 0))) for r in rows]
        return self.spark.createDataFrame(full, "id string, kind string, name string, description string, aliases array<string>, status string, usage_count long")

    def taxonomy_add(self, **entry) -> dict:
        self.taxonomy.upsert(self._entries([entry]), "id")
        return self.taxonomy_get(f"{entry['kind']}:{entry['name']}")

    def taxonomy_update(self, entry: str, **changes) -> dict:
        old = self.taxonomy_get(entry)
        return old if old.get("error") else self.taxonomy_add(**{k: v for k, v in (old | changes).items() if k != "id"})

    def taxonomy_delete(self, entry: str) -> dict:
        old = self.taxonomy_get(entry)
        if not old.get("error"):
            self.taxonomy.delete(self.spark.createDataFrame([(entry,)], "id string"), "id")
        return old

    def taxonomy_import(self, entries: Sequence[dict]) -> int:
        """Adds the entries that are not there yet; says how many are there now."""
        self.taxonomy.insert_missing(self._entries(entries), "id")
        return self.taxonomy.read().count()

    # ---- indexing

    def _log(self, rows: DataFrame) -> None:
        """Adds (doc_id, action) rows to the audit log."""
        self.audit.append(rows.select(F.current_timestamp().alias("ts"), "doc_id", "action"), ["doc_id", "action"])

    def _cut(self, records: DataFrame, size: int = 1800, overlap: int = 200) -> DataFrame:
        """The chunks of records with their fields and vectors; each is made from its record's row, so none is shuffled."""
        kept = [c for c in records.columns if c not in ("doc_id", "text")]
        return files.chunks(records, size, overlap, keep=kept).withColumn("vector", self.embed_column(F.col("text")))

    def _listed(self) -> DataFrame:
        """The chunks without texts and vectors, and a row without a place for each document that has none: every document is among them."""
        chunks = self.chunks.read().drop("text", "vector")
        if self.bare.current() is None:
            return chunks
        return chunks.unionByName(self.bare.read().join(chunks.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)

    def _keep_bare(self, fresh: DataFrame, changed: DataFrame) -> None:
        """Keeps those of the fresh records of which no chunk is made, in place of what was kept of all changed documents (doc_id)."""
        self.bare.upsert(fresh.where(~files.has_chunks(F.col("text"))).drop("text").withColumn("loc", F.lit("")), gone=changed)

    def _index_words(self, before: int | None, after: int, docs: DataFrame) -> None:
        """Brings the postings from one version of the chunks to a later one, between which only chunks of docs (doc_id) have changed."""
        of = lambda v, some: self.chunks.read(v).join(some, "doc_id", "left_semi").select(F.col("chunk_uid").alias("key"), "text")
        if before is None or self.postings.version != before:
            self.postings.build(self.chunks.read(after).select(F.col("chunk_uid").alias("key"), "text"), after)
        else:
            self.postings.update(of(after, docs), of(before, docs), after)

    def file_index_update(self, texts: DataFrame, size: int = 1800, overlap: int = 200, dedupe_exact: bool = False, skipped: DataFrame | None = None, now: float = 0.0) -> dict:
        """Indexes records with texts (doc_id, text, rel_path, source_type, source_name, mtime, change_hash): new and changed ones are
        chunked and embedded, ones that are gone are deleted unless that would take too much of a source.

        With dedupe_exact, of equal texts the first seen alone is indexed; records that a skip ledger holds and that are not due are left out.
        The changes are written before they are used, so every step sees the same.
        """
        if skipped is not None:
            texts = incremental.not_skipped(texts, skipped, now)
        counts_dup = 0
        if dedupe_exact:
            elected = dedupe.elect(dedupe.with_identity(texts, "text"), ["mtime"])
            texts = elected.where("dedupe_status = 'canonical'").select(*texts.columns)
            counts_dup = elected.where("dedupe_status = 'duplicate'").count()
        if self.chunks.current() is None:
            changes = texts.select("doc_id", F.lit("add").alias("change"))
        else:
            stored = self._listed().groupBy("doc_id").agg(F.max("change_hash").alias("change_hash"), F.max("mtime").alias("mtime"))
            changes = incremental.guarded_deletes(incremental.diff(texts, stored), stored)
        self.changes.replace(changes)
        changes = self.changes.read()
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        before = after = self.chunks.current()
        # Where nothing is stored yet, all are new; or else texts are shuffled to be held against the changes.
        fresh = texts if before is None else texts.join(changes.where("change in ('add', 'update')"), "doc_id", "left_semi")
        cut = self._cut(fresh, size, overlap)
        if counts.get("add") or counts.get("update"):
            after = self.chunks.upsert(cut, gone=changes.where("change in ('add', 'update')"))
        if counts.get("delete"):
            after = self.chunks.delete(changes.where("change = 'delete'"))
        if after is not None and self.postings.version != after:
            self._index_words(before, after, changes.where("change <> 'same'").select("doc_id"))
        if any(counts.get(c) for c in ("add", "update", "delete")):
            self._keep_bare(fresh, changes.where("change in ('add', 'update', 'delete')"))
        self._log(changes.where("change <> 'same'").select("doc_id", F.col("change").alias("action")))
        return counts | ({"duplicate": counts_dup} if counts_dup else {})

    def file_index_document(self, texts: DataFrame, doc_id: str) -> dict:
        """One document through the same plan."""
        one = texts.where(F.col("doc_id") == doc_id)
        if one.limit(1).count() == 0:
            return error("not_found", doc_id, "scan its source first")
        cut = self._cut(one)
        before, version = self.chunks.current(), self.chunks.upsert(cut, gone=one)
        self._index_words(before, version, one.select("doc_id"))
        self._keep_bare(one, one)
        return {"version": version, "chunks": self.chunks.read(version).where(F.col("doc_id") == doc_id).count()}
