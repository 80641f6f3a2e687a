"""The engine end to end over a small vault, and enrichment functions."""

import json

from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.functions import enrichment


def vault(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, rel_path string, source_type string, source_name string, mtime double, change_hash string")


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    assert e.file_search("x")["code"] == "index_empty"
    rows = [("a", "# Cats\ncats purr and sleep", "animals/cats.md", "md", "documents", 100.0, "1"), ("b", "dogs bark at cats", "animals/dogs.md", "md", "documents", 200.0, "1"), ("pg::1", "call Bob at (484) 735-8527", "pg/1", "pg_message", "pg", 300.0, "1")]
    assert e.file_index_update(vault(spark, rows)) == {"add": 3}
    well = {"state": "ok", "reason": "indexed"}
    assert e.file_status() == {"chunks": 3, "documents": 3, "sources": {"documents": 2, "pg": 1}, "version": 1, "health": {"documents": well, "pg": well}, "overall": "ok"}
    got = e.file_search("cats purr", mode="compact", width=4)
    assert got["results"][0]["doc_id"] == "a" and got["results"][0]["content"] == "# Ca" and got["results"][0]["content_truncated"]
    assert [r["doc_id"] for r in e.file_search("cats", sort="recent")["results"]][0] == "pg::1"
    assert {r["doc_id"] for r in e.file_search("cats", source_type="PG_message")["results"]} == {"pg::1"}
    assert {r["doc_id"] for r in e.file_search("cats", filter_json='{"prefix": {"rel_path": "animals/d"}}')["results"]} == {"b"}
    assert {r["doc_id"] for r in e.file_search("cats", source="pg")["results"]} == {"pg::1"}
    for bad in ({"query": " "}, {"query": "x", "mode": "odd"}, {"query": "x", "sort": "odd"}, {"query": "x", "filter_json": "{}"}, {"query": "x", "source_type": "a b"}, {"query": "x", "width": -1}):
        assert e.file_search(**bad)["error"]
    assert e.comm_lookup("call 484-735-8527")["verdict"] == "found" and e.comm_lookup("zzz unobtanium")["verdict"] == "not_found"
    assert e.file_get_chunk("a", "c:0")["section"] == "Cats" and e.file_get_chunk("a", "c:9")["code"] == "not_found"
    assert [r["doc_id"] for r in e.file_recent(2)] == ["pg::1", "b"] and e.file_recent(1)[0]["mtime_iso"] == "1970-01-01T00:05:00Z"
    assert [r["doc_id"] for r in e.file_list_documents(1, 1)] == ["b"] and e.file_list_documents(1, 1)[0]["total"] == 3
    assert e.file_facets(["source_type"])["source_type"][0] == {"value": "md", "count": 2}
    assert e.file_folders() == [{"folder": "animals", "n": 2}, {"folder": "pg", "n": 1}]
    rows[0] = (*rows[0][:1], "now about birds", *rows[0][2:6], "2")
    assert e.file_index_update(vault(spark, rows[:2])) == {"update": 1, "same": 1, "delete": 1}
    assert "birds" in e.file_get_doc_chunks("a")[0]["text"] and e.file_status()["documents"] == 2
    assert e.file_index_document(vault(spark, rows), "pg::1")["chunks"] == 1 and e.file_status()["documents"] == 3
    assert {r["action"] for r in e.file_audit_log()} == {"add", "update", "delete"} and len(e.file_audit_log(action="add")) == 3
    assert e.sor_query("select 1 as x") == "x\n1" and e.sor_query("drop table x")["code"] == "invalid_parameter"
    assert e.taxonomy_import([{"kind": "tag", "name": "ml", "description": "machine learning"}, {"kind": "tag", "name": "law"}]) == 2
    assert e.taxonomy_import([{"kind": "tag", "name": "ml"}]) == 2 and e.taxonomy_get("tag:ml")["description"] == "machine learning"
    assert [r["name"] for r in e.taxonomy_search("learning")] == ["ml"] and e.taxonomy_update("tag:ml", status="old")["status"] == "old"
    assert [r["name"] for r in e.taxonomy_list("tag")] == ["law"] and e.taxonomy_delete("tag:law")["name"] == "law" and e.taxonomy_get("tag:law")["error"]


def test_degraded_search_is_by_keywords(spark, tmp_path):
    def broken(_):
        raise RuntimeError("no model")

    e = Engine(spark, f"file://{tmp_path}")
    e.file_index_update(vault(spark, [("a", "cats purr", "a.md", "md", "documents", 1.0, "1")]))
    e.embedder = broken
    got = e.file_search("purr")
    assert got["diagnostics"]["degraded"] and got["results"][0]["doc_id"] == "a"


def test_postings_follow_the_chunks(spark, tmp_path):
    """Searches read postings and, of the chunks, rows by key; where the chunks have another version, texts are scanned."""
    from siltstone.operators import search

    e = Engine(spark, f"file://{tmp_path}")
    row = lambda k, text, mark="1": (k, text, f"x/{k}.md", "md", "documents", 1.0, mark)
    rows = [row(f"d{k}", f"word{k % 5} and cats {'purr' * (k % 2)}") for k in range(20)]
    e.file_index_update(vault(spark, rows))
    assert e.postings.version == e.chunks.current() == 1
    rows[3] = row("d3", "only zebras here", "2")
    e.file_index_update(vault(spark, rows[:19]))  # one changed, one gone
    assert e.postings.version == e.chunks.current() and [r.kind for r in e.postings._rows()] == ["segment", "gone", "segment"]
    assert [r["doc_id"] for r in e.file_search("zebras")["results"]][0] == "d3"
    now = lambda: e.chunks.read().withColumn("id", F.col("chunk_uid"))
    read = now()
    by_words = lambda q: [tuple(r) for r in e._keyword(now())(q, 50, None).select("id", F.round("score", 9)).collect()]
    scan = lambda q: [tuple(r) for r in search.bm25(now(), q, 50).select("id", F.round("score", 9)).collect()]
    assert all(by_words(q) == scan(q) for q in ("cats purr", "word3 zebras", "purrpurr", "nothing"))
    plan = search.rows_of(read, e._keyword(read)("purr", 5, None))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chunk_uid" in plan
    assert all("/postings/" in f for f in e._keyword(read)("purr", 5, None).inputFiles())
    e.chunks.restore(1)
    assert e.postings.version != e.chunks.current() and e.file_search("zebras")["results"][0]["doc_id"] != "d3"
    e.file_index_update(vault(spark, rows))
    assert e.postings.version == e.chunks.current() and by_words("cats") == scan("cats")


def test_phrases_of_a_search(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.file_index_update(vault(spark, [("a", "banana fruit tropical", "a.md", "md", "documents", 1.0, "1"), ("b", "banana tropical and so on", "b.md", "md", "documents", 1.0, "1"), ("c", "tropical banana", "c.md", "md", "documents", 1.0, "1")]))
    hits = lambda q: [r.id for r in e._keyword(e.chunks.read().withColumn("id", F.col("chunk_uid")))(q, 5, None).collect()]
    assert hits('"banana tropical"') == ["b::c:0"] and sorted(hits('"fruit banana"')) == ["a::c:0", "b::c:0", "c::c:0"]


def test_a_failing_list_is_tried_again_and_then_left_out(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}")
    e.file_index_update(vault(spark, [("a", "cats purr", "a.md", "md", "documents", 1.0, "1")]))
    calls, good = [], e.postings.keyword_search

    def failing(times):
        def run(*a):
            calls.append(1)
            if len(calls) <= times:
                raise TimeoutError("busy")
            return good(*a)

        return run

    monkeypatch.setattr(e.postings, "keyword_search", failing(2))
    got = e.file_search("purr")
    assert got["total"] == 1 and not got["diagnostics"]["degraded"] and len(calls) == 3
    calls.clear()
    monkeypatch.setattr(e.postings, "keyword_search", failing(99))
    got = e.file_search("purr")
    assert got["total"] == 1 and got["diagnostics"]["keyword_search_active"] is False and len(calls) == 3


def test_recent_minds_case(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.file_index_update(vault(spark, [("a", "x", "a.md", "md", "documents", 1.0, "1"), ("b", "y", "b.pdf", "pdf", "documents", 2.0, "1")]))
    assert [r["doc_id"] for r in e.file_recent(5, source_type="md")] == ["a"] and e.file_recent(5, source_type="MD") == [] and [r["doc_id"] for r in e.file_recent(5, source_name="DOCUMENTS")] == ["b", "a"]


def test_audit_numbers_over_many_partitions(spark, tmp_path):
    from siltstone.sources.sinks import Log

    log = Log(spark, f"file://{tmp_path}/log")
    assert not log.exists()
    rows = spark.range(400).repartition(400).select(F.col("id").cast("string").alias("doc_id"), F.lit("add").alias("action"))
    log.append(rows, ["doc_id"])
    before = {p.name for p in (tmp_path / "log").iterdir()}
    log.append(rows.limit(3), ["doc_id"])
    assert sorted(r.id for r in log.read().collect()) == list(range(1, 404)) and before < {p.name for p in (tmp_path / "log").iterdir()}


def test_enrichment(spark):
    answers = ['```json\n{"summary": "s", "topics": ["a", " b ", "..."], "importance": "2", "key_facts": ["x", ""]}\n``` bye', '<think>{</think>{"summary": "cut, off", "topics": ["a", "b', "no json", None, '{"a": [1, {"b": "c"']
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").withColumn("j", enrichment.extract_json(F.col("a")))
    got = {r.k: r for r in df.select("k", "j", *[c.alias(n) for n, c in enrichment.normalized(F.col("j")).items()]).collect()}
    assert (got[0].enr_topics, got[0].enr_importance, got[0].enr_key_facts, got[0].enr_summary) == ("a, b", "1.0", '["x"]', "s")
    assert json.loads(got[1].j) == {"summary": "cut, off", "topics": ["a", "b"]} and got[2].j is None and got[3].j is None
    assert json.loads(got[4].j) == {"a": [1, {"b": "c"}]}
    many = ", ".join(f'"k{n}": [{n}, "x"]' for n in range(500))
    for tail in (', "bad": nope, ' + ", ".join(f'"z{n}": 1' for n in range(500)), ', "cut": {"half": tr', ', "open": "with a quote that', ', "key'):
        read = json.loads(enrichment._object("{" + many + tail))
        assert [read[f"k{n}"] for n in range(500)] == [[n, "x"] for n in range(500)] and not set(read) & {"z0", "bad"}
    text = F.lit("the eviction notice says rent of $500 is overdue")
    r = spark.range(1).select(enrichment.repaired_type(F.lit("email"), text), enrichment.repaired_type(F.lit("lease"), text), enrichment.repaired_importance(F.lit("0.2"), text), enrichment.repaired_facts(F.lit('["rent of $500 is overdue", "important information", "moon cheese", "the eviction says so"]'), text), enrichment.from_context(F.lit("Ann, Bob"), F.lit("ann"), F.lit("Ann and Bob")), enrichment.consistent_confidence(F.lit("High"), F.lit("might be"))).first()
    assert list(r) == ["email, legal notice", "lease", "0.9", '["rent of $500 is overdue", "the eviction says so"]', "Bob", "ambiguous"]


def test_answers_are_cut_to_their_budget():
    from siltstone.operators import lookup

    size = lambda a: len(json.dumps(a, indent=2, ensure_ascii=False))
    full = {"verdict": "found", "hits": [{"doc_id": str(k), "title": "t" * 300} for k in range(9)], "key_facts": ["f" * 100] * 9, "snippet": "s" * 400, "note": "n" * 400, "source_ids": [str(k) for k in range(9)]}
    got = lookup.trim_to_budget(json.loads(json.dumps(full)))
    assert size(got) <= 2800 and 1 <= len(got["hits"]) < 9 and got["hits"] == full["hits"][: len(got["hits"])] and got["snippet"] == full["snippet"]
    tight = lookup.trim_to_budget(json.loads(json.dumps(full)), 120)
    assert tight["verdict"] == "found" and not tight["key_facts"] and not tight["hits"] and tight["snippet"] == "" and len(tight["source_ids"]) == 1
    assert lookup.trim_to_budget({"verdict": "x"}) == {"verdict": "x"}


def test_events_reach_their_sink_in_batches_and_without_private_keys(spark, tmp_path):
    from siltstone.sources import sinks

    where = str(tmp_path)

    def send(batch):
        import os
        import uuid

        if any(e["payload"].get("n") == "13" for e in batch):
            raise RuntimeError("the sink is away")
        with open(os.path.join(where, uuid.uuid4().hex), "w") as f:
            json.dump(batch, f)

    events = spark.range(40).select(F.when(F.col("id") % 2 == 1, "odd").otherwise("even").alias("name"), F.create_map(F.lit("n"), F.col("id").cast("string"), F.lit("_private"), F.lit("x")).alias("payload")).coalesce(1)
    sinks.emit(events, send, {"odd"}, size=6)
    batches = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(map(len, batches)) == [2, 6, 6]  # the batch that holds 13 is lost with a warning, and no other
    assert {e["name"] for b in batches for e in b} == {"odd"} and all(set(e["payload"]) == {"n"} for b in batches for e in b)


def test_words_of_a_batch_are_hashed_once_and_vectors_are_those_of_plain_code(monkeypatch):
    import hashlib

    import numpy as np

    from siltstone import engine

    texts = ["a B a  \u00c9t\u00e9", None, "", "b a " * 300, "x\u3000y"]

    def plain(t, size=64):
        v = np.zeros(size)
        for w in (t or "").lower().split():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % size] += 1 if h[4] & 1 else -1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()

    want, calls, real = [plain(t) for t in texts], [], hashlib.sha256
    monkeypatch.setattr(engine.hashlib, "sha256", lambda w: (calls.append(w), real(w))[1])
    assert [v.tolist() for v in engine.hash_embeddings(texts)] == want and len(calls) == 5
    assert [engine.hash_embedding(t) for t in texts] == want and engine.hash_embeddings([]) == []


def with_bare(spark, tmp_path):
    """An index of two documents with text and three without."""
    e = Engine(spark, f"file://{tmp_path}")
    rows = [("pg::1", "cats purr", "x/1.md", "md", "pg", 1.0, "1"), ("pg::2", "", "x/2.pdf", "pdf", "pg", 0.0, "1"), ("b", None, "y/b.md", "md", "documents", 0.0, "1"), ("c::3", " \n\t ", "c.md", "md", "c", 3.0, "1"), ("a", "dogs", "y/a.md", "md", "documents", 2.0, "1")]
    assert e.file_index_update(vault(spark, rows)) == {"add": 5}
    return e, rows


def test_documents_without_text_are_added_once(spark, tmp_path):
    e, rows = with_bare(spark, tmp_path)
    assert e.file_index_update(vault(spark, rows)) == {"same": 5}
    assert sorted((r["doc_id"], r["action"], r["id"]) for r in e.file_audit_log()) == [(k, "add", n + 1) for n, k in enumerate(["a", "b", "c::3", "pg::1", "pg::2"])]
    assert [(r["doc_id"], r["total"]) for r in e.file_list_documents(2, 1)] == [("b", 5), ("c::3", 5)]
    assert [r["doc_id"] for r in e.file_recent(5)] == ["c::3", "a", "pg::1", "b", "pg::2"]
    rows[0], rows[1] = (*rows[0][:1], "", *rows[0][2:6], "2"), (*rows[1][:1], "birds", *rows[1][2:6], "2")
    assert e.file_index_update(vault(spark, [rows[0], rows[1], rows[2], rows[4]])) == {"update": 2, "same": 2, "delete": 1}
    assert e.file_index_update(vault(spark, [rows[0], rows[1], rows[2], rows[4]])) == {"same": 4}
    assert e.file_get_doc_chunks("pg::1") == [] and e.file_search("cats purr", source="pg")["results"][0]["doc_id"] == "pg::2"
    assert e.file_index_document(vault(spark, rows), "pg::1")["chunks"] == 0 and e.postings.version == e.chunks.current()
    assert sorted(r["doc_id"] for r in e.file_list_documents()) == ["a", "b", "pg::1", "pg::2"]


def test_a_vault_without_any_text(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    rows = [("b", "", "y/b.md", "md", "documents", 0.0, "1")]
    assert e.file_index_update(vault(spark, rows)) == {"add": 1} and e.file_index_update(vault(spark, rows)) == {"same": 1}
    assert [r["doc_id"] for r in e.file_list_documents()] == ["b"]


def test_facets_count_documents_without_text(spark, tmp_path):
    e, _ = with_bare(spark, tmp_path)
    assert e.file_facets(["source_type", "source_name"]) == {"source_type": [{"value": "md", "count": 4}, {"value": "pdf", "count": 1}], "source_name": [{"value": "documents", "count": 2}, {"value": "pg", "count": 2}, {"value": "c", "count": 1}]}


def test_folders_count_documents_without_text(spark, tmp_path):
    e, _ = with_bare(spark, tmp_path)
    assert e.file_folders() == [{"folder": ".", "n": 1}, {"folder": "x", "n": 2}, {"folder": "y", "n": 2}]


def test_status_counts_documents_without_text(spark, tmp_path):
    e, _ = with_bare(spark, tmp_path)
    s = e.file_status()
    assert s["sources"] == {"c": 1, "documents": 2, "pg": 2} and (s["documents"], s["chunks"]) == (5, 2)


def test_chunks_are_made_where_their_texts_are(spark, tmp_path):
    """Neither texts nor chunks are shuffled, and packed postings are smaller than what they hold."""
    import numpy as np
    import pyarrow as pa

    from siltstone.operators import postings

    e = Engine(spark, f"file://{tmp_path}")
    plan = e._cut(vault(spark, [("a", "cats", "a.md", "md", "documents", 1.0, "1")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    schema = pa.schema([("term", pa.string()), ("key", pa.string()), ("tf", pa.int32()), ("dl", pa.int32()), ("positions", pa.list_(pa.int32()))])
    rows = pa.table({"term": ["a", "b"] * 500, "key": [f"k{i // 2}" for i in range(1000)], "tf": [1, 2] * 500, "dl": [3] * 1000, "positions": [[0], [1, 2]] * 500}, schema=schema).combine_chunks().to_batches()[0]
    packed = postings._packed(rows.append_column("kh", pa.array(np.arange(1000))), 3.0, [("b", 9.0, 0)], schema)
    assert packed.column("part").to_pylist() == [0, 1]
    back = [postings._unpacked([(r["size"], packed.column("rows")[i])], 3.0, schema) for i, r in enumerate(packed.to_pylist())]
    assert sorted(map(repr, (x for t in back for x in t.drop(["impact"]).to_pylist()))) == sorted(map(repr, rows.to_pylist()))
    assert sum(len(r["rows"]) for r in packed.to_pylist()) < rows.nbytes / 2
    assert np.allclose(back[0].column("impact").to_numpy(), postings._impact(back[0].column("tf").to_numpy(), back[0].column("dl").to_numpy(), 3.0))
