"""Files, chunks, snapshots, registry, records, streams."""

import json

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import context, dedupe, evaluate, incremental, taxonomy
from siltstone.sources import files, registry, sinks, tables
from siltstone.sources.snapshots import SnapshotTable, checkpoint_folder


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_scan_extract_and_records(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "note@00A1b@.md").write_text("---\ntitle: T\ntags: [a, b]\n---\n# Head\nbody é")
    (root / "sub" / "p.html").write_text("<html><script>x</script><p>Hi &amp; bye</p></html>")
    (root / "skip.bin").write_bytes(b"\x00")
    found = files.scan(spark, str(root), ["**/*.md", "**/*.html"], contents=True)
    got = {r.rel_path: r for r in files.extract_text(found).collect()}
    assert set(got) == {"note@00A1b@.md", "sub/p.html"}
    assert got["note@00A1b@.md"].text == "# Head\nbody é" and got["note@00A1b@.md"].frontmatter["title"] == "T"
    assert got["sub/p.html"].text == "Hi & bye"
    rec = {r.natural_key: r for r in files.records(found, "vault").collect()}
    assert rec["note@00A1b@.md"].doc_id == "vault::00A1b" and rec["sub/p.html"].metadata["folder"] == "sub" and rec["sub/p.html"].source_type == "html"
    both = files.union_sources({"documents": files.records(found), "other": files.records(found)})
    assert both.where("source_name = 'other' and doc_id like 'other::%'").count() == 2


def test_headings_and_chunks(spark):
    text = "intro\n# A\none\n## B\ntwo\n### C\nthree\n## D\nfour\n#### not a heading\n# E\n"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "x" * 4000)], "doc_id string, text string")
    got = df.where("doc_id = 'd'").select(files.headings(F.col("text")).alias("s")).first().s
    assert [r.breadcrumb for r in got] == ["", "A", "A > B", "A > B > C", "A > D", "E"]
    assert got[4].body.endswith("#### not a heading")
    c = files.chunks(df).collect()
    assert [r.loc for r in sorted(c, key=lambda r: r.chunk_uid) if r.doc_id == "d"] == [f"c:{k}" for k in range(6)]
    assert [len(r.text) for r in sorted(c, key=lambda r: r.loc) if r.doc_id == "f"] == [1800, 1800, 800]


def test_repetition(spark):
    healthy = " ".join(f"word{k}" for k in range(200))
    rows = [(1, "OO\n" * 400), (2, healthy), (3, "a b " * 300), (4, "short short short"), (5, None)]
    got = {r.k: r.text for r in files.collapse_repetition(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert got[1] == "OO\nOO\nOO\n" and got[2] == healthy and got[3].split() == ["a", "b"] * 3 and got[4] == "short short short" and got[5] is None


def test_text_functions(spark):
    r = one(spark, T.base62(F.lit(3843)), T.from_base62(F.lit("000zz")), T.name_with_id(F.lit("a/b@00001@.md"), F.lit("0000Z")), T.title(F.lit("x\n# Top \n"), F.lit("a/b.md")), T.title(F.lit(""), F.lit("a/b.c.md")))
    assert list(r) == ["000zz", 3843, "a/b@0000Z@.md", "Top", "b.c"]
    r = one(spark, T.source_type(F.lit(".PDF")), T.source_type(F.lit("zip")), T.source_type(F.lit("")), T.folder(F.lit("a/b")), T.parent(F.lit("b")), T.normalize_tags(F.lit(" a ,, b")))
    assert list(r) == ["pdf", "zip", "other", "a", ".", "a,b"]
    r = one(spark, T.json_list(F.lit('["a","b"]')), T.json_list(F.lit("a;b")), T.key_facts(F.lit("x;  y\n\nz")), T.phone_keys(F.lit("+1 (484) 735-8527 or 12")), T.retry_delay(F.lit(20)), T.source_name(F.lit("s::1")))
    assert list(r) == [["a", "b"], ["a;b"], ["x", "y", "z"], ["4847358527"], 21600.0, "s"]
    r = one(spark, T.folder_depth_kept(F.lit("a/b/2024")), T.folder_depth_kept(F.lit("a/b/c")), T.folder_depth_kept(F.lit("a/b/c/d")), T.with_caption(F.lit(" "), F.lit("hi")), T.with_context(T.with_context(F.lit("t"), F.lit("one")), F.lit("two")))
    assert list(r) == [False, True, False, "Communication message/caption: hi", "t\n\n[Context]\ntwo"]
    r = one(spark, T.iso_utc(T.timestamp_utc(F.lit("2024-01-02T03:04:05.678+01:00"))), T.archive_name(F.lit("a/b c")), F.length(T.archive_name(F.lit("x/" * 300))))
    assert list(r) == ["2024-01-02T02:04:05Z", "a%2Fb%20c", 180]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, text string")
    t.upsert(rows(("a", "1"), ("b", "1")))
    t.tag("first")
    t.upsert(rows(("b", "2"), ("c", "2")).withColumn("lang", F.lit("en")))
    now = lambda: {r.doc_id: (r.text, r.lang) for r in t.read().collect()}
    assert now() == {"a": ("1", ""), "b": ("2", "en"), "c": ("2", "en")}
    t.insert_missing(rows(("c", "9"), ("d", "3")))
    assert now()["c"] == ("2", "en") and now()["d"] == ("3", "")
    assert t.compare_and_set("d", F.col("text") == "3", {"text": F.lit("4")}, "doc_id") and now()["d"][0] == "4"
    assert not t.compare_and_set("d", F.col("text") == "3", {"text": F.lit("5")}, "doc_id")
    t.delete(rows(("a", "")))
    assert "a" not in now()
    shadow = t.write_shadow(rows(("z", "z")))
    assert "z" not in now() and shadow in t.versions()
    before = t.current()
    (tmp_path / "t" / f"v={shadow}" / "broken.parquet").write_bytes(b"no parquet")
    for f in (tmp_path / "t" / f"v={shadow}").glob("part-*"):
        f.write_bytes(b"broken")
    t.recover()
    assert t.current() == before
    gone = t.prune(0.0, now=4e9)
    assert shadow in gone and t.tags()["first"] in t.versions() and t.current() in t.versions()
    t.restore(t.tags()["first"])
    assert {r.doc_id for r in t.read().collect()} == {"a", "b"}


def test_registry(spark):
    reg = spark.createDataFrame([("00001", "a.md", "documents", 1.0), ("s::00002", "b.md", "s", 2.0)], "doc_id string, path string, source_name string, created double")
    seen = spark.createDataFrame([("00001", "moved.md", "", 9.0), ("00003", "c.md", "documents", 9.0)], "doc_id string, path string, source_name string, created double")
    new, events = registry.upsert(reg, seen)
    assert {(r.doc_id, r.action) for r in events.collect()} == {("00001", "moved"), ("00003", "registered")}
    assert {r.doc_id: (r.path, r.source_name, r.created) for r in new.collect()}["00001"] == ("moved.md", "documents", 1.0)
    left, retired = registry.retire(new, spark.createDataFrame([], "doc_id string"), spark.createDataFrame([("00002",)], "doc_id string"))
    assert {r.doc_id for r in left.collect()} == {"00001", "00003"} and retired.first().doc_id == "s::00002"
    minted = registry.mint(spark.createDataFrame([("x",), ("y",), ("z",)], "path string"), new, spark.createDataFrame([("00004",)], "doc_id string"), 1).orderBy("path").collect()
    assert [r.doc_id for r in minted] == ["00005", "00006", "00007"]
    assert {r.doc_id for r in registry.mappings(spark.createDataFrame([("1", "p", "s")], "doc_id string, path string, source_name string")).collect()} == {"s::1"}


def test_table_records(spark):
    rows = spark.createDataFrame([(7, "hello", "Bob")], "id int, body string, sender string").withColumn("at", F.timestamp_seconds(F.lit(10)))
    r = tables.table_records(rows, tables.TableSpec("", "m-{id}", "body", "at", ["sender"], "salt"), "pg").first()
    assert (r.doc_id, r.mtime, r.metadata["sender"], r.size) == ("pg::m-7", 10.0, "Bob", 5)


def test_diff_prefers_hashes(spark):
    s = spark.createDataFrame([("a", "h", 2.0), ("b", "x", 1.0), ("c", "", 2.0), ("n", "", 1.0)], "doc_id string, change_hash string, mtime double")
    t = spark.createDataFrame([("a", "h", 1.0), ("b", "y", 1.0), ("c", "z", 1.0), ("o", "", 1.0)], "doc_id string, change_hash string, mtime double")
    assert {r.doc_id: r.change for r in incremental.diff(s, t).collect()} == {"a": "same", "b": "update", "c": "update", "n": "add", "o": "delete"}


def test_election_and_groups(spark):
    checkpoint_folder(spark)
    df = spark.createDataFrame([(1, 5, "h"), (2, 3, "h"), (3, 3, "h"), (4, 1, None)], "doc_id long, seen int, content_hash string").withColumn("size_bytes", F.lit(1))
    e = {r.doc_id: (r.canonical_doc_id, r.dedupe_status) for r in dedupe.elect(df, ["seen"]).collect()}
    assert e == {1: (2, "duplicate"), 2: (2, "canonical"), 3: (2, "duplicate"), 4: (4, "canonical")}
    assert dedupe.broken_election(dedupe.elect(df, ["seen"])).count() == 0
    chain = spark.createDataFrame([(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(40)] + [(99, None, None)], "doc_id long, x string, y string")
    g = {r.doc_id: r.group_id for r in dedupe.content_groups(chain, ["x", "y"]).collect()}
    assert all(g[k] == 0 for k in range(40)) and g[99] == 99


def test_context_window_keeps_the_nearest_that_speaks(spark):
    rows = [("c", k, float(k * 60), "" if k in (4, 6) else "t") for k in range(10)] + [("c", 20, 5000.0, "far")]
    df = spark.createDataFrame(rows, "scope string, message_id int, sent_at double, text string")
    r = context.context_windows(df, ["scope"], ["sent_at", "message_id"], before=2, after=1).where("message_id = 5").first()
    assert (r.before, r.after) == ([3, 4], [7, 6]) or (r.before, r.after) == ([3, 4], [6, 7])


def test_mentions(spark):
    m = spark.createDataFrame([(1, "s", "hi {@1} and {@2}"), (2, "s", "{@1} {@2}"), (3, "s", "plain")], "message_id int, source string, text string")
    p = spark.createDataFrame([("s", "1", "Ann")], "source string, participant_key string, display_name string")
    assert {r.message_id: r.text for r in context.expand_mentions(m, p).collect()} == {1: "hi Ann and {@2}", 3: "plain"}


def test_taxonomy_and_scores(spark):
    t = spark.createDataFrame([("tag:ml", "tag", "ml", "", ["Machine Learning"], "active", 1), ("folder:a/", "folder", "a/", "x" * 90, [], "active", 0)], "id string, kind string, name string, description string, aliases array<string>, status string, usage_count long")
    items = spark.createDataFrame([(1, ["machine learning", "ML", "new"])], "id int, names array<string>")
    assert taxonomy.resolve(items, t, "tag").first().resolved == ["ml", "new"]
    assert taxonomy.prompt(t).first().text == "## Available Tags\n- ml\n\n## Available Folders\n- a/: " + "x" * 80
    assert taxonomy.seed(t, t).count() == 2
    r = one(spark, evaluate.folder_score(F.lit("a/b"), F.lit("A/B/")), evaluate.folder_score(F.lit("a"), F.lit("a/b")), evaluate.folder_score(F.lit("a/b/c"), F.lit("a/b")), evaluate.iso_date(F.lit("March 3rd, 2024")), evaluate.iso_date(F.lit("soon")))
    assert list(r) == [1.0, 0.5, 0.9, "2024-03-03", "soon"]
    r = one(spark, evaluate.dice(evaluate.token_set(F.lit("two parties")), evaluate.token_set(F.lit("party two x"))), evaluate.phrase_match(F.array(F.lit("x b"), F.lit("c")), F.array(F.lit("c"), F.lit("x"))))
    assert list(r) == [0.8, 0.833333]
    cases = spark.createDataFrame([(k, (["x"] if k % 2 else []) + (["y"] if k == 7 else [])) for k in range(10)], "case_id int, flags array<string>")
    assert evaluate.balanced_hard_cases(cases, 3) == [7, 1, 3]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "duplicate", "t/1"), (1, 2, "canonical", "t/1")], "n int, doc_id long, dedupe_status string, canonical_doc_id string")
    sinks.archive_duplicates(e, f"file://{tmp_path}/arch")
    assert spark.read.json(f"file://{tmp_path}/arch").first().canonical == "t%2F1"
    sinks.run_metadata(spark, f"file://{tmp_path}/meta", {"docs": 3})
    assert json.loads(spark.read.text(f"file://{tmp_path}/meta").first()[0]) == {"docs": 3}


def test_an_archive_has_no_file_for_each_document(spark, tmp_path):
    n = 200
    e = spark.range(n).coalesce(1).selectExpr("id as doc_id", "'duplicate' as dedupe_status", "concat('t/', id) as canonical_doc_id")
    sinks.archive_duplicates(e, f"file://{tmp_path}/arch")
    back = spark.read.json(f"file://{tmp_path}/arch")
    assert {r.canonical for r in back.collect()} == {f"t%2F{k}" for k in range(n)}
    assert len(list((tmp_path / "arch").rglob("*.json"))) <= sinks.FOLDERS
