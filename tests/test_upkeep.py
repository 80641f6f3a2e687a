"""Readers, plug-ins, snapshots of two writers, sources and scores against plain code."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import providers
from siltstone.operators import evaluate, taxonomy, upkeep
from siltstone.sources import extract, files, protocol, sinks
from siltstone.sources.snapshots import SnapshotTable


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


W = 'xmlns:w="http://x/w" xmlns:r="http://x/r"'
DOCX = zipped(word__document_dot_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t><w:tab/><w:t>four</w:t></w:r></w:p></w:body></w:document>")
SLIDE = f"<p {W}><w:p><w:t>%s</w:t></w:p></p>"
PPTX = zipped(ppt__slides__slide10_dot_xml=SLIDE % "last", ppt__slides__slide2_dot_xml=SLIDE % "first")
EPUB = zipped(
    **{"META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>', "OPS__b_dot_opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'},
    OPS__a_dot_xhtml="<html><head><title>no</title></head><p>Second &amp; last</p></html>", OPS__b_dot_xhtml="<p>First</p><script>x</script>")
XLSX = zipped(
    xl__workbook_dot_xml=f'<workbook {W}><sheets><sheet name="Rent" r:id="r1"/></sheets></workbook>', xl___rels__workbook_dot_xml_dot_rels='<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    xl__sharedStrings_dot_xml="<sst><si><t>Name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>",
    xl__worksheets__sheet1_dot_xml='<s><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2024</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>ok</t></is></c></row><row><c r="A3"><v>1</v></c></row></sheetData></s>')


def test_readers():
    assert extract.read(DOCX, "docx") == "One two\n\nthree\tfour"
    assert extract.read(PPTX, "pptx") == "<!-- Slide number: 1 -->\nfirst\n\n<!-- Slide number: 2 -->\nlast"
    assert extract.read(EPUB, "epub") == "First\n\nSecond & last"
    assert extract.read(XLSX, "xlsx") == "Sheet: Rent\nHeaders: Name |  | 2024\nAnna | ok"
    assert extract.read(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364? \{x\}}", "rtf") == "Hello bold\ncafé € {x}"
    assert extract.read(b'a,"b, c"\n"two\nlines",d,e', "csv") == "| a | b, c |  |\n| --- | --- | --- |\n| two lines | d | e |"
    assert extract.read(b"broken", "docx") == "" and extract.read(b"x", "bin") is None and extract.read(None, "csv") is None


def test_extraction_and_filesystem_source(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for name, body in {"a.docx": DOCX, "b.csv": b'x,"y, z"', "c.md": b"---\ntitle: T\n---\n# Head\nbody", "d.bin": b"zzz", "e.txt": b"."}.items():
        (root / name).write_bytes(body)
    s = protocol.build_source(spark, {"type": "filesystem", "name": "documents", "root": f"file://{root}", "scan": {"exclude": ["*.bin"]}})
    s.least = 2
    records = s.scan()
    assert [(r.rel_path, r.skip_reason) for r in records.collect()] == [("a.docx", None), ("b.csv", None), ("c.md", None), ("e.txt", "empty_file")]
    text = {r.rel_path: r.text for r in s.extract(records).collect()}
    assert text["a.docx"].startswith("One two") and text["b.csv"].startswith("| x | y, z |") and text["c.md"] == "# Head\nbody" and text["e.txt"] == "."
    assert protocol.union([s]).count() == 4 and s.close() is None
    with pytest.raises(ValueError):
        protocol.build_source(spark, {"type": "ftp", "name": "x"})
    with pytest.raises(KeyError):
        protocol.build_source(spark, {"type": "filesystem", "name": "x"})


def test_traces_have_their_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"model": "a"}\n\nnot json\n{"model": "b"}\n')
    got = files.read_traces(spark, f"file://{tmp_path}/t.jsonl", "model string").collect()
    assert [(r.model, r.trace_file, r.trace_line) for r in got] == [("a", "t.jsonl", 1), ("b", "t.jsonl", 4)]


def test_topics_are_cut_where_sentences_differ(spark):
    def embed(said):
        return F.transform(said, lambda x: F.when(x.contains("cat"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))

    text = "A cat sat. The cat ran. One cat hid. It rains. Rain falls."
    (r,) = spark.range(1).select(files.topics(F.lit(text), embed).alias("t")).collect()
    assert r.t == ["A cat sat. The cat ran. One cat hid. ", "It rains. Rain falls."]


def test_retries_circuits_and_fallbacks():
    waits, calls = [], []

    def flaky(fail):
        calls.append(1)
        if len(calls) <= fail:
            raise providers.Transient("x")
        return "ok"

    assert providers.with_retries(lambda: flaky(2), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(ValueError):
        providers.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    now = [0.0]
    circuits = providers.Circuits(failures=2, cooldown=60.0, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(providers.Transient):
            providers.with_retries(lambda: flaky(99), attempts=1, key="u", circuits=circuits)
    with pytest.raises(providers.CircuitOpen):
        providers.with_retries(lambda: "never", key="u", circuits=circuits)
    now[0] = 61.0
    assert providers.with_retries(lambda: "again", key="u", circuits=circuits) == "again"
    assert providers.with_fallback(lambda: "a", None) == "a" and providers.with_fallback(lambda: " ", lambda: "b") == "b" and providers.with_fallback(lambda: "", lambda: " ") == ""
    assert providers.with_fallback(lambda: "", None, empty_is_clean=True) == ""
    with pytest.raises(providers.Transient):
        providers.with_fallback(lambda: "", None)


def test_generators_and_registries(spark):
    df = spark.createDataFrame([(1, "the cat chased another cat"), (2, None)], "k int, p string")
    got = {r.k: r for r in providers.generate(df, "p", providers.EchoGenerator()).collect()}
    assert '"topics": ["another", "chased"]' in got[1].answer and got[2].answer is None

    class Broken:
        def generate(self, prompt):
            raise RuntimeError("down")

    assert providers.generate(df, "p", Broken()).where("k = 1").first().answer_error == "RuntimeError: down"
    with pytest.raises(ValueError):
        providers.normalizer("none such")


def test_two_writers_and_a_crash(spark, tmp_path):
    t, u = (SnapshotTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    t.replace(one)
    seen = u.current()
    a, b = t.write_shadow(one.withColumn("v", F.lit("b"))), u.write_shadow(one.withColumn("v", F.lit("c")))
    assert a != b and t.promote(a, expected=seen) and not u.promote(b, expected=seen)
    assert u.read().first().v == "b"
    # A writer that stops before it moves the pointer leaves what was there; its number does not block the next.
    t._claimed(t._pointers()[-1][0] + 1)
    assert u.read().first().v == "b"
    assert not t.compare_and_set("1", F.col("v") == "b", {"v": F.lit("d")}, field="k")  # the claim may be that of a writer at work
    t.replace(one)
    assert u.read().first().v == "a"


def test_phrases_against_a_plain_matching():
    rng = random.Random(5)
    vocabulary = ["rent", "bill", "cat", "dog", "sun", "lease", "order"]
    phrase = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 3)))
    for _ in range(200):
        a, b = [phrase() for _ in range(rng.randint(0, 3))], [phrase() for _ in range(rng.randint(0, 3))]
        p, q = sorted(set(a)), sorted(set(b))
        if not p or not q:
            assert evaluate.phrases_similarity(a, b) == float(not p and not q)
            continue
        left, total = list(q), 0.0
        for x in p:
            best = max(left, key=lambda y: 2 * len(set(x.split()) & set(y.split())) / (len(set(x.split())) + len(set(y.split()))), default=None)
            if best is not None and set(best.split()) & set(x.split()):
                total += 2 * len(set(x.split()) & set(best.split())) / (len(set(x.split())) + len(set(best.split())))
                left.remove(best)
        f1 = lambda s, t: 2 * len(s & t) / (len(s) + len(t))
        words = lambda c: {w for x in c for w in x.split()}
        wide = lambda c: words(c).union(*(evaluate.EQUIVALENTS.get(w, []) for w in words(c)))
        assert evaluate.phrases_similarity(a, b) == pytest.approx(max(total / max(len(p), len(q)), f1(words(p), words(q)), f1(wide(p), wide(q))), abs=1e-6)


def test_round_robin_takes_turns(spark):
    cases = spark.createDataFrame([(k, "abc"[min(2, k % 7)]) for k in range(60)], "case_id int, c string")
    got = evaluate.round_robin(cases, "c", 10, seed=3).collect()
    assert [r.c for r in got] == ["a", "b", "c"] * 3 + ["a"] and len({r.case_id for r in got}) == 10
    assert [r.case_id for r in got] == [r.case_id for r in evaluate.round_robin(cases.repartition(3), "c", 10, seed=3).collect()]


def test_sidecars_are_repaired_without_loss(spark):
    rows = [(1, '{"media": {"i": 1}, "context": "old words"}'), (2, '{"media": {}, "context": {"a": "1"}}'), (3, "no json")]
    df = spark.createDataFrame(rows, "k int, p string")
    got = {r.k: r.s for r in df.select("k", upkeep.repaired_sidecar(F.col("p"), F.lit('{"before": "x"}')).alias("s")).collect()}
    assert "legacy_context" in got[1] and "old words" in got[1] and "legacy" not in got[2] and "before" in got[2]


def test_reports_and_seeds(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert sinks.markdown(df.orderBy("n")) == "| n | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    import sqlite3

    with sqlite3.connect(tmp_path / "t.db") as c:
        c.execute("create table tags (name text, description text, aliases text)")
        c.execute("insert into tags values ('ml', 'learning', 'ai, machine learning')")
    got = taxonomy.read_sqlite(spark, str(tmp_path / "t.db"), "select name, description, aliases from tags", "tag").first()
    assert (got.id, got.aliases) == ("tag:ml", ["ai", "machine learning"])


def test_a_date_is_read_in_the_format_it_has_the_outline_of(spark):
    """Every outline lets through what its format reads, and texts of other outlines are not tried."""
    from siltstone.operators import evaluate

    told = {
        "2024-3-5": "2024-03-05", "2024/03/05": "2024-03-05", "3/5/2024": "2024-03-05", "3-5-2024": "2024-03-05", "March 5th, 2024": "2024-03-05", "MAR 5 2024": "2024-03-05",
        "5 march 2024": "2024-03-05", "5th Mar, 2024": "2024-03-05", "2/30/2024": "2/30/2024", "13/1/2024": "13/1/2024", "soon": "soon", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in told], "t string").select("t", evaluate.iso_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == told
    assert [f for f in evaluate.DATE_FORMATS if re.search(evaluate._outline(f), "3/5/2024")] == ["M/d/yyyy"]


def test_a_context_is_read_once_for_each_field_of_its_repair(spark):
    """Values that a repair names often are made once a row: the context is named twice in a field's expression, not once for each use."""
    from siltstone.functions import enrichment

    rows = [("1", "bob wrote", "[message_id=m1] Ann came\n[message_id=m2] bob", "Ann, Bob", ""), ("2", "x", "", "Ann", ""), ("3", None, "[message_id=m3] possibly ann", "ann", "High")]
    df = spark.createDataFrame(rows, "id string, own string, ctx string, people string, conf string")
    r = enrichment.repaired_context({"enr_entities_people": F.col("people"), "enr_context_confidence": F.col("conf")}, F.col("own"), F.col("ctx"))
    for field in ("confidence", "source_message_ids", "warning"):
        assert df.select(r[f"enr_context_{field}"].alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count("ctx#") <= 2
    got = df.select("id", *[r[f"enr_context_{k}"].alias(k) for k in ("entities_people", "source_message_ids", "confidence")]).collect()
    assert [tuple(x) for x in got] == [("1", "Ann", "m1", "medium"), ("2", "", "", ""), ("3", "ann", "m3", "High")]


def test_only_a_missing_time_has_no_text(spark):
    from siltstone.operators import browse

    rows = spark.createDataFrame([("a", 0.0), ("b", None), ("c", -1.0), ("d", 1000.0)], "doc_id string, mtime double")
    got = {r.doc_id: r.mtime_iso for r in browse.listed_documents(rows).collect()}
    assert got == {"a": "1970-01-01T00:00:00Z", "b": None, "c": "1969-12-31T23:59:59Z", "d": "1970-01-01T00:16:40Z"}
