"""Language, token counts, decontamination, mixing and the pipeline against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language, mixing, shared, transducer

ODD = [None, "", "  ", "a", "\n", "a\tb  c   d", "▁x y", "éÉ　x\x00y<s></s><unk> <0x0A>", " lead", "trail ", " " * 40 + "x" + " " * 17 + "①" + " " * 15, "日本語 текст", "x" * 3000, "①" * 700, "ab " * 2000, "1234 😀 5"]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, tr = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    p, expected = language.posteriors(e, tr, np.array([5, 1, 2]))
    total = np.zeros((3, 3))
    for part, rows in ((e[:5], p[:5]), (e[5:6], p[5:6]), (e[6:], p[6:])):
        z = np.zeros_like(part)
        pairs = np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=len(part)):
            w = np.exp(sum(part[i, y[i]] for i in range(len(part))) + sum(tr[a, b] for a, b in itertools.pairwise(y)))
            for i, k in enumerate(y):
                z[i, k] += w
            for a, b in itertools.pairwise(y):
                pairs[a, b] += w
        assert np.allclose(rows, z / z.sum(axis=1, keepdims=True))
        total += pairs / z[0].sum()
    assert np.allclose(expected, total)


def test_language_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("score", F.lit("clash"))
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "12 34 !!", "en"), (9003, "", None), (None, "the and of", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd)
    want = {r.doc_id: r.lang for r in both.collect()}
    got = {r.doc_id: r for r in language.identify(both).collect()}
    assert len(got) == len(want)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (9001, 9002, 9003))
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [r for r in got.values() if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_text_and_no_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    m = language.train(docs)
    de, en = (docs.where(f"lang = '{x}' and n_chars > 800").first().text[:400] for x in ("de", "en"))
    _, scores = m.predict([de, de + " " + en])
    assert scores[0] > 0.9 and 0.4 < scores[1] < 0.8
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []


def test_passages_and_languages_of_few_or_long_texts(spark, data):
    """A language that only long texts have is learned, and a text of two languages is cut where they meet."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    own = next(k for k in range(90000, 90100) if zlib.crc32(str(k).encode()) % 5)
    long = docs.where("lang = 'fr'").agg(F.repeat(F.concat_ws(" ", F.collect_list("text")), F.lit(4)).alias("text")).select(F.lit(own).cast("long").alias("doc_id"), "text", F.lit("fr").alias("lang"))
    m = language.train(docs.where("lang <> 'fr'").union(long))
    assert m.labels == ["de", "en", "es", "fr"]
    de, en = (docs.where(f"lang = '{x}' and length(text) > 800").first().text[:300] for x in ("de", "en"))
    runs = m.passages(de + " " + en)
    assert runs[0][2] == "de" and runs[-1][2] == "en" and runs[0][0] < 20 and runs[-1][1] <= len(de) + len(en) + 1
    assert m.passages(None) == [] and m.passages("12 !") == []


def test_token_counts_of_no_rows_repeated_rows_and_missing_ids(spark):
    content = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    assert sorted(((r.doc_id, r.n_tokens) for r in transducer.token_counts(docs, content).collect()), key=repr) == sorted([(1, 2), (1, 2), (None, 2), (2, 0)], key=repr)
    assert transducer.token_counts(docs.limit(0), content).collect() == []


def test_token_counts_equal_the_library(spark, data):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    signs = [chr(x) for x in (32, 32, 32, 97, 101, 116, 104, 233, 0x2581, 10, 48, 0x430, 0x4E00, 0x1F600, 65, 39)]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(0, 1200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 10000, "text"))
    content = open(path, "rb").read()
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    got = transducer.token_counts(docs, content, limit=500).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(sp.encode(want[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(want[r.doc_id].encode()), n > 500)
    small = transducer.Transducer(content)
    transducer.MAX_STATES, kept = 50, transducer.MAX_STATES
    try:
        for k in range(0, len(texts), 20):
            assert small.count(texts[k : k + 20]).tolist() == [len(sp.encode(t or "")) for t in texts[k : k + 20]]
    finally:
        transducer.MAX_STATES = kept


def brute_hits(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w, hit, found = word.findall(low(text)), set(), set()
    for item, t in items:
        x = word.findall(low(t))
        for k in range(max(1, len(x) - size + 1) if x else 0):
            win = x[k : k + size]
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), found


def test_decontamination(spark, data):
    items = [(10, "Alpha beta gamma"), (9, " ".join(f"q{k}" for k in range(14))), (None, "null item words here"), (7, None), (8, "!!"), (10, "Alpha beta gamma"), (11, "É tude du x")]
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma,", "é", "tude", "du", "x", "null", "item", "words", "here", *[f"q{k}" for k in range(14)]]
    texts = [None, "", "alpha  BETA--gamma!", "xalpha beta gamma", "a " + " ".join(f"Q{k}" for k in range(14)) + " z", " ".join(f"q{k}" for k in range(9)), "alpha beta gamma", "beta gamma " * 3000] + [" ".join(rng.choices(vocab, k=200)) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item string")
    for shard in (decontaminate.SHARD, 60):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, shard=shard).collect()}
        for k, t in enumerate(texts):
            n, hit, found = brute_hits(t, items)
            sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            r = got[k]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha, hit > 0)
    (s,) = got[2].hit_spans
    assert texts[2][s.start : s.end] == "alpha  BETA--gamma"
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {k for k, r in got.items() if not r.contaminated}
    assert decontaminate.contamination(docs.limit(0), bench).collect() == [] and not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def water(sizes):
    """Targets by handing the excess round until nothing is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left = {}, sum(sizes.values())
    free = set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["b", "a", "é", "", None, "c", "huge", "huge", "huge", "huge"])) for k in range(900)]
    rows += [(1000, None, "a"), (1001, "x " * 5000, "tiny"), (None, "w w w", "a"), (None, "w w w", "a"), (5, rows[5][1], rows[5][2]), (1002, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bucket", F.lit(1)).withColumn("k", F.lit(2))
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows)
    m = mixing.mix(docs).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken = {}
    for r in m:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    longest = 60
    for s, n in taken.items():
        assert abs(n - want[s]) <= (5000 if s == "tiny" else 1 if sizes[s] > 1000 else longest)
    again = mixing.taken_words(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.taken_words(docs.limit(0)).collect() == []
    assert mixing.mixed(docs.withColumn("mix_copies", F.lit(0))).columns[-1] == "mix_copies_"


def test_subset_sum_is_exact_where_lengths_allow():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = np.sort(rng.choice(np.arange(1, 60), 6, replace=False))
        c = rng.integers(1, 4, 6)
        budget = int(rng.integers(0, (n * c).sum() + 1))
        best = max(s for k in itertools.product(*[range(x + 1) for x in c]) if (s := int(np.dot(k, n))) <= budget)
        got = mixing.fit(n, c, budget)
        assert (got <= c).all() and (got >= 0).all() and budget - np.dot(got, n) <= max(n) and np.dot(got, n) <= best


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        a, b = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(b) <= set(a) and b
        if name == "language_id":
            assert set(a) - set(b) <= {d for d, t in a.items() if sum(c.isalpha() for c in t or "") < 40}
        if name == "decontamination":
            assert set(b) == {d for d, t in a.items() if brute_hits(t, bench)[1] == 0}
        docs = spark.createDataFrame(out.toPandas(), out.schema) if k < 4 else docs
    assert corpus_pipeline.run(spark, data).count() > 0


def test_pipeline_of_odd_rows(spark, data):
    """Nulls in every column, repeated and missing ids, empty and very long texts and clashing names go through all stages; an empty table too."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 40")
    some = docs.where("lang = 'en' and length(text) > 300").select("text").limit(2).collect()
    odd = [(None, some[0].text, "en", "src1", 1), (3, some[1].text, "en", None, None), (3, some[1].text, "en", None, None), (3, "der die das und nicht eine ganz andere Sache in diesem Text", None, "src2", 5), (None, None, None, None, None), (900, "", "en", "src1", 0), (901, "12 !! 34", "en", "src1", 8), (902, (some[0].text + " ") * 60, "en", "src3", 9)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    both = both.withColumns({c: F.lit(c) for c in ("row", "key", "size", "th", "copies", "drop", "mix_copies", "label")})
    for start in (both, both.limit(0)):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = shared.stored(stage(spark, now, data))
            assert out.columns[: len(both.columns)] == both.columns or k == len(corpus_pipeline.STAGES) - 1, name
            now = out
        rows = now.collect()
        assert not any(r.text is None or not r.text.strip() for r in rows)
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    first = shared.stored(corpus_pipeline.STAGES[0][1](spark, both, data))
    assert not {900, 901} & {r.doc_id for r in first.collect()}
