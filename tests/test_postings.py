"""The kept index against one built anew, against plain code, and for what it reads."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import postings, search
from siltstone.operators.postings import Postings

WORDS = ["cat", "dog", "bird", "Ünit", "tree", "house", "the", "the", "the", "a1"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, text string")


def drawn(n, seed, prefix="k"):
    draw = random.Random(seed)
    return [(f"{prefix}{k}", " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 40)))) for k in range(n)] + [(f"{prefix}null", None), (f"{prefix}signs", "-- !!")]


def ranked(df):
    return [(r.key, round(r.score, 9)) for r in df.collect()]


def plain_rank(spark, rows, query, k):
    return [(r.key, round(r.score, 9)) for r in search.bm25(frame(spark, rows), query, k, key="key").collect()]


def test_updates_and_deletes_are_as_if_built_anew(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}/index")
    first, more = drawn(60, 1), drawn(20, 2, "m")
    index.update(frame(spark, first), version=1)
    changed = [(k, f"{t} cat cat zebra") for k, t in first[:7]]
    index.update(frame(spark, more + changed), frame(spark, first[:10]), version=2)
    assert index.version == 2
    now = changed + first[10:] + more
    for q in ("cat zebra", "the house", "ünit a1 nothing", "zebra"):
        assert ranked(index.search(q, 12)) == plain_rank(spark, now, q, 12)
    # A text that is put back after it went is there once.
    index.update(frame(spark, first[7:9]), frame(spark, more), version=3)
    now = changed + first[7:9] + first[10:]
    before = ranked(index.search("cat tree", 100))
    assert before == plain_rank(spark, now, "cat tree", 100)
    index.merge()
    assert len(index._rows()) == 1 and index.version == 3 and ranked(index.search("cat tree", 100)) == before
    index.prune(0.0)
    assert ranked(index.search("cat tree", 100)) == before and len(list((tmp_path / "index").glob("segment-*"))) == 1
    few = frame(spark, [("k20", ""), ("k21", "")])
    assert {k for k, _ in ranked(index.search("cat tree", 100, few))} == {"k20", "k21"} & {k for k, _ in before}
    assert ranked(index.search("!!", 5)) == [] and ranked(index.search("unheard", 5)) == [] and index.phrase("unheard of") is None


def test_many_segments_are_merged_and_an_empty_index_finds_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENTS", 2)
    index = Postings(spark, f"file://{tmp_path}/index")
    assert ranked(index.search("cat")) == [] and index.version is None
    index.update(frame(spark, []), version=0)
    assert ranked(index.search("cat")) == []
    for k in range(3):
        index.update(frame(spark, [(f"x{k}", "one cat")]), version=k)
    assert sum(r.kind == "segment" for r in index._rows()) == 1 and [k for k, _ in ranked(index.search("cat"))] == ["x0", "x1", "x2"]
    index.update(None, frame(spark, [("x1", "one cat")]))
    assert [k for k, _ in ranked(index.search("cat"))] == ["x0", "x2"]


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path):
    """A common term: its best texts stand in its first blocks, also after the mean length has changed."""
    index = Postings(spark, f"file://{tmp_path}/index")
    text = F.concat(F.repeat(F.lit("hot "), F.pmod(F.xxhash64("id"), F.lit(9)).cast("int") + 1), F.repeat(F.lit("x "), (F.col("id") % 37).cast("int")), F.when(F.col("id") % 5000 == 7, "rare").otherwise(""))
    texts = spark.range(30_000).select(F.col("id").cast("string").alias("key"), text.alias("text"))
    index.update(texts)
    index.update(spark.range(300).select(F.concat(F.lit("l"), "id").alias("key"), F.repeat(F.lit("long text "), 60).alias("text")))
    every = texts.unionByName(spark.range(300).select(F.concat(F.lit("l"), "id").alias("key"), F.repeat(F.lit("long text "), 60).alias("text")))
    for q, share in (("hot", 0.1), ("rare", 1.0), ("hot rare", 1.0)):
        notes = {}
        assert ranked(index.search(q, 10, notes=notes)) == [(r.key, round(r.score, 9)) for r in search.bm25(every, q, 10, key="key").collect()]
        assert notes["read"].count() <= share * notes["blocks"]
    spans = [s for s in index._spans.values() for s in s]
    assert sum(s.low <= "hot" <= s.high for s in spans) > 1  # no task holds all of a common term


def test_positions_are_stored_as_differences(spark, tmp_path):
    import pyarrow.parquet as pq

    Postings(spark, f"file://{tmp_path}/index").update(frame(spark, [("a", "b c " * 5000)]))
    meta = [pq.read_metadata(f).row_group(0) for f in (tmp_path / "index").glob("segment-*/blocks/part=*/*.parquet")]
    columns = [m.column(c) for m in meta for c in range(m.num_columns) if m.column(c).path_in_schema.startswith("positions")]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns) and sum(c.total_compressed_size for c in columns) < 10_000


def test_phrases_against_plain_code(spark, tmp_path):
    rows = drawn(150, 5) + [("rep", "the the the the dog the the")]
    index = Postings(spark, f"file://{tmp_path}/index")
    index.update(frame(spark, rows[:100] + [("gone", "the dog the dog")]))
    index.update(frame(spark, rows[100:]), frame(spark, [("gone", "the dog the dog")]))
    for phrase in ("the dog", "the the the", "cat", "ÜNIT tree", "bird the bird"):
        line, want = phrase.lower().split(), Counter()
        for k, t in rows:
            w = (t or "").lower().split()
            want[k] += sum(w[i : i + len(line)] == line for i in range(len(w)))
        assert {r.key: r.n for r in index.phrase(phrase).collect()} == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize(("query", "want"), [('"banana tropical"', ["a.md", "b.md"]), ('"banana fruit"', ["a.md"]), ('"banana split" "tropical"', ["b.md"]), ('dessert "banana fruit" fruit', ["a.md"]), ('""', []), ('banana:fruit "', ["a.md", "b.md"])])
def test_quoted_words_fall_back_to_bare_ones(spark, query, want):
    index = _fruit(spark)
    assert [r.key for r in index.keyword_search(query, 10).collect()] == want


def _fruit(spark, made={}):  # noqa: B006
    if not made:
        import tempfile

        made["index"] = Postings(spark, f"file://{tempfile.mkdtemp()}/index")
        made["index"].update(frame(spark, [("a.md", "banana fruit tropical"), ("b.md", "banana split dessert tropical")]))
    return made["index"]


def test_equal_texts_score_alike_whatever_the_order_of_postings(spark, tmp_path):
    """Scores are summed in the order of the query's terms; a tie is broken by key alone."""
    words = ["aa", "bb", "cc", "dd", "ee"]
    idf = {w: 0.1 * 3**k + 0.017 for k, w in enumerate(words)}
    index = Postings(spark, f"file://{tmp_path}/p")
    posts = [(key, w, 1 + k % 3, 7) for key, order in ((1, words), (2, words[::-1]), (3, words[2:] + words[:2])) for k, w in sorted(((words.index(w), w) for w in order), key=lambda x: order.index(x[1]))]
    df = spark.createDataFrame(posts, "key int, term string, tf int, dl int").coalesce(1)
    scores = {r.score for r in index._scored(df, idf, 5.3).collect()}
    assert len(scores) == 1


def test_counts_and_ranges_of_a_batch_against_plain_code(spark):
    """Rows are packed by ranges of (term, falling impact, hash of the key); what is counted of texts that are gone is combined before it is shuffled."""
    import pyarrow as pa

    rows = [("a", "Ünit the the 7"), ("b", None), ("c", "-- the!!"), ("d", "")]
    got = {r.term: (r.n, r.dl) for r in postings.term_counts(frame(spark, rows)).collect()}
    assert got == {"": (4, 5), "ünit": (1, 4), "the": (2, 5), "7": (1, 4)}
    terms, impact, kh = ["a", "b", "b", "b", "b", "c", "𝒳"], [1.0, 3.0, 2.0, 2.0, 1.0, 9.0, 1.0], [5, 5, 6, 8, 0, 0, 0]
    bounds = [("b", 2.5, 0), ("b", 2.0, 7), ("ｂ", 1.0, 0)]
    at = postings._ranges(pa.array(terms), *map(postings.np.array, (impact, kh)), bounds)
    assert at.tolist() == [sum((t, -i, h) >= (bt, -bi, bh) for bt, bi, bh in bounds) for t, i, h in zip(terms, impact, kh, strict=True)] == [0, 0, 1, 2, 2, 2, 3]


def test_a_segment_is_packed_before_its_shuffle(spark, tmp_path, monkeypatch):
    """A task has a row for each range of what it counts, not one for each text and word; an update by no texts adds no segment."""
    index, seen = Postings(spark, f"file://{tmp_path}/index"), []
    whole = type(frame(spark, [])).repartitionById
    monkeypatch.setattr(type(frame(spark, [])), "repartitionById", lambda df, n, by: (seen.append((n, df.count(), df.rdd.getNumPartitions())), whole(df, n, by))[1])
    rows = drawn(5000, 9)
    index.update(frame(spark, rows))
    ((n, packed, tasks),) = seen
    assert n > 1 and packed <= n * tasks
    index.update(frame(spark, []))
    assert len(index._rows()) == 1 and ranked(index.search("cat ünit", 30)) == plain_rank(spark, rows, "cat ünit", 30)
