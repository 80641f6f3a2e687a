"""Divergence of sources against plain code in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Rows of source_divergence by plain loops; rows: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df, n = Counter(), defaultdict(Counter)
        for words, g, s in docs:
            if g == lang:
                df.update(set(words))
                n[s].update(words)
        kept = [t for t in df if df[t] >= 3]
        every = Counter()
        for c in n.values():
            every.update(c)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in n.items()}, share(every)
        for s in n:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in n if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"gid": F.lit("clash"), "p": F.lit(1), "term": F.lit(2), "doc_id": F.lit(1)})


def table():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcéZ日") for _ in range(draw.randint(1, 4))) for _ in range(150)]
    text = lambda s: " ".join(draw.choice(words[: 150 if draw.random() < 0.5 else 10] + [f"own{s}"] * 3) for _ in range(draw.randint(0, 60)))
    rows = [(text(s), g, f"s{s}") for g in ("en", "de", None) for s in range(11) for _ in range(draw.randint(1, 8))]
    rows += [(None, "en", None), ("", "en", ""), ("12 34 \x00", "fr", "a"), ("once only", "fr", "b"), (None, None, "Ä"), ("alone alone", "it", "x")] + [("same words here Ä", "it", "x")] * 5
    return [*rows, ("long wörds " * 30_000, "en", "s1")]


def test_all_parts_are_those_of_plain_code(spark):
    rows = table()
    got = divergence.source_divergence(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert divergence.source_divergence(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("few", "side", "tile"), [(0, 4, 7), (1, 3, 1000), (100, 256, 16)])
def test_tiles_and_postings_add_up_however_they_are_cut(spark, few, side, tile):
    rows = table()
    shares = divergence.Shares(frame(spark, rows))
    names = {(r.lang, r.gid): r.source for r in shares.groups.collect()}
    got = {(r.lang, names[r.lang, r.gid], names[r.lang, r.other]): r.value for r in shares.pair_sums(few, side, tile).collect()}
    assert got == {(g, s, item): value for g, s, part, item, value, _ in brute(rows) if part == "pair"}


def test_terms_are_counted_alike_in_small_slices(spark):
    docs = frame(spark, table())
    both = [sorted(map(tuple, divergence.term_counts(docs, at_once=n).collect())) for n in (1, 300, 1 << 20)]
    assert both[0] == both[1] == both[2]
