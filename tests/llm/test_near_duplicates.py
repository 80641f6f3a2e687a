"""SimHash and embedding near-duplicates against brute force."""

import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import shared, simhash, vectors


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, cell string")
    got = simhash.near_duplicates(docs, **kw).collect()
    fps = [fingerprint(t) for _, t, *_ in rows]
    g = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[g[k]] = min(low.get(g[k], r[0]), r[0])
    want = sorted(((r[0], f"{fps[k]:016x}", low.get(g[k])) for k, r in enumerate(rows)), key=repr)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == want


def texts():
    rng = random.Random(4)
    words = ["w%d" % k for k in range(300)]
    out = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(5, 400))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    return out + [None, "", " \t\n", "One", "one two", "ONE two", "é 　x y", "a" * 5000, "b " * 5000]


def test_simhash_against_brute_force(spark):
    rows = [(k, t, 0, "x") for k, t in enumerate(texts())]
    rows += [(None, "w1 w2 w3 w4", 0, "x"), (5, rows[5][1], 0, "x"), (None, rows[0][1], 0, "x"), (900, "w1 w2 w3 w4", 0, "x")]
    check(spark, rows)
    check(spark, rows, tile=4)  # many tiles


def test_keep_one_of_repeated_and_missing_ids(spark):
    t, u, v = "some words of a text that is here twice", "quite another text about other things here", "the third of the texts has nothing of the others"
    docs = spark.createDataFrame([(3, t), (5, t), (5, u), (None, v), (None, v), (None, u), (9, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(3, t), (5, u), (None, v), (8, "")], key=repr)


def test_simhash_empty_table_and_keep_one(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "some words of a text that is here twice"
    docs = spark.createDataFrame([(3, t, "x"), (1, t, "y"), (1, t, "y"), (7, "quite another text about other things", "z"), (None, t, "n")], "doc_id long, text string, fp string")
    assert sorted([r.doc_id for r in simhash.keep_one(docs).collect()], key=repr) == [1, 7]  # a copy without an id gives way to those that have one


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400)], "a long, b long")
    got = {r.node: r.component for r in shared.components(e).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == 400 == got[400]
    assert shared.components(e.limit(0)).collect() == []


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for _ in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((k, [float(x) for x in base + rng.normal(size=16) * rng.choice([0, 0.03, 0.05])], int(rng.integers(0, 2))))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, rows[0][1], None), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [math.nan] + [1.0] * 15, 0), (k + 5, [None] + [1.0] * 15, 0), (k + 6, [math.inf] + [1.0] * 15, 0), (k + 7, [1.0, 2.0], 0), (k + 8, [], 0), (k + 9, [x * 1e-30 for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]

    def linked(i, j):
        if not (ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98

    g = groups(len(rows), linked)
    low = {}
    for i, r in enumerate(rows):
        low[g[i]] = min(low.get(g[i], r[0]), r[0])
    for tile, bucket in ((2048, 512), (3, 512), (2048, 4)):
        got = {r.vec_id: r for r in vectors.near_vectors(df, tile=tile, bucket=bucket).collect()}
        for i, r in enumerate(rows):
            n = sum(linked(i, j) for j in range(len(rows)) if j != i)
            assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (n, low[g[i]], low[g[i]] == r[0])
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_keep_one_of_unrelated_texts_with_one_id(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b = text(), text()
    docs = spark.createDataFrame([(3, a), (3, b), (3, b), (8, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(3, a), (3, b)])


def test_vectors_of_repeated_and_missing_ids(spark):
    """Rows of one id are vectors of their own that count each other; without an id a row has no links."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(4, a, "x"), (4, a, "x"), (2, [0.999, 0.01, 0.0], "x"), (None, a, "x"), (7, b, None), (8, b, "y"), (9, None, "y"), (10, [float("nan"), 1.0, 0.0], "y"), (11, [0.0, 0.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("n_links", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (None, 0, None, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True)], key=repr)
    assert vectors.near_vectors(df.limit(0)).collect() == []
