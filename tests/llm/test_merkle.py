"""The Merkle manifest against plain code."""

import hashlib
import zlib

from pyspark.sql import functions as F

from siltstone.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def made(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The last node and the siblings of each leaf, level by level."""
    beside, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            beside[k].append((nodes[p // 8 * 8 : p], nodes[p + 1 : p // 8 * 8 + 8]))
            place[k] = p // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], beside


def brute(rows):
    """Rows of lookup_proofs by plain loops; rows: (doc_id, source, lang, n_chars, text)."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = lambda x: (x is not None, x if isinstance(x, int) else (x or "").encode())
    langs = sorted({r[2] for r in rows}, key=low)
    of = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, made(r))) for g in langs}
    trees = [climb([made(r) for r in of[g]]) for g in langs]
    if not trees:
        return []
    root, above = climb([t[0] for t in trees])
    out = []
    for g, (subroot, beside), high in zip(langs, trees, above, strict=True):
        for r, low_ in zip(of[g], beside, strict=True):
            path = [*low_, *high]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = made((*r[:4], r[4].translate(small))) if bad else made(r)
            for a, b in path:
                at = h(*a, at, *b)
            out.append((r[0], made(r), subroot, root, h(*[x for a, b in path for x in [*a, *b]]), at, at == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit("clash"), "idx": F.lit(1), "grp": F.lit("clash"), "root": F.lit(0)})


def same(got, rows):
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr) == sorted(brute(rows), key=repr)


def test_proofs_are_those_of_plain_code(spark, monkeypatch):
    rows = [(k * 7 % 700, f"s{k % 3}", ["en", "de", "fr", None, "ü", "Z"][k % 11 % 6], k, f"Text {k} ÄB" * (k % 5)) for k in range(700)]
    rows += [(None, None, None, None, None), (None, None, "one", None, None), (5, "s", "en", 1, None), (5, "s", "en", 1, ""), (5, "s", "en", 1, ""), (9, "", "", 0, "A" * 200_000)]
    docs = frame(spark, rows).repartition(5)
    assert same(merkle.lookup_proofs(docs), rows)
    monkeypatch.setattr(merkle, "NODES", 9)  # most levels go by a shuffle
    assert same(merkle.lookup_proofs(docs), rows)


def test_small_trees_and_no_rows(spark):
    for rows in ([(1, "a", "en", 1, "B")], [(3, "a", "en", 1, "b")] * 9 + [(k, "a", f"l{k}", 1, "b") for k in range(9)]):
        assert same(merkle.lookup_proofs(frame(spark, rows)), rows)
    assert merkle.lookup_proofs(frame(spark, []).limit(0)).collect() == []


def test_nodes_rebuild_the_root_and_a_changed_leaf_does_not(spark):
    rows = [(k, "a", "en" if k % 3 else "de", 1, f"T{k}") for k in range(100)]
    m = merkle.Manifest(merkle.rows(frame(spark, rows)))
    assert m.nodes.count() == 100 + (9 + 2 + 1) + (5 + 1) + 2 + 1
    p = m.proofs()
    good = p.select(m.fold(F.col("leaf")).alias("r")).distinct().collect()
    assert [r.r for r in good] == [m.root]
    assert p.select(m.fold(merkle.digest(F.lit("x"))).alias("r")).where(F.col("r") == m.root).count() == 0
