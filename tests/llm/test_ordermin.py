"""Order MinHash against plain code, and documents beside their successors."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import ordermin


def plain(text: str, k: int = ordermin.K, least: int = ordermin.LEAST) -> list[tuple[str, ...]]:
    """For each function the selected k-mers in the order of the text."""
    h = ordermin.kmers(ordermin.codes(text))
    seen, own = {}, []
    for i in range(len(h)):
        kmer = text[i : i + k]
        own.append((i, kmer, seen.get(kmer, 0)))
        seen[kmer] = seen.get(kmer, 0) + 1
    base = (1 << 64) - 1

    def mix(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * times & base
        return x ^ x >> 31

    number = [(mix((int(h[i]) + occ * ordermin._BASE) & base) if occ else int(h[i])) >> 32 for i, _, occ in own]
    a, b = ordermin.functions(ordermin.ROWS)
    out = []
    for x, y in zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True):
        chosen = sorted(range(len(own)), key=lambda i: ((number[i] ^ x) * y & 0xFFFFFFFF, i))[:least]
        out.append(tuple(own[i][1] for i in sorted(chosen)))
    return out


def texts():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcé😀") for _ in range(draw.randint(1, 3)))
    out = ["", "a", "abc", "abcdefgh", "abcdefghi", "a" * 500, "ab" * 300, None]
    return out + [" ".join(word() for _ in range(draw.randint(1, 300))) for _ in range(40)]


def test_entries_are_equal_where_the_selected_parts_are():
    own = [t or "" for t in texts()]
    own += [ordermin.edited(a, b)[0] for a, b in zip(own, own[1:], strict=False)]
    fp, chosen = [ordermin.fingerprint(t) for t in own], [plain(t) for t in own]
    for i in range(len(own)):
        for j in range(i):
            assert (fp[i] == fp[j]).tolist() == [x == y for x, y in zip(chosen[i], chosen[j], strict=True)]


def test_blocks_and_shared_beginnings_change_nothing(monkeypatch):
    own = [t or "" for t in texts()]
    want = [ordermin.fingerprint(t) for t in own]
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(ordermin, "BLOCK", block)
        for a, b, fp in zip(own[:20], own[1:21], want, strict=False):
            x, y, new = ordermin.both(a, b)
            assert (x == fp).all() and (y == ordermin.fingerprint(new)).all()


def test_likeness_follows_order_and_content():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(2000)]
    text = " ".join(words)
    near = lambda t: ordermin.likeness(ordermin.fingerprint(text), ordermin.fingerprint(t))
    few, more = words.copy(), words.copy()
    for w, n in ((few, 20), (more, 400)):
        for i in draw.sample(range(2000), n):
            w[i] = "changed"
    turned = " ".join(words[1000:] + words[:1000])
    assert near(text) == 1 and near(" ".join(few)) > 0.6 > near(" ".join(more)) and 0.25 < near(turned) < 0.75 and near(" ".join(words[::-1])) < 0.35
    assert near(" ".join(draw.choice("abcdefghij") * 7 for _ in range(2000))) < 0.1


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        fp, efp = ordermin.fingerprint(t), ordermin.fingerprint(new)
        hexed = lambda x: x.tobytes().hex()
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), hexed(fp), hexed(efp), float(np.mean(fp == efp)), float(np.mean(fp == ordermin.fingerprint(u)))))
    return sorted(out, key=repr)


def test_documents_beside_their_successors(spark):
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts())] + [(None, "no id at all"), (10_000, "x y z " * 50_000), (10_001, "x y z " * 49_999 + "end"), (10_002, "")]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").withColumns({"h": F.lit("clash"), "part": F.lit(1), "n_chars": F.lit(0)})
    assert sorted(map(tuple, ordermin.order_fingerprints(docs.repartition(5)).collect()), key=repr) == brute(rows)


def test_repeated_rows_a_lone_row_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for rows in ([(1, "the same text again and again")] * 9, [(7, "just one text here")]):
        assert sorted(map(tuple, ordermin.order_fingerprints(frame(rows).repartition(3)).collect()), key=repr) == brute(rows)
    assert ordermin.order_fingerprints(frame([(1, "a")]).limit(0)).collect() == []
