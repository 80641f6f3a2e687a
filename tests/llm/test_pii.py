"""Personal data: base spans against plain Python, learned spans in a small corpus."""

import hashlib
import random
import re
from collections import Counter

from siltstone.llm import pii, shared

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(text):
    out = []
    for order, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


TEXTS = [
    None, "", "a@b.c a@b@c.d x.y@z.q.r, a@b.c_d@e.f a@b a@b. @b.c", "é😀 me@host.org\nand 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 000.0000.1.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 4111  11111111111", "+1 (017) 555-7713 +1 2 +49.30.123456789 + 1 +123456789012345678 ++49 30 1234567-",
    "1" * 3000, "1." * 2000 + "a@" + "b." * 2000 + "c", "x" * 20000 + "@", "+1" + "(" * 3000 + "5", "79927398713 4539 1488 0343 6467",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, base int")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(rows) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        want = brute(t)
        assert rows[k].spans == want, k
        assert rows[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert rows[k].n_email == want.count("email:")


def test_long_texts_take_linear_time(spark):
    n = 15000
    texts = [")" * n, "1 " * n + "(", "1(" * n, "a." * n, "a@" * n, "1.2." * n, "+1 " * n, "ab:" * n, "1" * n + "x", "(at)" * n, "1-" * n + "@"]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        if k not in (3,):  # Python's own matcher is quadratic there; there is no @ to match
            assert rows[k].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest()
    assert rows[3].spans == ""


def test_real_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.personal_data(docs).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()


def test_patterns_find_unseen_identifiers(spark):
    seeds = [f"write to mailbox: user{k}@host.org now" for k in range(6)]
    unseen = ["write to mailbox: jane (at) host (dot) org now", "the word jane (at) host2 (dot) org stands alone"]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert rows[6].spans == "email:18:42" and rows[6].n_email == 0
    assert rows[7].spans == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(docs).collect() == []


def test_learned_identifiers_induce_patterns_of_their_own(spark):
    seeds = [f"mailbox: user{k}@host.org now" for k in range(40)]
    names = ["jane", "joan", "mary", "rosa"]
    learned = [f"mailbox: {x} (at) host (dot) org now" for x in names]
    second = [f"reach: {x} (at) host (dot) org now" for x in [*names, "only"]]
    docs = spark.createDataFrame(list(enumerate(seeds + learned + second)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert all(rows[40 + k].startswith("email:9:") for k in range(4))
    assert all(rows[44 + k].startswith("email:7:") for k in range(5))


def plain_trusted(found, texts):
    """(kind, left, inst) to add, by the definitions, from the spans of each text."""
    edges, words = {}, Counter()
    for r in found:
        for spans, seed in ((r.base, 1.0), (r.loose, 0.0)):
            for s in spans:
                if s.left:
                    e = edges.setdefault((s.kind, s.left, s.inst), [0.0, 0])
                    e[0], e[1] = max(e[0], seed), e[1] + 1
    for t in texts:
        words.update(re.split(r"[\x09-\x0D\x20]+", (t or "").lower()))
    patterns = {}
    for (kind, left, inst), (seed, n) in edges.items():
        patterns.setdefault((kind, left), []).append((inst, seed, n))
    kept = {}
    for p, own in patterns.items():
        specific = min(1.0, sum(n for _, _, n in own) / words[p[1]]) if words[p[1]] else 0.0
        if any(seed < 1 for _, seed, _ in own) and specific >= pii.CONFIDENCE:
            kept[p] = specific
    score = {}
    for (kind, left), own in patterns.items():
        for inst, seed, _ in own if (kind, left) in kept else ():
            score[kind, inst] = max(score.get((kind, inst), 0.0), seed)
    fixed, before = dict(score), None
    while True:
        sure = {}
        for p, specific in kept.items():
            have = [score[p[0], inst] for inst, _, _ in patterns[p]]
            if sum(x >= pii.SCORE for x in have) >= pii.SUPPORT:
                sure[p] = specific * sum(have) / len(have)
        new = {}
        for kind, inst in score:
            doubt = 1.0
            for p, conf in sure.items():
                if p[0] == kind and any(i == inst for i, _, _ in patterns[p]):
                    doubt *= 1 - min(conf, 0.999999)
            new[kind, inst] = max(fixed[kind, inst], 1 - doubt)
        rise, now = max((new[k] - score[k] for k in new), default=0.0), (len(sure), sum(x >= pii.SCORE for x in new.values()))
        score = new
        if now == before and rise < pii.RISE:
            break
        before = now
    return {(k, left, inst) for (k, left), own in patterns.items() if sure.get((k, left), 0) >= pii.CONFIDENCE for inst, seed, _ in own if seed == 0 and score[k, inst] >= pii.SCORE}


def test_scores_of_patterns_against_plain_code(spark):
    rng = random.Random(21)
    leads = ["mail:", "reach", "contact", "see", "x" * 60, "at", "box:", "from\t"]
    texts = []
    for _ in range(150):
        said = []
        for _ in range(rng.randint(1, 3)):
            name, lead = f"user{rng.randint(0, 14)}", rng.choice(leads[: rng.choice([2, 5, 8])])
            shown = f"{name}@host.org" if rng.random() < (0.6 if lead in leads[:2] else 0.15) else f"{name} (at) host (dot) org"
            said.append(f"{rng.choice(['please', 'now see', 'or'])} {lead} {shown}" if rng.random() < 0.85 else f"{lead} nothing at all")
        texts.append("; ".join(said))
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    found = shared.stored(pii.found_spans(docs))
    got = {(r.kind, r.left, r.inst) for r in pii.trusted(found, docs).distinct().collect()}
    want = plain_trusted(found.collect(), texts)
    assert got == want and len({left for _, left, _ in want}) > 2


def test_repeated_rows_and_missing_ids(spark):
    t = "write to me@host.org"
    got = pii.personal_data(spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == sorted([(1, "email:9:20"), (1, "email:9:20"), (None, "email:9:20")], key=repr)


def test_identifiers_that_touch_their_label(spark):
    """A label without a blank behind it is a pattern as well, and one that stands before all sorts of words is none."""
    rows = [(k, f"please see mailbox:user{k}@host.org soon") for k in range(40)] + [(100 + k, f"write to mailbox:jane{k}(at)host{k}(dot)org today") for k in range(4)]
    rows += [(200 + k, f"odd note:user{k}@host.org") for k in range(5)] + [(300 + k, f"odd note:plain{k}") for k in range(60)] + [(400, "odd note:kim(at)host(dot)org")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(4):
        text = rows[40 + k][1]
        start = text.index("jane")
        assert got[100 + k] == f"email:{start}:{text.index(' today')}"
    assert got[400] == "" and got[0].startswith("email:")
