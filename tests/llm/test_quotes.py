"""Quotation linking on small conversations."""

import random

from pyspark.sql import functions as F

from siltstone.llm import quotes

ROWS = [
    (1, 0, "user", "First question?\nSecond line"),
    (1, 1, "assistant", "On Monday X wrote:\n> first   QUESTION?\nAn answer\n"),
    (1, 2, "user", "unrelated"),
    (1, 3, "user", ">> First question?\n> An answer\n\nBut why"),
    (1, 4, "user", "> never said\nHm"),
    (1, 5, "user", "An answer"),
    (1, 6, "user", "> But why\n> Second line\n> second line\nlast"),
    (1, 7, "user", "> An answer\nyes"),
    (1, 2000, "user", "> last\nfar"),
    (2, 0, "user", "> First question?\nelsewhere"),
    (3, 0, "user", None), (4, None, "user", "> a\nb"), (None, 1, "user", "c"),
    (5, 0, "user", ">" * 5000 + "x"), (5, 1, "user", "> > nested\n>\nplain > sign"),
]


def run(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}


def test_links_and_threads(spark):
    r = run(spark)
    assert len(r) == len(ROWS)
    assert (r[1, 1].reply_to, r[1, 1].thread, r[1, 1].text) == (0, 0, "An answer")
    assert (r[1, 3].reply_to, r[1, 3].thread, r[1, 3].n_quoted, r[1, 3].n_linked) == (1, 0, 2, 2) and r[1, 3].text == "But why"
    assert (r[1, 4].reply_to, r[1, 4].thread, r[1, 4].n_linked) == (None, 4, 0)
    assert (r[1, 6].reply_to, r[1, 6].thread) == (0, 0)
    assert (r[1, 7].reply_to, r[1, 7].thread) == (5, 5)
    assert (r[1, 2000].reply_to, r[1, 2000].thread) == (6, 0)
    assert r[2, 0].reply_to is None and r[2, 0].text == "elsewhere"
    assert r[3, 0].text == "" and r[4, None].reply_to is None and r[None, 1].text == "c"
    assert r[5, 0].text == "" and r[5, 1].text == "plain > sign" and r[5, 1].n_quoted == 1


def test_a_line_said_and_quoted_often(spark):
    n = 3000
    rows = [(1, k, "user", "thanks" if k % 2 == 0 else "> thanks\nok") for k in range(n)]
    r = run(spark, rows)
    assert all(r[1, k].reply_to == k - 1 for k in range(1, n, 2))


def test_texts_without_quotes_stay(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    got = quotes.conversations(df)
    assert got.count() == df.count()
    assert got.join(df.select("conv_id", "turn", F.col("text").alias("was")), ["conv_id", "turn"]).where("text <> was or thread <> turn").count() == 0


def test_empty_table(spark):
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def plain(messages):
    """reply_to, thread and counts of {turn: text} by their definitions."""
    import re
    from collections import Counter

    said, out = {}, {}
    for turn in sorted(messages):
        lines = [(lambda m: (m.count(">"), " ".join(x[len(m) :].lower().split())))(re.match(r"^(?:[ \t]{0,3}>)*", x).group()) for x in messages[turn].split("\n")]
        quoted = [(k, t) for k, t in lines if k > 0 and t]
        links = [(k, said[t]) for k, t in quoted if t in said]
        reply = None
        if links:
            outer = min(k for k, _ in links)
            reply = max((n, s) for s, n in Counter(s for k, s in links if k == outer).items())[1]
        out[turn] = (reply, out[reply][1] if reply is not None else turn, len(quoted), len(links))
        for k, t in lines:
            if k == 0:
                said[t] = turn
    return out


def test_nested_quotes_against_a_plain_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(12):
        texts = {}
        for turn in range(rng.randint(3, 14)):
            own = [f"line {rng.randint(0, 6)} of {rng.randint(0, 3)}" for _ in range(rng.randint(1, 3))]
            before = []
            if texts and rng.random() < 0.8:
                of = texts[rng.choice(sorted(texts))].split("\n")
                before = [("> " if rng.random() < 0.5 else ">") + x for x in of if rng.random() < 0.8]
                before = [x.replace("line", "changed") if rng.random() < 0.2 else x for x in before]
            texts[turn] = "\n".join(before + own if rng.random() < 0.5 else own + before)
            rows.append((conv, turn, "user", texts[turn]))
        want |= {(conv, t): v for t, v in plain(texts).items()}
    rng.shuffle(rows)
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.n_quoted, r.n_linked) for r in got} == want
    order = []

    def walk(conv, turn):
        order.append((conv, turn))
        for t in sorted(t for (c, t), v in want.items() if c == conv and v[0] == turn):
            walk(conv, t)

    for conv, turn in sorted(k for k, v in want.items() if v[0] is None):
        walk(conv, turn)
    assert [(r.conv_id, r.turn) for r in got] == order and any(a[0] == b[0] and a[1] > b[1] for a, b in zip(order, order[1:], strict=False))
    assert not any(line.startswith(">") for r in got for line in r.text.split("\n"))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "a", "hello there", "x"), (1, 1, "b", "> hello there\nyes", "y"), (1, 1, "b", "> hello there\nyes", "y"), (None, 2, "c", "> hello there", "z"), (1, None, "c", None, "z")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string")
    got = quotes.conversations(docs).collect()
    assert len(got) == 5 and sorted((r.turn, r.thread) for r in got if r.conv_id == 1 and r.turn is not None) == [(0, 0), (1, 0), (1, 0)]
    assert {r["row"].thread for r in quotes.link_quotes(docs).collect()} == {"x", "y", "z"}
    assert quotes.conversations(docs.limit(0)).collect() == []


def test_replies_stand_behind_what_they_answer(spark):
    rows = [(1, 0, "a", "root line"), (1, 1, "b", "> root line\nfirst"), (1, 2, "c", "> root line\nsecond"), (1, 3, "d", "> first\nthird"), (1, 4, "e", "> third\nfourth"), (1, 5, "f", "> second\nfifth"), (1, 6, "g", "alone")]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.thread, r.place) for r in got] == [(0, 0, 0), (1, 0, 1), (3, 0, 2), (4, 0, 3), (2, 0, 4), (5, 0, 5), (6, 6, 0)]
    long = "\n".join(f"> line {k}" for k in range(40_000))
    many = [(1, 0, "a", "\n".join(f"line {k}" for k in range(40_000)))] + [(1, k, "b", f"> line {k}\nanswer {k}") for k in range(1, 400)] + [(1, 400, "c", long)]
    got = quotes.conversations(spark.createDataFrame(many, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.place) for r in got] == [(k, k) for k in range(401)] and got[-1].n_linked == 40_000
