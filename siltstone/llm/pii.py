"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the matches of four base expressions. The word before an identifier is a lexical pattern; looser shapes of the same kinds give
candidates, which count for nothing by themselves. Patterns and identifiers form a graph that is scored in rounds until nothing changes: a
pattern's confidence is the mean score of the identifiers it is seen with, times its specificity (the share of all its
occurrences in the corpus that such an identifier follows); an identifier's score joins the confidences of its patterns, seeds being 1. A
pattern needs SUPPORT distinct identifiers that count, seeds or not, so learned ones lead to patterns of their own. Candidates whose pattern is trusted and whose score is high are added;
base spans always stay. A pattern whose specificity is below the confidence asked for can never be trusted and is left out
of the graph at once, which loses nothing.

The expressions are possessive and anchored so that Java neither recurses nor starts again within a run it has failed
on: their matches are those of the base expressions, in linear time, whatever the text.

Defined cases: a null text is empty and has no spans. n_email, n_ip, n_card and n_phone count base spans. Repeated rows
each give a row; rows with a null doc_id are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import stored

#: Kinds in their order, their base expressions, and a text that any match contains or matches (asked first, as it is cheaper).
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes: written-out signs in addresses, IPv6, cards in groups with other signs, phones without a plus.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9A-Fa-f:]))[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}+",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}(?:[./_][0-9]{4}){2,3}(?![0-9])",
    "phone": r"(?:\G|(?<![0-9+]))\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+",
}
SUPPORT = 3
CONFIDENCE = 0.5
SCORE = 0.5
#: The rise of a score that counts as none.
RISE = 1e-4
BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    digit = lambda k: F.substring(d, k, F.lit(1)).cast("int")
    term = lambda k: F.when((F.length(d) - k) % 2 == 0, digit(k)).otherwise(digit(k) * 2 - F.when(digit(k) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, k: a + term(k)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The test that a match of a base expression must pass."""
    if kind == "ip":
        part = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(12, 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, ask: Column, test) -> Column:
    """Array of (start, kind, end, left, inst) of the matches that pass the test; offsets in code points, end exclusive."""
    none = F.lit(None).cast("array<struct<start:int,kind:int,end:int,left:string,inst:bigint>>")
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    # Each value is the only element of an array, so that it is computed once and not for every element below.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def spans(s):
        steps = F.zip_with(F.transform(s["g"], F.length), F.transform(s["m"], F.length), lambda a, b: a + F.coalesce(b, F.lit(0)))
        return let(F.struct(s["m"].alias("m"), s["g"].alias("g"), steps.alias("l")), blocks)

    def total(a):
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def blocks(s):
        sums = F.transform(F.sequence(F.lit(0), (F.size(s["l"]) / BLOCK).cast("int")), lambda c: total(F.slice(s["l"], c * BLOCK + 1, BLOCK)))
        return let(F.struct(s["m"].alias("m"), s["g"].alias("g"), s["l"].alias("l"), sums.alias("b")), place)

    def place(s):
        def one(x, i):
            block = (i / BLOCK).cast("int")
            gap = F.get(s["g"], i)
            start = total(F.slice(s["b"], 1, block)) + total(F.slice(s["l"], block * BLOCK + 1, i % BLOCK)) + F.length(gap)
            # The last word, mostly within forty characters; the whole gap is looked at only where these hold no beginning of it.
            near = F.rtrim(F.regexp_replace(F.right(gap, F.lit(40)), r"[\x09-\x0D]", " "))
            short = near.contains(" ") | (F.length(gap) <= 40)
            left = F.lower(F.substring_index(F.when(short, near).otherwise(F.rtrim(F.regexp_replace(gap, r"[\x09-\x0D]", " "))), " ", -1))
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x)).alias("end"), left.alias("left"), F.xxhash64(F.lower(x)).alias("inst"), test(x).alias("ok"))

        return F.transform(F.filter(F.transform(s["m"], one), lambda e: e["ok"]), lambda e: F.struct(*[e[f] for f in ("start", "kind", "end", "left", "inst")]))

    return F.when(ask, let(whole, spans)).otherwise(none)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda e: F.concat_ws(":", F.get(name, e["kind"]), e["start"].cast("string"), e["end"].cast("string"))), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base and loose (arrays of spans; loose ones overlap no base span) for each row of docs."""
    t = F.col("text")
    ask = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.contains("+")}
    loose_ask = {"email": t.contains("@") | t.rlike(r"[(\[]at[)\]]"), "ip": t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": t.rlike(r"[0-9]{4}[./_][0-9]"), "phone": t.rlike(r"[0-9][\x20().-]{1,3}[0-9]")}
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,left:string,inst:bigint>>")
    every = lambda tables: F.array_sort(F.flatten(F.array(*[F.coalesce(c, empty) for c in tables])))
    base = every([matches(t, BASE[k], k, ask[k], lambda x, k=k: valid(k, x)) for k in KINDS])
    enough = {"phone": lambda x: F.length(_digits(x)).between(7, 15) & x.rlike(r"[\x20().-]")}
    loose = every([matches(t, LOOSE[k], k, loose_ask[k], enough.get(k, lambda x: F.lit(True))) for k in KINDS])
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = some.select(F.monotonically_increasing_id().alias("rid"), "doc_id", base.alias("base"), loose.alias("found"))
    apart = F.filter("found", lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.select("rid", "doc_id", "base", apart.alias("loose"))


#: What may stand between a label and an identifier without a blank.
_GLUE = r"[:=(<\[\"'|;,]"


def left_words(text: Column) -> Column:
    """All that may be a left word in a text, in lower case: its words, and of words that go on behind a sign what stands up to the first one."""
    words = F.split(F.lower(text), r"[\x09-\x0D\x20]+")
    both = lambda w: F.when(w.rlike(_GLUE), F.filter(F.array(w, F.regexp_extract(w, rf"^(.*?{_GLUE}).", 1)), lambda x: x != "")).otherwise(F.array(w))
    return F.flatten(F.transform(words, both))


def trusted(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, left, inst) of the candidates to add, by scoring the graph of patterns and identifiers."""
    seen = found.select(F.explode("base").alias("s"), F.lit(1.0).alias("seed")).union(found.select(F.explode("loose").alias("s"), F.lit(0.0)))
    seen = seen.select("s.kind", "s.left", "s.inst", "seed").where("left <> ''")
    edges = stored(seen.groupBy("kind", "left", "inst").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    met = edges.groupBy("kind", "left").agg(F.sum("n").alias("n"), F.sum("seed").alias("seeds"), F.sum(1 - F.col("seed")).alias("others"))
    # Patterns that only seeds have change no score, as those of seeds are fixed.
    met = stored(met.where(F.col("others") > 0))
    words = docs.select(F.explode(left_words(F.col("text").cast("string"))).alias("left")).groupBy("left").agg(F.count(F.lit(1)).alias("all"))
    good = met.join(words, "left").withColumn("specific", F.least(F.col("n") / F.col("all"), F.lit(1.0))).where(F.col("specific") >= CONFIDENCE)
    graph = stored(edges.join(good.select("kind", "left", "specific"), ["kind", "left"]))
    known = stored(graph.groupBy("kind", "inst").agg(F.max("seed").alias("score")))
    before = None
    while True:
        by = graph.join(known.select("kind", "inst", "score"), ["kind", "inst"]).groupBy("kind", "left").agg((F.max("specific") * F.avg("score")).alias("confidence"), F.sum((F.col("score") >= SCORE).cast("int")).alias("support"))
        sure = by.where(F.col("support") >= SUPPORT)
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))
        known = stored(graph.join(sure, ["kind", "left"], "left").join(known.select("kind", "inst", "score"), ["kind", "inst"]).groupBy("kind", "inst").agg(F.greatest(F.max("seed"), 1 - F.coalesce(doubt, F.lit(1.0))).alias("score"), F.max("score").alias("was")))
        # Scores only rise, so the rounds end: when no pattern or identifier joins and no score rises any more.
        patterns, rise, counting = *sure.agg(F.count(F.lit(1))).first(), *known.agg(F.max(F.col("score") - F.col("was")), F.sum((F.col("score") >= SCORE).cast("int"))).first()
        if (patterns, counting) == before and (rise or 0) < RISE:
            break
        before = patterns, counting
    last = graph.join(sure.where(F.col("confidence") >= CONFIDENCE), ["kind", "left"]).join(known.where(F.col("score") >= SCORE).select("kind", "inst"), ["kind", "inst"])
    return last.where("seed = 0").select("kind", "left", "inst")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of docs."""
    found = stored(found_spans(docs))
    add = stored(trusted(found, docs))
    more = found.select("rid", F.explode("loose").alias("s")).join(add.select(F.struct("kind", "left", "inst").alias("k")), F.struct("s.kind", "s.left", "s.inst") == F.col("k"), "left_semi")
    more = more.groupBy("rid").agg(F.collect_list("s").alias("added"))
    count = lambda k: F.size(F.filter("base", lambda e: e["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.join(more, "rid", "left").select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
