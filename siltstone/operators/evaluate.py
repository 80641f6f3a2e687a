"""Scoring of extracted metadata against gold labels, case selection and summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

#: Weights of the fields in a case's score, of the parts of an audit score, and of the parts of a summary's rubric.
FIELD_WEIGHTS = {
    "doc_type": 0.18, "topics": 0.18, "keywords": 0.14, "key_facts": 0.16, "suggested_tags": 0.10, "suggested_folder": 0.10,
    "importance": 0.06, "entities_people": 0.03, "entities_places": 0.02, "entities_orgs": 0.01, "entities_dates": 0.01, "summary": 0.01,
}
AUDIT_WEIGHTS = {"extraction_core": 0.7, "filing_taxonomy": 0.2, "summary_quality": 0.1}
AUDIT_FIELDS = ("doc_type", "topics", "keywords", "key_facts", "importance", "entities_people", "entities_places", "entities_orgs", "entities_dates")
RUBRIC_WEIGHTS = {"coverage": 0.5, "brevity": 0.25, "hallucination": 0.25}
#: Thresholds of the hard flags (characters of a prompt, milliseconds of an answer), words of critical cases, date formats.
LONG, HUGE, SLOW, VERY_SLOW = 25_000, 250_000, 10_000, 25_000
CRITICAL = r"(?i)\b(payment|billing|rent|collection|cleared|failed|invoice|charge|tenant|lease|eviction|maintenance|damage|urgent|scam)\b"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")
#: Words that say nothing, and words that count as each other (those that the stemmer leaves as they are).
STOP = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "this", "to", "with"]
EQUIVALENTS = {
    "billing": ["bill", "bills", "payment", "payments", "finance", "invoice", "invoices"],
    "bill": ["billing", "bills", "payment", "payments", "finance", "invoice"],
    "communication": ["communications", "correspondence", "inquiry", "inquiries", "message", "messages"],
    "delivery": ["deliveries", "pickup", "order", "orders"],
    "estate": ["property", "housing", "rental"],
    "finance": ["billing", "bill", "bills", "payment", "payments", "invoice", "invoices", "receipt", "receipts"],
    "housing": ["property", "real", "estate", "rental", "rentals", "tenant"],
    "inquiry": ["inquiries", "communication", "communications", "message", "messages", "lead", "leads"],
    "invoice": ["invoices", "billing", "bill", "payment", "payments", "receipt"],
    "lead": ["leads", "inquiry", "inquiries", "prospect", "tenant"],
    "message": ["messages", "communication", "communications", "inquiry", "inquiries"],
    "notification": ["notice", "email"],
    "order": ["orders", "delivery", "deliveries", "pickup"],
    "payment": ["payments", "billing", "bill", "bills", "finance", "invoice", "receipt"],
    "pickup": ["pick", "up", "order", "orders", "delivery"],
    "property": ["real", "estate", "housing", "rental", "rentals"],
    "real": ["estate", "property", "housing", "rental"],
    "receipt": ["receipts", "billing", "bill", "bills", "finance", "invoice", "payment"],
    "rent": ["rental", "rentals", "renter", "tenant", "lease", "leasing"],
    "rental": ["rent", "rentals", "renter", "tenant", "lease", "leasing", "housing", "property"],
    "renter": ["rent", "rental", "rentals", "tenant", "prospect", "inquiry"],
    "tenant": ["renter", "rental", "rent", "lease", "leasing", "housing"],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scalar(value: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[_-]", " "), r"\s+", " "))


def stem(token: Column) -> Column:
    """Plural endings off words of more than four letters."""
    n = F.length(token)
    return F.when((n > 4) & token.endswith("ies"), F.concat(F.left(token, n - 3), F.lit("y"))).when((n > 4) & token.endswith("s") & ~token.endswith("ss"), F.left(token, n - 1)).otherwise(token)


def token_set(value: Column, expand: bool = False) -> Column:
    """Distinct stemmed words of a text that say something; expanded ones bring those that count as them."""
    words = F.transform(F.regexp_extract_all(scalar(value), F.lit("[a-z0-9]+"), F.lit(0)), stem)
    own = F.array_except(words, F.array(*[F.lit(w) for w in STOP]))
    if not expand:
        return own
    same = F.create_map(*[x for k, v in EQUIVALENTS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return let(own, lambda o: F.array_union(o, F.flatten(F.transform(o, lambda t: F.coalesce(F.try_element_at(same, t), F.array().cast("array<string>"))))))


def _both(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """A column of two sets, each made once."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: body(x["a"], x["b"]))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _edge(a: Column, b: Column, value: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def jaccard(a: Column, b: Column) -> Column:
    return _edge(a, b, _shared(a, b) / F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    return _edge(a, b, 2 * _shared(a, b) / (F.size(a) + F.size(b)))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of sets: their Dice similarity."""
    return dice(a, b)


def iso_date(value: Column) -> Column:
    """A date in any of the known formats as ISO text, else the normalised text."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.initcap(F.lower(value)), r"(?i)(\d+)(st|nd|rd|th)\b", "$1"), r"[,\s]+", " "))

    def read(c):
        """The formats that a text has the outline of; one that cannot match costs an exception in each row."""
        tried = [F.when(c.rlike(_outline(f)), F.try_to_date(c, f)) for f in DATE_FORMATS]
        return F.date_format(F.coalesce(*tried), "yyyy-MM-dd")

    return F.coalesce(let(clean, read), scalar(value))


def _outline(date_format: str) -> str:
    """What every text of a date format has: four digits of a year, a word for a month's name, its separators."""
    known = {"yyyy": r"[-+]?\d{4,}", "MMMM": r"\D+", "MMM": r"\D+"}
    return "^" + "".join(known.get(p, ".*") if p.isalpha() else p for p in re.findall("[A-Za-z]+|[^A-Za-z]+", date_format)) + "$"


def importance_score(a: Column, b: Column) -> Column:
    """1 less the distance of two importances; what is no finite number counts as missing."""

    def num(c):
        x = F.nullif(scalar(c), F.lit("")).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))

    return F.when(num(a).isNull() & num(b).isNull(), 1.0).when(num(a).isNull() | num(b).isNull(), 0.0).otherwise(F.round(1.0 - F.abs(num(a) - num(b)), 6))


def summary_score(predicted: Column, canonical: Column) -> Column:
    """The better of F1 and recall of the gold words, both texts expanded."""
    return _both(token_set(predicted, True), token_set(canonical, True), lambda a, b: _edge(a, b, F.round(F.greatest(token_f1(a, b), _shared(a, b) / F.size(b)), 6)))


def folder_score(predicted: Column, canonical: Column, alternates: Column | None = None) -> Column:
    """1 for an accepted path; 0.5 for the beginning of one; for a deeper one a tenth less a level, 0.8 at least; else shared words, the last segment counting a third."""
    norm = lambda c: F.regexp_replace(scalar(c), "^/+|/+$", "")
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    p, m = norm(predicted), F.size(parts(norm(predicted)))
    every = F.array(canonical) if alternates is None else F.concat(F.array(canonical), alternates)
    accepted = F.filter(F.transform(every, norm), lambda x: x != "")

    def along(x):
        q = parts(x)
        n = F.size(q)
        return F.when((m <= n) & (parts(p) == F.slice(q, 1, m)), 0.5).when((n < m) & (q == F.slice(parts(p), 1, n)), F.round(F.greatest(F.lit(0.8), 1.0 - 0.1 * (m - n)), 6))

    def by_words(x):
        leaf = lambda c: token_set(F.coalesce(F.try_element_at(parts(c), F.lit(-1)), F.lit("")), True)
        return 0.65 * token_f1(token_set(p, True), token_set(x, True)) + 0.35 * token_f1(leaf(p), leaf(x))

    near = F.get(F.filter(F.transform(accepted, along), lambda x: x.isNotNull()), 0)
    words = F.round(F.coalesce(F.array_max(F.transform(accepted, by_words)), F.lit(0.0)), 6)
    return F.when(p == "", (scalar(canonical) == "").cast("double")).when(F.array_contains(accepted, p), 1.0).otherwise(F.coalesce(near, words))


def audit_tags_score(predicted: Column, canonical: Column, alternates: Column) -> Column:
    """Mean of the precision against all accepted tags and of the recall of the canonical ones; arrays of normalised tags."""
    precision = _shared(predicted, F.array_union(canonical, alternates)) / F.size(predicted)
    recall = F.when(F.size(canonical) > 0, _shared(predicted, canonical) / F.size(canonical)).otherwise(1.0)
    return F.when((F.size(predicted) == 0) & (F.size(canonical) == 0), 1.0).when(F.size(predicted) == 0, 0.0).otherwise(F.round((precision + recall) / 2, 6))


def _points(points: Column) -> Column:
    return F.filter(points, lambda x: F.trim(x) != "")


def coverage_score(summary: Column, points: Column) -> Column:
    """The mean share of each point's words that a summary has."""

    def mean(own):
        share = lambda t: F.when(F.size(t) == 0, 1.0).otherwise(_shared(own, t) / F.size(t))
        each = F.transform(F.transform(_points(points), lambda x: token_set(x)), share)
        return let(each, lambda s: F.when(F.size(s) == 0, 1.0).otherwise(F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s), 6)))

    return let(token_set(summary), mean)


def brevity_score(summary: Column, sentences: Column, words: Column) -> Column:
    """The mean of both limits' scores, each less by the share that is over; limits of 0 are none."""
    within = lambda size, most: let(size, lambda have: F.when((most <= 0) | (have <= most), 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - (have - most) / most), 6)))
    n = F.when(F.trim(summary) == "", 0).otherwise(F.greatest(F.lit(1), F.size(F.filter(F.split(summary, "[.!?]+"), lambda x: F.trim(x) != ""))))
    return F.when((sentences <= 0) & (words <= 0), 1.0).otherwise(F.round((within(n, sentences) + within(F.size(token_set(summary)), words)) / 2, 6))


def hallucination_score(summary: Column, forbidden: Column) -> Column:
    """1 less the largest similarity to a forbidden point."""
    worst_ = let(token_set(summary), lambda own: F.array_max(F.transform(F.transform(_points(forbidden), lambda x: token_set(x)), lambda x: dice(own, x))))
    return F.when(F.size(_points(forbidden)) == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - worst_), 6))


def rubric_score(summary: Column, points: Column, sentences: Column, words: Column, forbidden: Column) -> Column:
    w = RUBRIC_WEIGHTS
    return F.round(coverage_score(summary, points) * w["coverage"] + brevity_score(summary, sentences, words) * w["brevity"] + hallucination_score(summary, forbidden) * w["hallucination"], 6)


def extraction_core(scores: dict[str, Column]) -> Column:
    """The weighted mean of the fields that an audit counts."""
    total = sum(FIELD_WEIGHTS[f] for f in AUDIT_FIELDS)
    return F.round(sum((F.coalesce(scores[f], F.lit(0.0)) * FIELD_WEIGHTS[f] for f in AUDIT_FIELDS), F.lit(0.0)) / total, 6)


def _plain_tokens(value: str, expand: bool = False) -> set[str]:
    own = set()
    for t in re.findall("[a-z0-9]+", re.sub("[_-]", " ", value.lower())):
        plural = len(t) > 4 and t.endswith("s")
        t = f"{t[:-3]}y" if plural and t.endswith("ies") else t[:-1] if plural and not t.endswith("ss") else t
        own.add(t)
    own -= set(STOP)
    return own.union(*(EQUIVALENTS.get(t, ()) for t in own)) if expand else own


def _plain_dice(a: set, b: set) -> float:
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def phrases_similarity(predicted: list[str], expected: list[str]) -> float:
    """The best of a greedy matching of phrases (each expected one used once, over the longer list) and of F1 of all words, plain and expanded."""
    a, b = (sorted({" ".join(re.sub("[_-]", " ", x.lower()).split()) for x in c if x} - {""}) for c in (predicted, expected))
    if not a or not b:
        return float(not a and not b)
    left, total = [_plain_tokens(x) for x in b], 0.0
    for x in map(_plain_tokens, a):
        sims = [_plain_dice(x, y) for y in left]
        if sims and max(sims) > 0:
            total += max(sims)
            left.pop(sims.index(max(sims)))
    every = lambda c, e: set().union(*(_plain_tokens(x, e) for x in c))
    return round(max(total / max(len(a), len(b)), *(_plain_dice(every(a, e), every(b, e)) for e in (False, True))), 6)


@F.pandas_udf(DoubleType())
def phrase_match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """phrases_similarity of two arrays; the matching is sequential, so it is no expression."""
    none = lambda x: [] if x is None else list(x)
    for a, b in batches:
        yield pd.Series([phrases_similarity(none(x), none(y)) for x, y in zip(a, b, strict=True)])


def case_score(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum, each part to six places; fields without a score count 0."""
    w = FIELD_WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for f, c in scores.items():
        total = total + F.round(F.coalesce(c, F.lit(0.0)) * w[f], 6)
    return F.round(total, 6)


def audit_score(parts: dict[str, Column]) -> Column:
    return F.round(sum((parts[k] * w for k, w in AUDIT_WEIGHTS.items()), F.lit(0.0)), 6)


def hard_flags(length: Column, prompt: Column, title: Column, success: Column, latency: Column, parseable: Column) -> Column:
    """Names of what makes a case hard."""
    rules = {
        "long_prompt": length >= LONG, "huge_prompt": length >= HUGE,
        "nearby_context": prompt.contains("NEARBY SAME-CHANNEL CONTEXT CANDIDATES") | prompt.contains("BEFORE MESSAGES"),
        "taxonomy_bloat": prompt.contains("## Available Tags") | prompt.contains("## Available Folders"),
        "link_noise": prompt.rlike(r"https?://"), "business_critical": prompt.rlike(CRITICAL) | title.rlike(CRITICAL),
        "slow_success": success & (latency >= SLOW), "very_slow_success": success & (latency >= VERY_SLOW), "parse_suspect": success & ~parseable,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def summary(results: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """One row: cases, mean score, failure rate, exact latency percentiles, means by field (missing as 0)."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("failure_rate"),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("p95"), *[F.round(F.avg(F.coalesce(f, F.lit(0.0))), 6).alias(f"mean_{f}") for f in fields])


def by_flag(results: DataFrame, flags: str = "flags") -> DataFrame:
    """Cases, mean score and failure rate for each flag."""
    each = results.select(F.explode(flags).alias("flag"), "score", "failed")
    return each.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("failure_rate"))


def failures_by(results: DataFrame, kind: Column) -> DataFrame:
    return results.where("failed").groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def worst(results: DataFrame, n: int = 5, key: str = "case_id") -> DataFrame:
    return results.orderBy("score", key).limit(n)


def round_robin(cases: DataFrame, category: str, n: int, seed: int = 0, key: str = "case_id") -> DataFrame:
    """n cases, the categories taking turns, in a seeded order within each; only the first n of a category are ranked on."""
    w = W.partitionBy(category).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return cases.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", category).limit(n)


def balanced_hard_cases(cases: DataFrame, n: int, key: str = "case_id") -> list:
    """Keys of n cases, rarest flags first, each flag in turn giving its hardest case, then the hardest that are left.

    Per flag only the n hardest cases can be taken, so what reaches the driver is bounded by n times the number of flags.
    """
    hard = F.size("flags")
    each = cases.select(key, hard.alias("hard"), F.explode("flags").alias("flag"))
    counts = {r.flag: r.n for r in each.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = each.withColumn("r", F.row_number().over(W.partitionBy("flag").orderBy(F.desc("hard"), key))).where(F.col("r") <= n)
    queues: dict[str, list] = {f: [] for f in counts}
    for r in top.orderBy("flag", "r").collect():
        queues[r.flag].append((-r.hard, r[key]))
    taken: list = []
    while len(taken) < n and any(queues.values()):
        for f in sorted(queues, key=lambda f: (counts[f], f)):
            queues[f] = [x for x in queues[f] if x[1] not in taken]
            if queues[f] and len(taken) < n:
                taken.append(queues[f].pop(0)[1])
    return taken
