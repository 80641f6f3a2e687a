"""Metadata that a model has written: reading its JSON, normal forms, repairs.

Only finding the JSON object in free text needs Python (a parser with a stack); everything after it is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fields of a record, of which lists are comma-lists but for facts, which are JSON.
LISTS = ("doc_type", "entities_people", "entities_places", "entities_orgs", "entities_dates", "topics", "keywords", "suggested_tags")
TEXTS = ("summary", "suggested_folder")
#: Terms of the repair rules, which count wherever they stand in a text.
PAYMENT = ["balance", "bill", "due", "failed payment", "fee", "invoice", "ledger", "overdue", "payment", "rent", "tenantcloud", "unpaid"]
LEASE = ["agreement", "lease", "renewal", "sign", "signature"]
INQUIRY = ["application question", "rental", "renter", "showing", "tour", "zillow rental manager"]
LISTING = ["coming soon", "listing", "open house", "price cut", "saved search"]
LEGAL = ["court", "eviction", "legal", "notice to quit", "summons"]
DELIVERY = ["delivery", "package", "pickup", "shipping", "tracking", "ups", "usps"]
ESTIMATE = ["estimate", "proposal", "quote", "scope of work"]
ACTION = ["action required", "appointment", "call", "deadline", "due", "failed", "follow up", "must", "overdue", "request", "requested", "requires", "schedule", "sign", "tour"]
GENERIC_TYPES = ["document", "email", "image", "message", "note", "notification", "text"]
GENERIC_FACTS = ["document contains important information", "contains important information", "important information", "document is about", "document discusses", "document provides", "no specific"]
FACT_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "the", "this", "to", "was", "with"]
NEARBY = ["nearby context", "provided context", "nearby message", "nearby messages", "context identifies", "as indicated by context", "as indicated by nearby", "based on context", "from context"]
AMBIGUOUS = ["ambiguous", "ambiguity", "conflict", "conflicting", "correction", "might", "not sure", "possibly", "uncertain"]
MONEY = r"\$\s?\d[\d,]*(?:\.\d{2})?"
DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
FACT_TOKEN = r"[a-z0-9$,.#/-]+"


def _object(text: str | None) -> str | None:
    """The first JSON object in a model's answer, as JSON; a cut-off one is closed after its last whole value."""
    if not text:
        return None
    s = re.sub(r"(?s)<think>.*?</think>", "", re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text))
    start = s.find("{")
    if start < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(s, start)[0], ensure_ascii=False)
    except json.JSONDecodeError:
        pass
    # Walk once, noting where a value has ended and what is open there; the last such place that parses wins.
    ends, stack, quoted, skip = [], [], False, False
    for k in range(start, len(s)):
        c = s[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
            if not quoted:
                ends.append((k + 1, tuple(stack)))
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            ends.append((k + 1, tuple(stack)))
        elif c in "}]" and stack:
            stack.pop()
            ends.append((k + 1, tuple(stack)))
        elif c == ",":
            ends.append((k, tuple(stack)))
    whole = [(s[start:], '"' if quoted else "", tuple(stack))] + [(s[start:k], "", open_) for k, open_ in reversed(ends)]
    reach = len(s)
    for part, close, open_ in whole:
        if len(part) > reach:  # it holds the place where a longer one was found to be broken
            continue
        own = part.rstrip().rstrip(",")
        try:
            got = json.loads(own + close + "".join(reversed(open_)))
        except json.JSONDecodeError as e:
            reach = min(reach, e.pos) if e.pos < len(own) else reach
            continue
        return json.dumps(got, ensure_ascii=False) if isinstance(got, dict) else None
    return None


def extract_json(text: Column) -> Column:
    """The JSON object in an answer, or null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_object)

    return F.pandas_udf(run, StringType())(text)


def _clamped(value: Column) -> Column:
    """A number from text between 0 and 1; null for what is no finite number."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _items(value: Column) -> Column:
    """Items of a JSON list, or a text as its only item; placeholders are left out."""
    v = F.trim(F.coalesce(value, F.lit("")))
    raw = F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v))
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin("string", "...", "n/a", "none", "null", "unknown"))


def normalized(answer: Column) -> dict[str, Column]:
    """Fields enr_* from the JSON of an answer: comma-lists, a JSON list of facts, an importance between 0 and 1."""
    m = F.from_json(answer, "map<string,string>")
    get = lambda k: F.try_element_at(m, F.lit(k))
    out = {f"enr_{k}": F.array_join(_items(get(k)), ", ") for k in LISTS}
    out |= {f"enr_{k}": F.trim(F.coalesce(get(k), F.lit(""))) for k in TEXTS}
    out["enr_importance"] = F.when(get("importance").isNull(), "").otherwise(F.coalesce(_clamped(get("importance")), F.lit(0.5)).cast("string"))
    facts = get("key_facts")
    out["enr_key_facts"] = F.when(facts.isNull(), "").when(F.trim(facts).startswith("["), F.to_json(_items(facts))).otherwise(F.array_join(_items(facts), ""))
    return out


def document_text(text: Column) -> Column:
    """What stands between the marker of the document and that of its context in a prompt."""
    after = F.when(F.instr(text, "Document text:") > 0, F.regexp_replace(text, r"(?s)^.*?Document text:", "")).otherwise(text)
    return F.trim(F.split_part(after, F.lit("NEARBY SAME-CHANNEL CONTEXT CANDIDATES"), F.lit(1)))


def _has(corpus: Column, terms: Sequence[str]) -> Column:
    """Whether a text has one of the terms anywhere, also within a word."""
    return corpus.rlike("|".join(terms))


def repaired_type(current: Column, corpus: Column) -> Column:
    """Types as they are if one says something; else with the first kind that the text's words suggest."""
    values = F.filter(F.transform(F.split(F.coalesce(current, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    telling = F.exists(values, lambda x: ~F.lower(x).isin(GENERIC_TYPES))
    rules = [
        ("legal notice", _has(corpus, LEGAL)), ("payment notice", _has(corpus, PAYMENT) & _has(corpus, ["failed", "due", "overdue", "balance", "payment"])), ("lease administration", _has(corpus, LEASE)),
        ("listing report", corpus.contains("zillow") & _has(corpus, LISTING)), ("rental inquiry", _has(corpus, INQUIRY)), ("delivery notification", _has(corpus, DELIVERY)), ("estimate", _has(corpus, ESTIMATE)),
    ]
    guess = F.coalesce(*[F.when(c, F.lit(k)) for k, c in rules])
    return F.array_join(F.slice(F.when(telling | guess.isNull(), values).otherwise(F.array_append(values, guess)), 1, 5), ", ")


def repaired_importance(current: Column, corpus: Column) -> Column:
    """The larger of what is said and what the text's words suggest, to two places."""
    said = F.coalesce(_clamped(current), F.lit(0.5))
    guess = (
        F.when(_has(corpus, LEGAL), 0.9).when(_has(corpus, ["failed", "overdue", "unpaid"]) & _has(corpus, PAYMENT), 0.85).when(_has(corpus, LEASE) & _has(corpus, ["due", "must", "sign", "renewal"]), 0.8)
        .when(_has(corpus, PAYMENT) & (corpus.rlike(MONEY) | corpus.contains("due")), 0.75).when(_has(corpus, ACTION), 0.7).when(_has(corpus, ESTIMATE + DELIVERY), 0.6).otherwise(0.5)
    )
    return F.round(F.greatest(said, guess), 2).cast("string")


def repaired_facts(facts: Column, corpus: Column, most: int = 6, width: int = 180) -> Column:
    """A JSON list of the facts that say something: ones with an amount or a date, or with two telling words that the text has."""
    v = F.trim(F.coalesce(facts, F.lit("")))
    parsed = F.when(v.startswith("["), F.from_json(v, "array<string>"))
    every = F.filter(F.transform(F.coalesce(parsed, F.array(v)), lambda x: F.trim(x)), lambda x: x != "")
    stop = F.array(*[F.lit(w) for w in FACT_STOP])
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit(FACT_TOKEN), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    shared = lambda x: F.size(F.filter(words(x), lambda w: F.contains(corpus, w)))
    good = F.filter(every, lambda x: ~_has(F.lower(x), GENERIC_FACTS) & (x.rlike(MONEY) | x.rlike(DATE) | (shared(x) >= 2)))
    single = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    cut = lambda x: F.when(F.length(x) > width, F.concat(F.rtrim(F.substring(x, 1, width - 3)), F.lit("..."))).otherwise(x)
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(good, 1, most), lambda x: quoted(cut(single(x)))), ", "), F.lit("]"))


#: Fields of which the words speak for a kind, beside the title, the source's type and the text.
CORPUS = ("enr_summary", "enr_doc_type", "enr_topics", "enr_keywords", "enr_suggested_tags", "enr_suggested_folder")
RULES = ("importance", "doc_type", "key_facts")


def repaired(record: dict[str, Column], text: Column, title: Column, source_type: Column, rules: Sequence[str] = RULES) -> dict[str, Column]:
    """Fields of a record with those of the rules repaired; their words are sought in all that is known of the document."""
    said = F.concat_ws(" ", *[F.coalesce(record[c], F.lit("")) if c in record else F.lit("") for c in CORPUS])
    filled = lambda c: F.when(c != "", c)
    corpus = F.lower(F.concat_ws("\n", filled(title), filled(source_type), filled(document_text(text)), filled(said)))
    of = lambda c: record.get(c, F.lit(""))
    new = {"doc_type": lambda: {"enr_doc_type": repaired_type(of("enr_doc_type"), corpus)}, "importance": lambda: {"enr_importance": repaired_importance(of("enr_importance"), corpus)}, "key_facts": lambda: {"enr_key_facts": repaired_facts(of("enr_key_facts"), corpus)}}
    out = dict(record)
    for r in rules:
        out |= new[r]()
    return out


def from_context(values: Column, primary: Column, context: Column) -> Column:
    """Items of a comma-list that only the context has."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(values, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & F.contains(F.lower(context), F.lower(x)) & ~F.contains(F.lower(primary), F.lower(x))), ", ")


def mentions_context(text: Column) -> Column:
    return _has(F.lower(text), NEARBY)


def consistent_confidence(confidence: Column, said: Column) -> Column:
    """High confidence beside words of doubt is ambiguous."""
    return F.when((F.lower(confidence) == "high") & _has(F.lower(said), AMBIGUOUS), "ambiguous").otherwise(confidence)


#: Fields that say what of a record comes from its context.
CONTEXT = ("entities_people", "entities_places", "entities_orgs", "entities_dates", "topics", "key_facts", "relationship", "confidence", "source_message_ids", "warning")
#: Fields whose words may give away that a context was used.
MENTIONING = ("summary", "key_facts", "entities_people", "entities_places", "entities_orgs", "entities_dates", "topics", "keywords", "suggested_tags", "suggested_folder")
#: What a repaired record says of its context.
USED = "llm_used_nearby_context"
OMITTED = "LLM used nearby context in non-context fields but omitted structured context fields; provenance inferred from prompt context."
DOUBTFUL = "Nearby context is ambiguous or conflicting; verify before relying on it."


def _values(value: Column) -> Column:
    """Items of a JSON list or of a comma-list."""
    v = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.when(v.startswith("["), F.from_json(v, "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.split(v, ",")), lambda x: F.trim(x)), lambda x: x != "")


def message_ids(text: Column) -> Column:
    """Ids of messages (`message_id=…` or `source_message_id=…`, up to a bracket or blank) in a prompt's context."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:source_message_id|message_id)=([^\]\s]+)"), F.lit(1))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once a row, however often the body names it, also within its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def context_sources(context: Column, values: Column) -> Column:
    """Ids of the context's lines that have one of the values, in order; where none has, all ids."""

    def told(low):
        telling = F.filter(F.split(context, r"\r\n|\n|\r"), lambda x: (F.size(low) == 0) | _once(F.lower(x), lambda line: F.exists(low, lambda v: F.contains(line, v))))
        return F.array_distinct(F.flatten(F.transform(telling, message_ids)))

    return _once(_once(F.transform(values, lambda v: F.lower(v)), told), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array_distinct(message_ids(context))))


def repaired_context(record: dict[str, Column], primary: Column, context: Column) -> dict[str, Column]:
    """A record that used its context but does not say so: what only the context has is named as such, with where it is from and a warning; then confidence and doubt agree.

    Nothing is repaired without a context, or where the record has fields of its own about it and nothing was copied.
    """
    of = lambda k: F.coalesce(record.get(f"enr_{k}", F.lit("")), F.lit(""))
    kinds = ("people", "places", "orgs", "dates")
    read = {f"context_{k}": of(f"context_{k}") for k in CONTEXT} | {f"entities_{k}": of(f"entities_{k}") for k in kinds}
    read |= {"own": F.lower(F.coalesce(primary, F.lit(""))), "near": F.lower(F.coalesce(context, F.lit(""))), "context": F.trim(F.coalesce(context, F.lit("")))}
    read["mentioned"] = _has(F.lower(F.concat_ws(" ", *[of(k) for k in MENTIONING])), NEARBY)

    def copied(x):
        """What only the context has, by kind."""

        def only(k):
            found = F.filter(_values(x[f"entities_{k}"]), lambda v: F.contains(x["near"], F.lower(v)) & ~F.contains(x["own"], F.lower(v)))
            return F.when((x["context"] != "") & (x[f"context_entities_{k}"] == ""), found).otherwise(F.array().cast("array<string>"))

        return _once(F.struct(*[only(k).alias(k) for k in kinds]), lambda c: judged(x, c))

    def judged(x, c):
        said = F.lit(False)
        for k in CONTEXT:
            said = said | (x[f"context_{k}"] != "")
        values = F.concat(*[c[k] for k in kinds])
        repair = (x["context"] != "") & ((F.size(values) > 0) | (x["mentioned"] & ~said))
        return _once(F.struct(values.alias("values"), repair.alias("repair")), lambda r: filled(x, c, r))

    def filled(x, c, r):
        fill = lambda k, v: F.when(r["repair"] & (x[f"context_{k}"] == ""), v).otherwise(x[f"context_{k}"]).alias(k)
        ids = F.array_join(context_sources(x["context"], r["values"]), ", ")
        entities = [F.when(F.size(c[k]) > 0, F.array_join(c[k], ", ")).otherwise(x[f"context_entities_{k}"]).alias(f"entities_{k}") for k in kinds]
        return F.struct(*entities, fill("source_message_ids", ids), fill("relationship", F.lit(USED)), fill("warning", F.lit(OMITTED)), fill("confidence", F.lit("medium")), x["context"].alias("context"))

    def agreed(m):
        doubt = (m["context"] != "") & (F.lower(m["confidence"]) == "high") & _has(F.lower(F.concat_ws(" ", m["relationship"], m["warning"])), AMBIGUOUS)
        kept = [m[k].alias(k) for k in (*(f"entities_{k}" for k in kinds), "source_message_ids", "relationship")]
        return F.struct(*kept, F.when(doubt, "ambiguous").otherwise(m["confidence"]).alias("confidence"), F.when(doubt & (m["warning"] == ""), DOUBTFUL).otherwise(m["warning"]).alias("warning"))

    made = _once(_once(F.struct(*[c.alias(k) for k, c in read.items()]), copied), agreed)
    out = {f"enr_{k}": F.coalesce(c, F.lit("")) for k, c in ((k.removeprefix("enr_"), c) for k, c in record.items())}
    return out | {f"enr_context_{k}": made[k] for k in (*(f"entities_{k}" for k in kinds), "source_message_ids", "relationship", "confidence", "warning")}
