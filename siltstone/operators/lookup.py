"""Evidence-gated lookups: whether a result answers a question, or is only the nearest thing there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.functions.text import clip, key_facts, phone_keys, query_tokens

#: Words that ask for a call, words that are no evidence, thresholds of shared words.
CALL_WORDS = ["call", "called", "calling", "calls", "callback", "phone", "voicemail", "vm", "missed", "ring", "rang", "dial", "dialed", "message", "messages", "text", "texted", "sms", "hangup"]
COMMON_WORDS = ["the", "and", "for", "with", "from", "about", "into", "that", "this", "have", "has", "was", "were", "are", "our", "their", "his", "her", "who", "what", "when", "where", "why", "how", "any", "all", "did", "does"]
LEAST_SHARE, LEAST_WORDS, STRONG_SHARE = 0.34, 2, 0.6


def question(query: str) -> dict:
    """Telling words, whether a call is asked for, and phone numbers of a query."""
    words = [w for w in query_tokens(query, distinct=False) if w.isascii()]
    digits, runs, run = [], [], ""
    for c in f"{query}\n":
        if c.isdigit() or c in "+ ().-" and run:
            run += c
        else:
            runs.append(run)
            run = c if c == "+" else ""
    for r in runs:
        d = "".join(c for c in r if c.isdigit())
        if len(d) >= 7:
            digits.append(d[-10:])
    return {"words": sorted({w for w in words if len(w) >= 3 and not w.isdigit() and w not in COMMON_WORDS}), "call": any(w in CALL_WORDS for w in words), "phones": sorted(set(digits))}


def evidence(df: DataFrame, query: str, blob: Column) -> DataFrame:
    """Adds matched, overlap, phone_match, call_match and is_real for a lower-cased blob of each result."""
    q = question(query)
    text = F.lower(F.coalesce(blob, F.lit("")))
    starts = [F.when(text.rlike(rf"\b{w}"), 1).otherwise(0) for w in q["words"]]
    matched = sum(starts, F.lit(0))
    digits = F.regexp_replace(text, r"\D", "")
    phone = F.lit(False)
    for p in q["phones"]:
        phone = phone | digits.contains(p)
    call = F.arrays_overlap(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*[F.lit(w) for w in CALL_WORDS])) if q["call"] else F.lit(False)
    out = df.withColumns({"matched": matched, "phone_match": phone, "call_match": call})
    out = out.withColumn("overlap", F.col("matched") / F.lit(float(len(q["words"]))) if q["words"] else F.lit(0.0))
    return out.withColumn("is_real", F.col("phone_match") | (F.col("overlap") >= LEAST_SHARE) | (F.col("matched") >= LEAST_WORDS))


def by_evidence(df: DataFrame, key: str = "id") -> DataFrame:
    """Real matches, the hardest evidence first."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("phone_match"), F.desc("call_match"), F.desc("overlap"), F.desc("score"), key)
    return df.where("is_real").withColumn("pos", F.row_number().over(w))


def verdict(df: DataFrame, query: str, key: str = "id") -> DataFrame:
    """One row: verdict (found, ambiguous, not_found), top (key), n_real and sql_needed, from results with evidence."""
    q = question(query)
    top = by_evidence(df, key).agg(F.min_by(F.struct(key, "phone_match", "call_match", "overlap"), "pos").alias("t"), F.count(F.lit(1)).alias("n_real"))
    hard = F.col("t.phone_match") | F.col("t.call_match")
    name_only = F.lit(q["call"]) & ~hard
    state = F.when(F.col("n_real") == 0, "not_found").when(name_only, "ambiguous").when(hard | (F.col("t.overlap") >= STRONG_SHARE), "found").otherwise("ambiguous")
    return top.select(state.alias("verdict"), F.col(f"t.{key}").alias("top"), "n_real", (F.col("n_real") == 0).__or__(name_only).alias("sql_needed"))


def shown(df: DataFrame) -> DataFrame:
    """Results with their facts and snippet in the lengths that are shown."""
    out = df.withColumn("snippet", clip(F.col("text"), 400))
    return out.withColumn("facts", key_facts(F.col("enr_key_facts"))) if "enr_key_facts" in df.columns else out


def phones(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("phone_keys", phone_keys(F.col(text)))


def trim_to_budget(answer: dict, target: int = 2800) -> dict:
    """An answer cut step by step until its indented JSON is within the target: hits, facts, snippet, ids, note."""
    import json

    size = lambda: len(json.dumps(answer, indent=2, ensure_ascii=False, default=str))
    while size() > target and len(answer.get("hits") or []) > 1:
        answer["hits"].pop()
    while size() > target and answer.get("key_facts"):
        answer["key_facts"].pop()
    for field, width in (("snippet", 160), ("note", 160), ("snippet", 0), ("source_ids", 1), ("hits", 0)):
        if size() > target and answer.get(field):
            answer[field] = answer[field][:width]
    return answer
