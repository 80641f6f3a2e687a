"""Upkeep of an index: coverage, health, sidecars, context chunks, audits and the lists that maintenance works from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.functions.text import folder, source_type

#: States of a source by how bad they are, prefixes of lines that only describe a medium.
RANKS = {"ok": 0, "unknown": 1, "missing": 2, "indexing": 2, "degraded": 3, "critical": 4}
CONTEXT_MARKER = "[Conversation context]"
CAPTION = "Communication message/caption:"


# ---- counts -------------------------------------------------------------------------------------------------------


def taxonomy_counts(taxonomy: DataFrame) -> DataFrame:
    """(kind, n): entries by kind, and all of them under a null kind."""
    return taxonomy.rollup("kind").agg(F.count(F.lit(1)).alias("n"))


def audit_count(log: DataFrame, action: str | None = None, doc_id: str | None = None) -> DataFrame:
    for c, v in (("action", action), ("doc_id", doc_id)):
        log = log if v is None else log.where(F.col(c) == v)
    return log.agg(F.count(F.lit(1)).alias("n"))


def source_names(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("source_name", F.lit("")) != "").select("source_name").distinct()


def labeling_status(cases: DataFrame, labelled: Column, key: str = "case_id") -> DataFrame:
    """One row: total_cases, labeled, remaining and the first case without a label."""
    done = F.coalesce(labelled, F.lit(False))
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(done).alias("labeled"), F.count_if(~done).alias("remaining"), F.min(F.when(~done, F.col(key))).alias("next_case_id"))


def sweep_ledger(claims: DataFrame, cleared: Column) -> DataFrame:
    """One row of a scan's contested ids: those cleared off their file names and those that remain add up to all."""
    return claims.agg(F.count(F.lit(1)).alias("contested"), F.count_if(cleared).alias("retokenized"), F.count_if(~F.coalesce(cleared, F.lit(False))).alias("remaining"))


def warning_samples(df: DataFrame, warning: str = "warning", most: int = 20) -> DataFrame:
    """(kind, n, samples): warnings by what stands before the first colon, with the first `most` of each in the order of their text."""
    kind = F.split_part(F.col(warning), F.lit(":"), F.lit(1))
    counted = df.groupBy(kind.alias("kind"), F.col(warning).alias("w")).agg(F.count(F.lit(1)).alias("m"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("w")))
    return ranked.groupBy("kind").agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("w")))).alias("samples"))


def cost_summary(results: DataFrame, prices: DataFrame, by: str = "model") -> DataFrame:
    """By model: cases, tokens in and out, and what they cost at prices a million tokens (model, price_in, price_out)."""
    sums = results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return sums.join(prices, by, "left").select(by, "n", "tokens_in", "tokens_out", F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))


# ---- health -------------------------------------------------------------------------------------------------------


def source_health(sources: DataFrame, running: bool = False) -> DataFrame:
    """(source_name, state, reason) of sources with configured, registered, indexed, not_extractable and last_run."""
    reg, idx, not_ex = F.coalesce("registered", F.lit(0)), F.coalesce("indexed", F.lit(0)), F.greatest(F.coalesce("not_extractable", F.lit(0)), F.lit(0))
    missing = F.greatest(reg - idx - not_ex, F.lit(0))
    pair = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    busy = lambda s: "indexing" if running else s
    state = (
        F.when((reg > 0) & (missing == 0) & (idx > 0) & (not_ex > 0), pair("ok", "indexed_or_not_extractable")).when((reg > 0) & (missing == 0) & (not_ex > 0), pair("ok", "not_extractable"))
        .when((reg > 0) & (missing == 0), pair("ok", "indexed")).when((reg > 0) & (idx == 0), pair(busy("critical"), "registry_has_docs_but_index_has_none")).when(reg > 0, pair(busy("degraded"), "index_missing_some_registry_docs"))
        .when(idx > 0, pair("ok", "indexed")).when(F.col("configured") & F.lit(running), pair("indexing", "configured_source_not_seen_yet")).when(F.col("configured") & F.col("last_run").isNotNull(), pair("missing", "configured_source_has_no_indexed_docs"))
        .when(F.col("configured"), pair("unknown", "configured_source_not_indexed_yet")).otherwise(pair("ok", "observed_source"))
    )
    return sources.withColumn("_s", state).select("source_name", "_s.state", "_s.reason")


def overall_health(states: DataFrame, keywords: bool = True, running: bool = False, registry_error: bool = False, providers: str = "ok") -> DataFrame:
    """One row (state): the worst of the sources, the providers and the keyword index."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    floor = max(RANKS.get(providers, 1), 0 if keywords else RANKS["indexing" if running else "degraded"])
    worst = F.greatest(F.coalesce(F.max(F.coalesce(F.try_element_at(rank, F.col("state")), F.lit(1))), F.lit(0)), F.lit(floor))
    state = F.when(F.lit(registry_error), "degraded").when(worst >= 4, "critical").when(worst >= 3, "degraded").when(worst >= 2, "indexing" if running else "degraded").when(worst >= 1, "unknown").otherwise("ok")
    return states.agg(state.alias("state"))


def registry_overview(registry: DataFrame, by_bare: bool = True) -> DataFrame:
    """By source: rows, distinct documents (an id with and without its source is one), aliases (the surplus), duplicates, latest sight."""
    bare = F.regexp_replace("doc_id", r"^.*?::", "") if by_bare else F.col("doc_id")
    per = registry.groupBy("source_name", bare.alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("dedupe_status") == "duplicate").cast("int")).alias("dup"), F.max("last_seen").alias("seen"))
    return per.groupBy("source_name").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n") - 1).alias("aliases"), F.sum("dup").alias("n_duplicates"), F.max("seen").alias("latest_seen"))


# ---- context and sidecars ----------------------------------------------------------------------------------------


def sidecar_context(sidecars: DataFrame, minutes: float = 15.0, payload: str = "payload", time: str = "sent_at") -> DataFrame:
    """Adds before and after (arrays of message_id, sender, sent_at and text) from the context that a sidecar has stored.

    Messages outside the time window around the sidecar's own time are left out; those whose time cannot be read stay. What is
    no JSON object gives empty lists.
    """
    v = F.try_parse_json(payload)
    message = "struct<message_id:string,sender:string,sent_at:string,text:string>"
    own = F.try_to_timestamp(F.col(time)).cast("double")
    near = lambda x: F.coalesce(F.abs(F.try_to_timestamp(x["sent_at"]).cast("double") - own) <= minutes * 60, F.lit(True))
    listed = lambda path: F.coalesce(F.try_variant_get(v, path, f"array<{message}>"), F.array().cast(f"array<{message}>"))
    one = lambda path: F.filter(F.array(F.try_variant_get(v, path, message)), lambda x: x.isNotNull() & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    lead = F.filter(F.concat(F.filter(one("$.context.nearest_nonempty_before"), lambda x: ~F.array_contains(listed("$.context.same_channel_before"), x)), listed("$.context.same_channel_before")), near)
    tail = F.filter(F.concat(listed("$.context.same_channel_after"), F.filter(one("$.context.nearest_nonempty_after"), lambda x: ~F.array_contains(listed("$.context.same_channel_after"), x))), near)
    return sidecars.withColumns({"before": lead, "after": tail})


def repaired_sidecar(payload: Column, context: Column) -> Column:
    """A sidecar's JSON with its context replaced; a context that was no object is kept as legacy_context. Null where the JSON is no object."""
    m = F.from_json(payload, "map<string,string>")
    had = F.trim(F.coalesce(F.try_element_at(m, F.lit("context")), F.lit("")))
    keep = F.when((had != "") & ~had.startswith("{"), F.map_concat(F.from_json(context, "map<string,string>"), F.create_map(F.lit("legacy_context"), had))).otherwise(F.from_json(context, "map<string,string>"))
    merged = F.map_concat(F.map_filter(m, lambda k, v: k != "context"), F.create_map(F.lit("context"), F.to_json(keep)))
    return F.when(m.isNotNull(), F.to_json(merged))


def contextualized(text: Column, context: Column, marker: str = CONTEXT_MARKER) -> Column:
    """A text with its conversation behind the marker, in place of one that is there; no context takes it off."""
    body = F.rtrim(F.regexp_replace(F.split_part(F.coalesce(text, F.lit("")), F.lit(marker), F.lit(1)), r"\s+$", ""))
    said = F.regexp_replace(F.coalesce(context, F.lit("")), r"^\s+|\s+$", "")
    return F.when(said == "", body).otherwise(F.concat(body, F.lit(f"\n\n{marker}\n"), said))


def context_refresh(chunks: DataFrame, contexts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, loc, current_text, desired_text): the chunk of each document that carries its context, where it has to change.

    It is the last chunk with the marker, or else the last one; the places of chunks are in the order of their numbers.
    """
    order = F.struct(F.col("text").contains(CONTEXT_MARKER), F.coalesce(F.regexp_extract("loc", r"(\d+)$", 1).try_cast("long"), F.lit(0).cast("long")), F.col("loc"))
    anchor = chunks.groupBy(key).agg(F.max_by(F.struct("loc", "text"), order).alias("a"))
    plan = anchor.join(contexts, key).select(key, "a.loc", F.col("a.text").alias("current_text"), contextualized(F.col("a.text"), F.col("context")).alias("desired_text"))
    return plan.where("current_text <> desired_text")


def duplicate_delivery_chunks(duplicates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks that stand for duplicates of a medium: no content, only the conversation that each was delivered in.

    duplicates: doc_id, canonical_doc_id, rel_path, ext, context; those without a context give none.
    """
    kind = source_type(F.col("ext"))
    said = F.regexp_replace(F.coalesce("context", F.lit("")), r"^\s+|\s+$", "")
    body = F.concat(F.initcap(kind), F.lit(" attachment delivery. Canonical media attachment: "), F.col("canonical_doc_id").cast("string"), F.lit(f"\n\n{CONTEXT_MARKER}\n"), said)
    uid = F.concat(F.col(key).cast("string"), F.lit("::context:c:0"))
    return duplicates.where(said != "").select(
        key, F.lit("context:c:0").alias("loc"), uid.alias("chunk_uid"), body.alias("text"), kind.alias("source_type"), folder(F.col("rel_path")).alias("folder"),
        F.concat(F.lit("Context-only alias for "), F.col("canonical_doc_id").cast("string")).alias("description"), F.substring(said, 1, 200).alias("snippet"))


# ---- lists that maintenance works from ---------------------------------------------------------------------------


def is_stub_text(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether a chunk says nothing but metadata: after its context line and summary, every line has one of the prefixes or is a caption."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\r?\n")
    first = F.when(F.get(lines, 0).startswith("["), 1).otherwise(0)
    summary = F.coalesce(F.get(lines, first).startswith("Summary:"), F.lit(False))
    blank = F.get(F.filter(F.transform(lines, lambda x, i: F.when((F.trim(x) == "") & (i > first), i)), lambda i: i.isNotNull()), 0)
    start = F.when(summary, F.coalesce(blank, F.size(lines))).otherwise(first)
    body = F.filter(F.transform(F.slice(lines, start + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x)), lambda x: x != "")
    known = lambda x: F.exists(F.array(*[F.lit(p) for p in [*prefixes, CAPTION]]), lambda p: F.startswith(x, p))
    return F.forall(body, known)


def missing_files(registry: DataFrame, chunks: DataFrame, files: DataFrame, ext: str = "pdf", source: str = "documents", least: int = 10) -> DataFrame:
    """(doc_id, path, size): canonical rows of a source whose file is there and large enough but not indexed, the first of each bare id.

    An id with and without its source is the same document; if any of its rows is a duplicate, it is not missing.
    """
    bare = F.regexp_replace("doc_id", r"^.*?::", "")
    own = registry.where(F.col("source_name") == source).withColumn("bare", bare)
    copies = own.where("dedupe_status = 'duplicate'").select("bare").distinct()
    indexed = chunks.select(F.regexp_replace("doc_id", r"^.*?::", "").alias("bare")).distinct()
    wanted = own.where((F.coalesce("dedupe_status", F.lit("canonical")) == "canonical") & F.lower("path").endswith(f".{ext}"))
    first = wanted.groupBy("bare").agg(F.min(F.struct("doc_id", "path")).alias("r")).select("bare", "r.*")
    there = first.join(indexed, "bare", "left_anti").join(copies, "bare", "left_anti").join(files.select("path", "size"), "path")
    return there.where(F.col("size") >= least).select("doc_id", "path", "size")


def path_audit(artifacts: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, problem) of a run's artifacts (doc_id, path): not_registered, other_path, not_indexed, or shared_path where two documents have one."""
    reg = registry.select("doc_id", F.col("path").alias("known")).dropDuplicates(["doc_id"])
    held = chunks.select("doc_id").distinct().withColumn("indexed", F.lit(True))
    shared = artifacts.groupBy("path").agg(F.count_distinct("doc_id").alias("owners"))
    x = artifacts.join(reg, "doc_id", "left").join(held, "doc_id", "left").join(shared, "path", "left")
    rules = {"not_registered": F.col("known").isNull(), "other_path": F.col("known") != F.col("path"), "not_indexed": F.col("indexed").isNull(), "shared_path": F.col("owners") > 1}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return x.select("doc_id", F.explode(found).alias("problem")).distinct()


def stage_counts(stages: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(stage, n, best, n_new): what each stage of a search has given, and how many rows no stage before it had."""
    out, before = None, None
    for name, df in stages.items():
        fresh = df if before is None else df.join(before, key, "left_anti")
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("n_new")))
        out = one if out is None else out.unionByName(one)
        before = df.select(key) if before is None else before.union(df.select(key)).distinct()
    return out


# ---- ledgers and queues -------------------------------------------------------------------------------------------


def completed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the requests that were worked on at their present revision; one that was asked for again meanwhile stays."""
    return queue.join(done.select("table_name", "source", "target", "revision"), ["table_name", "source", "target", "revision"], "left_anti")


def failed(queue: DataFrame, errors: DataFrame) -> DataFrame:
    """The queue with an attempt more and the error for requests that failed at their present revision."""
    e = errors.select("table_name", "source", "target", "revision", F.col("error").alias("_e"), F.lit(1).alias("_n"))
    x = queue.join(e, ["table_name", "source", "target", "revision"], "left")
    return x.select(*[(F.col(c) + F.coalesce("_n", F.lit(0))).alias(c) if c == "attempts" else F.coalesce("_e", c).alias(c) if c == "last_error" else F.col(c) for c in queue.columns])


def renewed_leases(ledger: DataFrame, handed_out: DataFrame, now: float, key: str = "doc_id") -> DataFrame:
    """The skip ledger with the time of entries that are handed out set to now, so that a second run does not take them as well."""
    x = ledger.join(handed_out.select(key).distinct().withColumn("_h", F.lit(True)), key, "left")
    return x.select(*[F.when(F.col("_h"), F.lit(now)).otherwise(F.col(c)).alias(c) if c == "skipped_at" else F.col(c) for c in ledger.columns])


def settled(ledger: DataFrame, outcomes: DataFrame, attempts: int = 12, runs: int = 3, key: str = "doc_id") -> DataFrame:
    """The degraded ledger after a run: (key, attempts, unresolved_runs, terminal); outcomes: key, ok, resolved.

    A success leaves; a failure counts as an attempt, and as an unresolved run where nothing was gained. At the cap of either an entry is terminal.
    """
    o = outcomes.groupBy(key).agg(F.bool_or("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fails"), F.bool_or("resolved").alias("resolved"))
    x = ledger.join(o, key, "left").where(~F.coalesce("ok", F.lit(False)))
    tries = F.least(F.col("attempts") + F.coalesce("fails", F.lit(0)), F.lit(attempts))
    idle = F.when(F.col("fails").isNull(), F.col("unresolved_runs")).when(F.col("resolved"), 0).otherwise(F.col("unresolved_runs") + 1)
    return x.select(key, tries.cast("long").alias("attempts"), idle.cast("long").alias("unresolved_runs"), ((tries >= attempts) | (idle >= runs)).alias("terminal"))
