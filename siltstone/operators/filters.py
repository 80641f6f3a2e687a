"""Filters: a small boolean expression language and named filters, compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
_TYPE = re.compile(r"^[A-Za-z0-9_-]+$")
#: Path fields, whose prefixes are matched with their case.
CASED = {"rel_path"}


def field(name: str) -> Column:
    """A metadata field by a checked name."""
    if not isinstance(name, str) or not _NAME.match(name):
        raise ValueError(f"invalid field name: {name!r}")
    return F.col(name)


def _only(x: object, what: str) -> tuple[str, object]:
    if not isinstance(x, Mapping) or len(x) != 1:
        raise ValueError(f"{what} must be an object with exactly one entry")
    return next(iter(x.items()))


def _listed(x: object, what: str) -> list:
    if not isinstance(x, list) or not x:
        raise ValueError(f"{what} takes a non-empty list")
    return x


def _pattern(c: Column, before: str, value: str, after: str, wildcards: bool) -> Column:
    """Contains or prefix; % and _ in the value match anything where wildcards are on."""
    if wildcards:
        return c.like(f"{before}{value}{after}")
    return c.contains(value) if before else c.startswith(value)


def compile_filter(node: Mapping, wildcards: bool = False) -> Column:
    """One of and, or, not, eq, ne, contains, prefix, in; comparisons take one field and ignore case."""
    op, load = _only(node, "filter")
    if op in ("and", "or"):
        parts = [compile_filter(x, wildcards) for x in _listed(load, op)]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~compile_filter(load, wildcards)
    leaves: dict[str, Callable[[Column, str, object], Column]] = {
        "eq": lambda c, k, v: F.lower(c) == str(v).lower(),
        "ne": lambda c, k, v: F.lower(c) != str(v).lower(),
        "in": lambda c, k, v: F.lower(c).isin([str(x).lower() for x in _listed(v, "in")]),
        "contains": lambda c, k, v: _pattern(F.lower(c), "%", str(v).lower(), "%", wildcards),
        "prefix": lambda c, k, v: _pattern(c, "", str(v), "%", wildcards) if k in CASED else _pattern(F.lower(c), "", str(v).lower(), "%", wildcards),
    }
    if op not in leaves:
        raise ValueError(f"unsupported filter operator: {op}")
    key, value = _only(load, op)
    return leaves[op](field(key), key, value)


def any_contains(c: Column, wanted: str) -> Column | None:
    """Whether a comma-list holds one of the comma-separated texts anywhere; substrings count, case does not."""
    items = [x.strip().lower() for x in wanted.split(",") if x.strip()]
    return reduce(lambda a, b: a | b, [F.lower(c).contains(x) for x in items]) if items else None


def named_filters(prefix: str | None = None, filters: Mapping | None = None, metadata: Mapping[str, object] | None = None, **named: str | None) -> Column | None:
    """Conjunction of the filters that are given: path prefix, exact fields, comma-lists, any field, an expression."""
    parts: list[Column | None] = [F.col("rel_path").startswith(prefix) if prefix else None]
    for key in ("source_type", "source_name", "status", "folder"):
        if value := named.pop(key, None):
            parts.append(F.lower(F.col(key)) == value.lower())
    for key in ("tags", "enr_doc_type", "enr_topics"):
        if value := named.pop(key, None):
            parts.append(any_contains(F.col(key), value))
    if named:
        raise ValueError(f"unknown filters: {sorted(named)}")
    parts += [F.lower(field(k)) == str(v).lower() for k, v in (metadata or {}).items()]
    parts.append(compile_filter(filters) if filters is not None else None)
    some = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def where(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def min_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= least) if least > 0 else df


def glob_regex(glob: str) -> str:
    """A regular expression for a path pattern; `**/` stands for any number of folders, none included."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"


def glob_filter(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Paths that match an included pattern and no excluded one."""
    any_of = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs])
    kept = any_of(include) if include else F.lit(True)
    return kept & ~any_of(exclude) if exclude else kept


def checked_source_type(value: str) -> str:
    if not _TYPE.match(value or ""):
        raise ValueError(f"invalid source type: {value!r}")
    return value


def is_sidecar(text: Column) -> Column:
    """JSON objects of at most 2,000,000 bytes with a `media` object and one of the other sidecar keys, whatever its value."""
    v = F.when(F.octet_length(text) <= 2_000_000, F.try_parse_json(text))
    top = F.try_variant_get(v, "$", "map<string,variant>")
    other = F.arrays_overlap(F.map_keys(top), F.array(*[F.lit(k) for k in ("schema_version", "message", "counterparty", "channel")]))
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.media", "variant")).startswith("OBJECT") & other, F.lit(False))


def recent_filter(source_type: str | None = None, folder: str | None = None) -> Column | None:
    """The filter of recent documents, which minds case where the search's filters do not."""
    parts = [F.col(c) == v for c, v in (("source_type", source_type), ("folder", folder)) if v]
    return reduce(lambda a, b: a & b, parts) if parts else None


def is_nonmedia_stub(content: Column) -> Column:
    """Whether what should be a recording or a film is a small JSON object in its place."""
    v = F.when(F.octet_length(content) <= 4096, F.try_parse_json(F.decode(content, "UTF-8")))
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


#: Kinds of issues and words of errors that pass by themselves, and fields that hold a provider's content.
TRANSIENT_KINDS = ["offline", "timeout", "unavailable", "network", "rate_limited", "overloaded"]
CONTENT_FIELDS = ["content", "document", "documents", "items", "records", "result", "text"]
TRANSIENT_WORDS = "timed out|timeout|offline|connection refused|unavailable"


def provider_error(content: Column, ext: Column) -> Column:
    """(reason, transient) of a JSON file that a failed provider has left in place of a document, else null."""
    v = F.when(F.lower(ext) == "json", F.try_parse_json(content))
    text = lambda path: F.try_variant_get(v, path, "string")
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))
    error = F.coalesce(text("$.error"), F.lit(""))
    failed = is_text("$.server") & is_text("$.tool") & ~error.isin("", "false", "0", "{}", "[]", "null")
    tool = F.lower(text("$.tool"))
    reason = F.when(tool.contains("vision") | tool.startswith("vl_"), "vision_sidecar_failed").when(tool.contains("ocr"), "ocr_sidecar_failed").otherwise("provider_sidecar_failed")
    said = F.lower(F.concat_ws(" ", error, text("$.issue.rawMessage")))
    transient = F.lower(F.trim(F.coalesce(text("$.issue.kind"), F.lit("")))).isin(TRANSIENT_KINDS) | said.rlike(TRANSIENT_WORDS)
    held = F.exists(F.array(*[text(f"$.{k}") for k in CONTENT_FIELDS]), lambda x: ~F.trim(F.coalesce(x, F.lit(""))).isin("", "[]", "{}"))
    return F.when(failed & ~held, F.struct(reason.alias("reason"), transient.alias("transient")))
