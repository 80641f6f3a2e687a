"""Column builders for text, paths, dates and lists. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical source types by file extension; other extensions stand for themselves, none for `other`.
SOURCE_TYPES = {
    "md": "md", "pdf": "pdf", "docx": "doc", "doc": "doc", "rtf": "doc", "xlsx": "sheet", "xls": "sheet", "pptx": "pres",
    "csv": "csv", "html": "html", "htm": "html", "epub": "epub", "txt": "txt",
    "png": "img", "jpg": "img", "jpeg": "img", "gif": "img", "webp": "img",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "flac": "audio", "ogg": "audio", "aac": "audio", "aiff": "audio",
    "mp4": "video", "mov": "video", "mkv": "video", "webm": "video", "avi": "video", "m4v": "video",
}
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str, distinct: bool = True) -> list[str]:
    """The tokens of a query, as tokens() makes them of texts."""
    found = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return list(dict.fromkeys(found)) if distinct else found


def source_type(ext: Column) -> Column:
    """Canonical type of a file extension, with or without its dot."""
    e = F.lower(F.ltrim(F.coalesce(ext, F.lit("")), F.lit(".")))
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return F.when(e == "", "other").otherwise(F.coalesce(F.try_element_at(known, e), e))


def front_matter(content: Column) -> tuple[Column, Column]:
    """The block between two lines of dashes at the start, and what follows; no block leaves everything as body."""
    whole = r"(?s)^---\s*\n(.*?)\n---\s*\n?"
    has = content.rlike(whole)
    return F.when(has, F.regexp_extract(content, whole, 1)).otherwise(""), F.when(has, F.regexp_replace(content, whole, "")).otherwise(content)


def front_matter_map(block: Column) -> Column:
    """Scalar `key: value` lines and `[a, b]` lists of a front-matter block as a map of strings."""
    line = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*)\s*:\s*(.*?)\s*$", 1)
    value = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z_][\w-]*\s*:\s*(.*?)\s*$", 1), r"^[\[\"']|[\]\"']$", "")
    rows = F.filter(F.split(block, "\n"), lambda x: line(x) != "")
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(rows, line)), lambda k: F.struct(k.alias("k"), value(F.element_at(F.filter(rows, lambda x: line(x) == k), -1)).alias("v"))))


def title(text: Column, path: Column) -> Column:
    """The first level-1 heading, else the file name without its extension."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(heading != "", heading).otherwise(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def folder(path: Column) -> Column:
    """The first segment of a path that has more than one."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def parent(path: Column) -> Column:
    """The folder that holds a file; a dot for none."""
    p = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(p == "", ".").otherwise(p)


def split_list(value: Column) -> Column:
    """Items of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def normalize_tags(value: Column) -> Column:
    """A comma-separated text with trimmed, non-empty items."""
    return F.array_join(split_list(value), ",")


def json_list(value: Column) -> Column:
    """Items of a JSON array of texts; any other text is its only item."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v)))


def key_facts(value: Column, most: int = 5, width: int = 160) -> Column:
    """At most `most` facts of at most `width` characters, from a JSON array or from lines and semicolons."""
    v = F.trim(F.coalesce(value, F.lit("")))
    parts = F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.split(v, r"[\n;]+"))
    return F.slice(F.filter(F.transform(parts, lambda x: clip(x, width)), lambda x: x != ""), 1, most)


def clip(value: Column, width: int) -> Column:
    """White space as single blanks, cut to width."""
    v = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.length(v) > width, F.concat(F.rtrim(F.substring(v, 1, width - 1)), F.lit("…"))).otherwise(v)


def snippet(text: Column, width: int = 200) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def chunk_header(title: Column, topics: Column, page: Column, section: Column, summary: Column) -> Column:
    """`[Document: … | Topics: … | Page: … | Section: …]` and a summary line; nothing where nothing is known."""
    known = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    parts = F.concat_ws(" | ", known("Document", title), known("Topics", topics), F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))), known("Section", section))
    more = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\nSummary: "), summary)).otherwise("")
    return F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]"), more, F.lit("\n\n")))


def with_caption(text: Column, caption: Column) -> Column:
    """An attachment's text below the message it came with."""
    c = F.trim(F.coalesce(caption, F.lit("")))
    lead = F.concat(F.lit("Communication message/caption: "), c)
    return F.when(c == "", text).when(F.trim(text) == "", lead).otherwise(F.concat(lead, F.lit("\n\nAttachment content:\n"), text))


def with_context(text: Column, context: Column, marker: str = "\n\n[Context]\n") -> Column:
    """Text with a context block after the marker; a block that is there already is replaced."""
    body = F.rtrim(F.split_part(text, F.lit(marker), F.lit(1)))
    return F.when(F.coalesce(context, F.lit("")) == "", body).otherwise(F.concat(body, F.lit(marker), context))


def source_name(doc_id: Column) -> Column:
    """What stands before `::` in a global id; `documents` where nothing does."""
    return F.when(F.instr(doc_id, "::") > 0, F.split_part(doc_id, F.lit("::"), F.lit(1))).otherwise("documents")


def natural_key(ref: Column) -> Column:
    """What stands after `::` in a reference, or all of it."""
    return F.when(F.instr(ref, "::") > 0, F.regexp_replace(ref, r"^.*?::", "")).otherwise(ref)


#: Digits of base 62 in their order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: Column, width: int = 5) -> Column:
    """A number in base 62 with leading zeros."""
    digit = lambda k: F.substring(F.lit(BASE62), (F.floor(n / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in reversed(range(width))])


def from_base62(text: Column) -> Column:
    """The number that base62 gives as text."""
    return F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a * 62 + F.instr(F.lit(BASE62), x) - 1)


def id_in_name(path: Column) -> Column:
    """The five-character id between two @ signs in a file name, or empty."""
    return F.regexp_extract(path, r"@([0-9A-Za-z]{5})@[^/]*$", 1)


def name_without_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\s*@[0-9A-Za-z]{5}@(?=[^/]*$)", "")


def name_with_id(path: Column, doc_id: Column) -> Column:
    """The id put before the extension of the file name, in place of one that is there."""
    bare = name_without_id(path)
    stem, ext = F.regexp_replace(bare, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(bare, r"(?<=[^/])(\.[^./]*)$", 1)
    return F.concat(stem, F.lit("@"), doc_id, F.lit("@"), ext)


def timestamp_utc(value: Column) -> Column:
    """ISO text as a timestamp, to the second; text without an offset is UTC."""
    return F.date_trunc("second", F.try_to_timestamp(value))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def batch_key(source: Column, channel: Column, ts: Column) -> Column:
    return F.concat_ws(":", source, channel, iso_utc(F.date_trunc("second", ts)))


def change_hash(text: Column, salt: str = "") -> Column:
    """A digest of a text under a salt; only equality counts."""
    return F.sha2(F.concat(F.lit(salt + "\0"), F.coalesce(text, F.lit(""))), 256)


def identity(content: Column) -> Column:
    """Size and digest of a text or file: equal for exact copies."""
    return F.struct(F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content.cast("binary"), 256).alias("content_hash"))


def retry_delay(tries: Column) -> Column:
    """Seconds until a degraded document is tried again: doubled each time, six hours at most."""
    return F.least(F.lit(300.0) * F.pow(F.lit(2.0), tries.cast("double")), F.lit(21600.0))


def skip_due(skipped_at: Column, doc_id: Column) -> Column:
    """When a skipped document is due: a day later, spread over another day by its id."""
    return skipped_at + F.lit(86400) + F.pmod(F.xxhash64(doc_id), F.lit(86400))


def change_key(digest: Column, mtime: Column) -> Column:
    return F.coalesce(F.nullif(digest, F.lit("")), F.concat(F.lit("mtime:"), mtime.cast("string")))


#: File names that some systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]


def archive_name(key: Column, most: int = 180) -> Column:
    """A file name for a key: URL-quoted, a digest in place of what is beyond the width, reserved names with a prefix."""
    quoted = F.regexp_replace(F.url_encode(key), r"\+", "%20")
    name = F.when(F.length(quoted) <= most, quoted).otherwise(F.concat(F.substring(quoted, 1, most - 17), F.lit("-"), F.substring(F.sha2(key, 256), 1, 16)))
    return F.when(F.upper(F.regexp_replace(name, r"[ .]+$", "")).isin(RESERVED), F.concat(F.lit("seg__"), name)).otherwise(name)


def sentences(text: Column) -> Column:
    """A text cut after the ends of its sentences and paragraphs; joined they are the text again."""
    return F.filter(F.split(text, r"(?<=[.!?][\s\u00A0])(?=\S)|(?<=\n\n)"), lambda x: x != "")


def date_like(segment: Column) -> Column:
    """Whether a path segment is a year, a month or a date."""
    months = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec"
    return segment.rlike(r"^(?:\d{4}|\d{1,2}|\d{4}[-_.]\d{1,2}(?:[-_.]\d{1,2})?|q[1-4])$") | F.lower(segment).isin(months.split())


def folder_depth_kept(path: Column) -> Column:
    """Folders of depth 1 and 2 stay, and of depth 3 unless the last segment is like a date."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return (F.size(parts) <= 2) & (F.size(parts) > 0) | (F.size(parts) == 3) & ~date_like(F.try_element_at(parts, F.lit(3)))


def html_text(html: Column) -> Column:
    """Readable text of a page: without scripts, styles, comments and tags, common entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def phone_keys(text: Column) -> Column:
    """The last ten digits of every phone-like run of seven digits or more."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\+?\d[\d\s().\-]{5,}\d"), F.lit(0))
    digits = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, r"\D", "")), lambda d: F.length(d) >= 7)
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: F.right(d, F.lit(10)))))


def log_level(line: Column) -> tuple[Column, Column, Column]:
    """Timestamp, HTTP status and provider kind of a log line; null where a line has none."""
    none = lambda c: F.nullif(c, F.lit(""))
    ts = none(F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1))
    status = none(F.regexp_extract(line, r"(?i)(?:status(?:_code)?[=: ]+|HTTP/\d(?:\.\d)?\"? )(\d{3})", 1)).cast("int")
    kind = none(F.lower(F.regexp_extract(line, r"(?i)\b(embed|rerank|ocr|llm|media)\w*\b", 1)))
    return ts, status, kind
