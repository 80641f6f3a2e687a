"""File sources: scans, extraction by type, chunking, all in the canonical record schema.

Records: doc_id, source_type, natural_key, mtime (epoch seconds), size, metadata (map), change_hash.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions import text as T
from siltstone.operators.filters import glob_filter
from siltstone.sources import extract

RECORD = "doc_id string, source_type string, natural_key string, mtime double, size bigint, metadata map<string,string>, change_hash string"


def scan(spark: SparkSession, root: str, include: Sequence[str] = ("**/*",), exclude: Sequence[str] = (), contents: bool = False) -> DataFrame:
    """Files below a folder in any store Spark reads; contents are read only where they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    last = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.substr("path", F.instr("path", f"/{last}/") + F.lit(len(last) + 2))
    out = files.select(rel.alias("rel_path"), F.col("path").alias("abs_path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"), *(["content"] if contents else []))
    return out.where(glob_filter(F.col("rel_path"), list(include), list(exclude))).withColumn("ext", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))


def records(files: DataFrame, source: str = "documents") -> DataFrame:
    """Scanned files as records; the id in a file name, or else the path, names a document."""
    own = F.coalesce(F.nullif(T.id_in_name(F.col("rel_path")), F.lit("")), F.col("rel_path"))
    digest = F.sha2("content", 256) if "content" in files.columns else F.lit("")
    doc_id = own if source == "documents" else F.concat(F.lit(f"{source}::"), own)
    meta = F.create_map(F.lit("rel_path"), F.col("rel_path"), F.lit("folder"), T.folder(F.col("rel_path")))
    return files.select(doc_id.alias("doc_id"), T.source_type(F.col("ext")).alias("source_type"), F.col("rel_path").alias("natural_key"), "mtime", "size", meta.alias("metadata"), digest.alias("change_hash"))


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Records of several sources, their ids prefixed with the source's name (none for `documents`)."""
    out = None
    for name, df in sources.items():
        one = df if name == "documents" else df.withColumn("doc_id", F.when(F.instr("doc_id", "::") > 0, F.col("doc_id")).otherwise(F.concat(F.lit(f"{name}::"), "doc_id")))
        one = one.withColumn("source_name", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def extract_text(files: DataFrame, plug_ins: Mapping[str, Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
    """Adds text and frontmatter to scanned files with contents.

    Markdown, plain text and HTML are read by expressions; Office, EPUB, RTF, CSV and Excel files by readers of their own, in Arrow batches;
    other types by a plug-in (bytes to text) for their type, without which they have no text. A plug-in goes before what is built in.
    """
    raw = F.decode("content", "UTF-8")
    kind, ext = T.source_type(F.col("ext")), F.lower(F.ltrim(F.coalesce(F.col("ext"), F.lit("")), F.lit(".")))
    block, body = T.front_matter(raw)
    parsed = extract.read_columns(F.when(ext.isin(sorted(extract.READERS)), F.col("content")), ext)
    text = F.when(kind == "md", body).when(kind == "html", T.html_text(raw)).when(ext.isin(sorted(extract.READERS)), parsed).when(kind.isin("txt", "json"), raw)
    for name, f in (plug_ins or {}).items():
        text = F.when(kind == name, F.pandas_udf(f, "string")(F.col("content"))).otherwise(text)
    return files.withColumn("frontmatter", F.when(kind == "md", T.front_matter_map(block))).withColumn("text", F.coalesce(text, F.lit("")))


def headings(text: Column) -> Column:
    """Sections at headings of level 1 to 3, as (breadcrumb, body): `Setup > Steps`; what comes first has none.

    Each line that is a heading replaces the deeper part of the trail; the fold goes over headings, not over characters.
    """
    parts = F.filter(F.split(text, r"(?m)^(?=#{1,3}\s+\S)"), lambda x: F.trim(x) != "")
    head = lambda x: F.regexp_extract(x, r"^(#{1,3})\s+([^\n]*)", 1)
    name = lambda x: F.trim(F.regexp_extract(x, r"^(#{1,3})\s+([^\n]*)", 2))
    empty = F.struct(F.array().cast("array<struct<k:int,n:string>>").alias("trail"), F.array().cast("array<struct<breadcrumb:string,body:string>>").alias("out"))

    def add(acc, x):
        level = F.length(head(x))
        above = F.filter(acc["trail"], lambda t: t["k"] < level)
        trail = F.when(level > 0, F.concat(above, F.array(F.struct(level.alias("k"), name(x).alias("n"))))).otherwise(acc["trail"])
        crumb = F.when(level > 0, F.array_join(F.transform(trail, lambda t: t["n"]), " > ")).otherwise("")
        return F.struct(trail.alias("trail"), F.concat(acc["out"], F.array(F.struct(crumb.alias("breadcrumb"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("body")))).alias("out"))

    return F.aggregate(parts, empty, add, lambda acc: acc["out"])


def pieces(body: Column, size: int, overlap: int) -> Column:
    """A text as pieces of a size that overlap."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(body) - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.substring(body, p * step + 1, F.lit(size)))


def sentence_pieces(body: Column, size: int) -> Column:
    """A text as runs of whole sentences of at most a size; a longer sentence is cut."""
    each = F.flatten(F.transform(T.sentences(body), lambda x: F.when(F.length(x) <= size, F.array(x)).otherwise(pieces(x, size, 0))))
    empty = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def add(acc, x):
        fits = F.length(acc["now"]) + F.length(x) <= size
        return F.struct(F.when(fits, F.concat(acc["now"], x)).otherwise(x).alias("now"), F.when(fits | (acc["now"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))).alias("out"))

    return F.aggregate(each, empty, add, lambda acc: F.concat(acc["out"], F.array(acc["now"])))


def topics(body: Column, embed: Callable[[Column], Column], percentile: float = 95.0) -> Column:
    """A text cut between sentences that are unlike: where the distance of adjacent sentences is above the percentile of all in the text.

    embed makes an array of vectors from an array of sentences.
    """
    from siltstone.operators.search import cosine

    def cut(s):
        said, v = s["s"], s["v"]
        far = F.transform(F.sequence(F.lit(1), F.size(said) - 1), lambda i: 1 - cosine(F.get(v, i - 1), F.get(v, i)))
        ranked = F.array_sort(far)
        at = (F.size(far) - 1) * F.lit(percentile / 100)
        low = F.floor(at).cast("int")
        limit = F.get(ranked, low) + (at - low) * (F.coalesce(F.get(ranked, low + 1), F.get(ranked, low)) - F.get(ranked, low))
        joined = F.array_join(F.transform(said, lambda x, i: F.when((i > 0) & (F.get(far, i - 1) > limit), F.concat(F.lit("\u0000"), x)).otherwise(x)), "")
        return F.when(F.size(said) < 3, F.array(F.array_join(said, ""))).otherwise(F.split(joined, "\u0000"))

    said = T.sentences(body)
    return F.element_at(F.transform(F.array(F.struct(said.alias("s"), embed(said).alias("v"))), cut), 1)


def chunks(df: DataFrame, size: int = 1800, overlap: int = 200, key: str = "doc_id", text: str = "text", by_heading: bool = True, split: Callable[[Column], Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, loc (`c:{i}`), section, text and chunk_uid (`doc::loc`), and the columns `keep` of the text's row: pieces of the sections of each text, numbered through.

    split makes an array of pieces of a section (pieces of `size` characters that overlap, if not given). All of a text is cut and numbered in one expression
    on its row, so no chunk is shuffled.
    """
    cut = split or (lambda body: pieces(body, size, overlap))
    section = headings(F.col(text)) if by_heading else F.array(F.struct(F.lit("").alias("breadcrumb"), F.col(text).alias("body")))
    numbered = F.flatten(F.transform(section, lambda s: F.transform(cut(s["body"]), lambda x: F.struct(s["breadcrumb"].alias("section"), x.alias("text")))))
    rows = df.select(key, *keep, F.posexplode_outer(numbered).alias("i", "c")).where(F.trim("c.text") != "")
    loc = F.concat(F.lit("c:"), F.col("i").cast("string"))
    return rows.select(key, loc.alias("loc"), "c.section", "c.text", F.concat_ws("::", F.col(key).cast("string"), loc).alias("chunk_uid"), *keep)


def has_chunks(text: Column) -> Column:
    """Whether `chunks` makes anything of a text, which it does of all that is not white space."""
    return F.coalesce(F.rlike(text, F.lit(r"\S")), F.lit(False))


def collapse_repetition(df: DataFrame, text: str = "text", most: int = 3) -> DataFrame:
    """Runs of a repeated unit (1 to 30 lines, or words in a line of more than 12) cut to `most` times.

    Only texts of 500 characters or more with few distinct words are touched, which an expression decides; those alone pass through Python, where the
    scan for the shortest repeating unit belongs.
    """
    c = F.col(text)
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    suspect = F.coalesce((F.length(c) >= 500) & (F.size(words) > 0) & (F.size(F.array_distinct(words)) / F.size(words) < 0.35), F.lit(False))

    def shorter(seq: list) -> list:
        out, i, n = [], 0, len(seq)
        while i < n:
            for size in range(1, min(30, (n - i) // 2) + 1):
                j = i + size
                while j + size <= n and seq[j : j + size] == seq[i : i + size]:
                    j += size
                if (j - i) // size > most:
                    out += seq[i : i + size] * most
                    i = j
                    break
            else:
                out.append(seq[i])
                i += 1
        return out

    def collapse(batch: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            lines = [x.split(" ") for x in shorter(t.split("\n"))]
            return "\n".join(" ".join(shorter(x) if len(x) > 12 else x) for x in lines)

        return batch.map(one)

    fixed = F.pandas_udf(collapse, StringType())(F.when(suspect, c))
    return df.withColumn(text, F.when(suspect, fixed).otherwise(c))


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank or broken ones, with the file and the line that they are from.

    Files are read whole, so that lines can be numbered where they are read; a trace file is a day's log and fits in memory.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("trace_file"), F.split("value", r"\r?\n").alias("lines"))
    each = files.select("trace_file", F.posexplode_outer("lines").alias("n", "line")).where(F.trim("line") != "")
    parsed = each.select("trace_file", (F.col("n") + 1).alias("trace_line"), F.try_parse_json("line").alias("v"), F.from_json("line", schema).alias("r"))
    return parsed.where("v is not null and r is not null").select("r.*", "trace_file", "trace_line")
