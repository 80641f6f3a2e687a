"""Readers of file formats that are archives or tables: Office, EPUB, RTF, CSV and Excel, with the standard library only."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes, paragraph: str = "p", text: str = "t") -> list[str]:
    """The text of each paragraph of a part of a document, tabs and breaks included."""
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) == paragraph and not any(e is not p and _local(e.tag) == paragraph for e in p.iter()):
            out.append("".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(_local(e.tag), "") if _local(e.tag) != text else e.text or "" for e in p.iter()))
    return [x for x in out if x.strip()]


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(_paragraphs(z.read("word/document.xml")))


def pptx(data: bytes) -> str:
    """Slides in their order, each under its number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        return "\n\n".join("\n".join([f"<!-- Slide number: {k} -->", *_paragraphs(z.read(n))]) for k, n in enumerate(slides, 1))


def page_text(html: str) -> str:
    bare = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    lines = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", bare)
    plain = unescape(re.sub(r"<[^>]*>", " ", lines))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\xa0]+", " ", plain)).strip()


def epub(data: bytes) -> str:
    """Chapters in the order of the book's spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        at = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
        book = ElementTree.fromstring(z.read(at))
        here = at.rsplit("/", 1)[0] + "/" if "/" in at else ""
        parts = {e.attrib["id"]: here + e.attrib["href"] for e in book.iter() if _local(e.tag) == "item"}
        spine = [parts[e.attrib["idref"]] for e in book.iter() if _local(e.tag) == "itemref" and e.attrib["idref"] in parts]
        return "\n\n".join(x for n in spine if (x := page_text(z.read(n).decode("utf-8", "replace"))))


def rtf(data: bytes) -> str:
    """Text without groups that only describe (fonts, colours, pictures), control words and braces."""
    s = data.decode("latin-1")
    out, skip, depth, k = [], None, 0, 0
    for m in re.finditer(r"\\'([0-9a-f]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", s, re.S):
        code, uni, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            depth += 1
        elif brace == "}":
            depth -= 1
            skip = None if skip is not None and depth < skip else skip
        elif skip is not None:
            continue
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "generator") or sign == "*":
            skip = depth
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif sign and sign in "\\{}":
            out.append(sign)
        elif plain:
            out.append(plain.replace("\r", "").replace("\n", ""))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def csv_table(data: bytes) -> str:
    """A table in Markdown: quoted fields may hold commas and line ends."""
    rows = [[re.sub(r"\s*\n\s*", " ", c).strip() for c in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx(data: bytes) -> str:
    """Sheets by name: the first row as headers, whatever it holds, and of the others the cells that are text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        target = {}
        if "xl/_rels/workbook.xml.rels" in names:
            target = {e.attrib["Id"]: e.attrib["Target"] for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter() if "Target" in e.attrib}
        parts = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(sheet.tag) != "sheet":
                continue
            rid = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), "")
            path = target.get(rid, f"worksheets/sheet{len(parts) + 1}.xml").lstrip("/")
            body = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            lines = []
            for row in (e for e in body.iter() if _local(e.tag) == "row"):
                cells: dict[int, tuple[str, bool]] = {}
                for c in (e for e in row if _local(e.tag) == "c"):
                    kind = c.attrib.get("t", "n")
                    value = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                    is_text = kind in ("s", "str", "inlineStr")
                    cells[_column(c.attrib.get("r", "")) if c.attrib.get("r") else len(cells)] = (shared[int(value)] if kind == "s" and value else value, is_text)
                if not lines:
                    lines.append("Headers: " + " | ".join(cells[k][0].strip() if k in cells else "" for k in range(max(cells, default=-1) + 1)))
                elif texts := [v.strip() for _, (v, is_text) in sorted(cells.items()) if is_text and v.strip()]:
                    lines.append(" | ".join(texts))
            if lines:
                parts.append("\n".join([f"Sheet: {sheet.attrib.get('name', '')}", *lines]))
        return "\n\n".join(parts)


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx, "pptx": pptx, "epub": epub, "rtf": rtf, "csv": csv_table, "xlsx": xlsx}


def read(data: bytes | None, ext: str | None) -> str | None:
    """The text of a file, or an empty text where it cannot be read."""
    f = READERS.get(ext or "")
    if data is None or f is None:
        return None
    try:
        return f(bytes(data))
    except Exception:  # a broken file has no text; the run goes on
        return ""


@F.pandas_udf(StringType())
def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, ext in batches:
        yield pd.Series([read(d, e) for d, e in zip(data, ext, strict=True)], dtype=object)


def read_columns(content: Column, ext: Column) -> Column:
    return _read(content, ext)


def with_ocr(pages: Column, ocr: Column, strategy: str = "text_then_ocr", least: int = 200, header: Column | None = None) -> Column:
    """Pages of a PDF (array of texts) as (page, text, was_ocr), with what a recogniser found (array of texts, null where it was not asked).

    text_only takes pages as they are, ocr_only what was recognised, text_then_ocr that for pages of fewer than `least` characters where it found something. A header
    goes before the first page.
    """
    if strategy not in ("text_only", "text_then_ocr", "ocr_only"):
        raise ValueError(f"unknown strategy: {strategy}")
    found = lambda i: F.coalesce(F.get(ocr, i), F.lit(""))

    def one(x, i):
        own = F.trim(x)
        better = F.lit(strategy == "ocr_only") if strategy != "text_then_ocr" else (F.length(own) < least) & (F.trim(found(i)) != "")
        text = F.when(better, found(i)).otherwise(own)
        if header is not None:
            text = F.when((i == 0) & (F.coalesce(header, F.lit("")) != ""), F.concat(header, F.lit("\n\n"), text)).otherwise(text)
        return F.struct(i.alias("page"), text.alias("text"), better.alias("was_ocr"))

    return F.transform(pages, one)
