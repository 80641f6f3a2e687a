"""Benchmark decontamination with one Aho-Corasick automaton.

Texts of documents and benchmark items are normalised to lower-case ASCII words joined by single spaces. Every window
of `size` consecutive item words (a shorter item is one window) is a pattern that begins and ends with a space, so it
matches whole words only. One automaton over all patterns reads each text once; matches are mapped to word positions
and back to code point offsets in the original text.

The automaton is made of patterns of a checked size (SHARD bytes of pattern text, about 50 bytes of automaton each), which alone
are broadcast. A benchmark beyond that is dealt by the hash of its windows into as many parts as it takes, and the texts are
scanned part after part; what was found so far stands beside the text in a table, so neither the driver nor a worker ever
holds more than one part.

Defined cases: a null text has no words; an item without words has no window; an item with a null id hits words but is
not counted or named; repeated items count once; repeated rows each give a row. items_sha256 of no items is that of the empty string. An
empty table gives none. Texts may be of any length; a text is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import stored

SIZE = 10
SHARD = 4_000_000
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, win): every window of every item, once."""

    def run(batches):
        for b in batches:
            items, wins = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                for k in range(max(1, len(w) - size + 1) if w else 0):
                    items.append(item)
                    wins.append(b" ".join(w[k : k + size]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wins, pa.binary())], ["item", "win"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, win binary").distinct()


class Scanner:
    """Scans texts for the windows of one part of a benchmark; the part travels as a broadcast of at most about SHARD bytes."""

    def __init__(self, sent):
        self.sent, self._auto = sent, None

    def __getstate__(self):
        return {"sent": self.sent, "_auto": None}

    def _automaton(self):
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for win, items in self.sent.value.items():
                self._auto.add_word(f" {win.decode('latin-1')} ", (len(win) + 2, win.count(b" ") + 1, [x for x in items if x is not None]))
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto

    def scan(self, texts: list[str | None]):
        """For each text: number of words, hit words as an array of flags or None, set of items."""
        auto, out = self._automaton(), []
        for t in texts:
            w = words(t)
            s, flags, found, starts = f" {b' '.join(w).decode('latin-1')} ", None, set(), None
            for end, (chars, n, own) in auto.iter(s) if len(auto) else ():
                if flags is None:
                    starts = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 0x20)
                    flags = np.zeros(len(w), bool)
                at = int(np.searchsorted(starts, end - chars + 1))
                flags[at : at + n] = True
                found.update(own)
            out.append((len(w), flags, found))
        return out


def scanners(benchmark: DataFrame, size: int = SIZE, shard: int = SHARD) -> Iterator[tuple[Scanner, bool]]:
    """A scanner for each part of a benchmark, and whether it is the last; a part is let go when the next one is asked for."""
    spark = benchmark.sparkSession
    wins = stored(windows(benchmark, size))
    part = F.pmod(F.xxhash64("win"), F.lit(1 << 20))
    # Sizes of 2^20 classes at most; runs of classes are cut where they reach the size of a part.
    sizes = wins.groupBy(part.alias("c")).agg(F.sum(F.octet_length("win") + 2).alias("b")).orderBy("c")
    cuts, held = [0], 0
    for r in sizes.toLocalIterator():
        if held and held + r.b > shard:
            cuts.append(r.c)
            held = 0
        held += r.b
    cuts.append(1 << 20)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        by: dict[bytes, list[str]] = {}
        for r in wins.where((part >= lo) & (part < hi)).toLocalIterator():
            by.setdefault(bytes(r.win), []).append(r.item)
        sent = spark.sparkContext.broadcast(by)
        yield Scanner(sent), k == len(cuts) - 2
        if k < len(cuts) - 2:
            sent.unpersist()


def spans(text: str, flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code point offsets in the original text, ends exclusive."""
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_STATE = "doc_id long, text string, flags binary, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (offsets in the original text)."""
    out = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def found(scanner):
        """(part, counts, flags, items) of slices of the batches, with what was found before."""

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    part = b.slice(k, 1000)
                    got = scanner.scan(part.column(1).to_pylist())
                    before = [None if x is None else np.frombuffer(x, bool) for x in part.column(2).to_pylist()]
                    flags = [f if o is None else o if f is None else f | o for o, (_, f, _) in zip(before, got, strict=True)]
                    items = [i | set(o or ()) for o, (_, _, i) in zip(part.column(3).to_pylist(), got, strict=True)]
                    yield part, [n for n, _, _ in got], flags, items

        return run

    def more(scanner):
        def run(batches):
            for part, _, flags, items in found(scanner)(batches):
                kept = pa.array([None if f is None else f.tobytes() for f in flags], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), kept, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], ["doc_id", "text", "flags", "items"])

        return run

    def last(scanner):
        def run(batches):
            for part, counts, flags, items in found(scanner)(batches):
                hits = [0 if f is None else int(f.sum()) for f in flags]
                where = [[] if f is None else spans(t, f) for t, f in zip(part.column(1).to_pylist(), flags, strict=True)]
                sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hits]), pa.array(where, kind)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

        return run

    none = [F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("array<string>").alias("items")]
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *none)
    for scanner, end in scanners(benchmark, size, shard):
        if end:
            return state.mapInArrow(last(scanner), out)
        state = stored(state.mapInArrow(more(scanner), _STATE))
    raise AssertionError("a benchmark has at least one part")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """The documents, all columns, that no window occurs in."""
    at = docs.columns.index("text")

    def without(scanner):
        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    part = b.slice(k, 1000)
                    yield part.filter(pa.array([f is None for _, f, _ in scanner.scan(part.column(at).to_pylist())], pa.bool_()))

        return run

    for scanner, end in scanners(benchmark, size, shard):
        docs = docs.mapInArrow(without(scanner), docs.schema)
        docs = docs if end else stored(docs)
    return docs
