"""Order MinHash: fingerprints of texts that follow their edit distance.

The parts of a text are its k-mers (K code points), each with the number of its occurrences before it, so repeats count. For each of ROWS hash
functions the LEAST smallest parts are selected, put in the order in which they stand in the text, and the tuple of their
k-mers is hashed. The share of equal entries of two fingerprints estimates how much of the texts agrees both in content and in order.

Each text is also fingerprinted after an edit: its last quarter is replaced by the beginning of the next document. The parts before the
edit are the same in both and are gone through once. Documents are cut into ranges of ids and sorted, so that a text stands beside its
successor; only the first text of each range goes to the end of the range before it. Texts are shuffled once.

Defined cases: a null text is empty; texts shorter than K are one k-mer; an empty text has none, and two such are equal; a null
id comes first; rows of equal id follow each other by a hash of the text; a lone document is followed by itself; an empty table has no rows.
Memory grows with the longest text, time with its length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import stored

K, LEAST, ROWS = 8, 2, 64
#: Parts that are hashed by all functions at once.
BLOCK = 4096
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit depending on every other, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def functions(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each hash function x -> (x ^ a) * b over 32 bits; b is odd."""
    x = _mixed(np.arange(1, 2 * rows + 1, dtype=np.uint64) * np.uint64(_BASE)) >> np.uint64(32)
    return x[:rows].astype(np.uint32)[:, None], (x[rows:].astype(np.uint32) | np.uint32(1))[:, None]


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of code points; a shorter text, unless empty, is one."""
    k = min(k, len(codes))
    h = codes.astype(np.uint64)
    if not k:
        return h
    have = 1
    # Two halves give the whole; they overlap where k is no power of two.
    while have < k:
        step = min(have, k - have)
        h = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        have += step
    return _mixed(h)


def parts(h: np.ndarray) -> np.ndarray:
    """32-bit numbers of k-mers with their occurrence numbers."""
    n = len(h)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    at = np.arange(n, dtype=np.uint64)
    order = ((h >> bits) << bits) | at
    order.sort()
    again = np.flatnonzero((order[1:] >> bits) == (order[:-1] >> bits)) + 1
    out = h.copy()
    if len(again):
        first = np.ones(n, bool)
        first[again] = False
        start = np.maximum.accumulate(np.where(first, at, np.uint64(0)))
        place = (order[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        out[place] = _mixed(out[place] + (at[again] - start[again]) * np.uint64(_BASE))
    return (out >> np.uint64(32)).astype(np.uint32)


class Least:
    """The smallest parts so far under each function, with their places."""

    def __init__(self, rows: int = ROWS, least: int = LEAST):
        self.value, self.place = np.full((rows, least), _NONE), np.full((rows, least), -1, np.int64)

    def copy(self) -> Least:
        out = Least.__new__(Least)
        out.value, out.place = self.value.copy(), self.place.copy()
        return out

    def add(self, part: np.ndarray, start: int) -> None:
        """More parts, of which the first stands at `start`."""
        a, b = functions(len(self.value))
        least = self.value.shape[1]
        for k in range(0, len(part), BLOCK):
            x = part[k : k + BLOCK] ^ a
            x *= b
            rows = np.flatnonzero(x.min(axis=1) <= self.value[:, -1])
            x = x if len(rows) == len(x) else x[rows]
            value, place, line = [self.value[rows]], [self.place[rows]], np.arange(len(rows))
            for _ in range(min(least, x.shape[1])):
                i = x.argmin(axis=1)
                value.append(x[line, i][:, None])
                place.append(i[:, None] + (start + k))
                x[line, i] = _NONE
            value, place = np.concatenate(value, axis=1), np.concatenate(place, axis=1)
            # Places not used yet go last.
            order = np.lexsort((place, value, place < 0), axis=1)[:, :least]
            self.value[rows], self.place[rows] = value[line[:, None], order], place[line[:, None], order]

    def fingerprint(self, h: np.ndarray) -> np.ndarray:
        """An entry for each function: the hash of its selected k-mers (h by place) in the order of the text."""
        place = np.sort(self.place, axis=1)
        out = np.zeros(len(place), np.uint64)
        for c in range(place.shape[1]):
            p = place[:, c]
            own = np.where(p >= 0, h[np.maximum(p, 0)] if len(h) else np.uint64(0), np.uint64(0))
            out = _mixed(out * np.uint64(_BASE) + own + np.uint64(c + 1))
        return (out >> np.uint64(32)).astype(np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    """ROWS entries of 32 bits."""
    h = kmers(codes(text or ""))
    found = Least()
    found.add(parts(h), 0)
    return found.fingerprint(h)


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by as much of the following one, and where the edit begins."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut], len(text) - cut


def both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of the edited text, which is the third."""
    new, at = edited(text, following)
    h, g = kmers(codes(text)), kmers(codes(new))
    p, q = parts(h), parts(g)
    same = max(0, at - K + 1) if min(len(text), len(new)) >= K else 0
    found = Least()
    found.add(p[:same], 0)
    other = found.copy()
    found.add(p[same:], same)
    other.add(q[same:], same)
    return found.fingerprint(h), other.fingerprint(g), new


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_ROW = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fp binary, efp binary, near_edited double, near_next double, text string"
_NAMES = [x.strip().split()[0] for x in _ROW.split(",")]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _walk(batches):
    """Rows beside their successors (kind 0); the first and the last row of a range with their texts (kinds 1 and 2)."""
    part = TaskContext.get().partitionId()
    before, ready, out = None, None, []  # the row before; what is known of the one before that
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if before is None:
                out.append((1, part, None, None, None, None, None, None, None, text))
            else:
                fp, efp, new = both(before[1], text)
                if ready:
                    out.append((*ready[:-2], likeness(ready[-1], fp), None))
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                ready = (0, part, before[0], len(before[1]), digest, fp.tobytes(), efp.tobytes(), likeness(fp, efp), None, fp)
            before = (doc_id, text)
        if len(out) >= 1000:
            yield _record(out)
            out = []
    if before is not None:
        fp = fingerprint(before[1])
        if ready:
            out.append((*ready[:-2], likeness(ready[-1], fp), None))
        out.append((2, part, before[0], len(before[1]), None, fp.tobytes(), None, None, None, before[1]))
        yield _record(out)


def _close(batches):
    """The last rows of ranges beside the first rows of the next ones: (doc_id, text, following)."""
    for b in batches:
        out = []
        for doc_id, text, following in zip(*[c.to_pylist() for c in b.columns], strict=True):
            fp, efp, new = both(text, following)
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((0, 0, doc_id, len(text), digest, fp.tobytes(), efp.tobytes(), likeness(fp, efp), likeness(fp, fingerprint(following)), None))
        if out:
            yield _record(out)


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row; a fingerprint is ROWS times eight hexadecimal digits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("r"))
    placed = base.repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")
    found = stored(placed.mapInArrow(_walk, _ROW))
    # One number for each range that has rows; each is followed by the next one, the last by the first.
    ranges = sorted(r.part for r in found.where("kind = 2").select("part").collect())
    after = F.broadcast(docs.sparkSession.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "part int, following_part int"))
    last = found.where("kind = 2").select("part", "doc_id", "text").join(after, "part")
    heads = found.where("kind = 1").select(F.col("part").alias("following_part"), F.col("text").alias("following"))
    ends = last.join(heads, "following_part").select("doc_id", "text", "following").mapInArrow(_close, _ROW)
    every = found.where("kind = 0").unionByName(ends)
    hexed = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"), "near_edited", "near_next")
