"""Token counts from a compiled finite-state transducer.

A byte-fallback BPE vocabulary whose pieces hold the word mark only at their start is compiled into a deterministic
transducer over characters. The encoding of a prefix ends in one determined token: the vocabulary entry that ends there
and stands after the last token of what precedes it as an encoding would leave it. What later characters can still depend on is a state: for
every start from which a longer piece may yet grow, the node of the piece tree, the last token before it and its
count relative to the present count; and the last token here. A transition is annotated with the change of the token
count (which may be negative), so the sum along a text is its exact number of tokens. States are compiled when first met.

Texts are cut into chunks of equal length that all run at once in numpy, each from the state after a word mark. A chunk is a
map from the state it is entered in to the state it is left in and a count. The maps are composed in a prefix scan:
where a chunk is entered in another state than the one it was run from, its head is run again until both runs agree
in state, which a word mark or line end after a word forces; from there on the counts are shared.

Defined cases: a null text is empty and has no tokens; special strings are ordinary text; repeated rows and rows without an id each
give a row; an empty table gives none. The transducer's table is dropped and compiled anew when it holds MAX_STATES states, which is looked at
before each AT_ONCE characters, so it holds the states of so many more at most, or of one text that is longer.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STATES = 200_000
CHUNK = 512
#: Characters of texts that run at once; as many states can be new in them at most, and pairs of tokens that are remembered.
AT_ONCE, PAIRS = 1 << 20, 1 << 18
UNSEEN = 0xFFFF
#: Fixed values of the model format: the word mark, the run of marks that is one piece at most, kinds of pieces.
MARK = "▁"
LONGEST_RUN = 16
NORMAL, BYTE = 1, 6


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def number():
        nonlocal i
        out = shift = 0
        while True:
            c = b[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            v, i = b[i : i + n], i + n
            yield key >> 3, struct.unpack("<f", v)[0] if key & 7 == 5 else v


class Vocabulary:
    """Pieces of a model file with their merge order."""

    def __init__(self, model: bytes):
        self.rank: dict[str, int] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                if f.get(3, NORMAL) == NORMAL:
                    self.rank[f[1].decode()] = -int(f.get(2, 0.0))
        self.pieces = [p for p in self.rank if p.strip(MARK)]
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) for p in self.pieces):
            raise ValueError("a piece holds the word mark elsewhere than once at its start")
        self.merging = {c for p in self.pieces if len(p) > 1 for c in p}
        self._parted: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def stays(self, a: str, b: str) -> bool:
        """Whether a and b in a row are an encoding."""
        got = self._parted.get((a, b))
        if got is None:
            if len(self._parted) >= PAIRS:
                self._parted.clear()
            got = self._parted[a, b] = self.encode(a + b) == [a, b]
        return got


class Transducer:
    """Transitions next[state, class] and emit[state, class]; class 0 is any character that merges with nothing."""

    def __init__(self, model: bytes):
        self.vocabulary = v = Vocabulary(model)
        chars = sorted(v.merging | {MARK})
        # Columns are given to characters when they are first seen; before, they are UNSEEN.
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = UNSEEN
        self.chars, self.mark = [None, MARK], 1
        self.class_of[[ord(" "), ord(MARK)]] = self.mark
        # What a character outside the classes emits: one piece, or its bytes.
        cost = np.full(0x110000, 4, np.uint8)
        cost[:0x80], cost[0x80:0x800], cost[0x800:0x10000] = 1, 2, 3
        for p in v.rank:
            if len(p) == 1:
                cost[ord(p)] = 1
        self.cost = cost
        # By how much a mark makes a run longer in tokens; runs of the longest piece repeat.
        runs = [len(v.encode(MARK * k)) if k else 0 for k in range(LONGEST_RUN + 1)]
        self.longer = [b - a for a, b in zip(runs, runs[1:])]
        # The piece tree: children by (node, character), the piece that a node completes.
        self.child: dict[tuple[int, str], int] = {}
        self.piece: list[str | None] = [None]
        grows = set()
        for p in v.pieces:
            at = 0
            for c in p:
                if (at, c) not in self.child:
                    self.child[at, c] = len(self.piece)
                    grows.add(at)
                    self.piece.append(None)
                at = self.child[at, c]
            self.piece[at] = p
        self.grows = grows
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, max(64, len(self.chars))), -1, np.int32)
        self.emit = np.zeros(self.next.shape, np.int8)
        self.free = self._state(("", ()))  # after a character that merges with nothing: no last token, no open start
        self.runs = [self._state((k, ())) for k in range(LONGEST_RUN)]  # after a run of k + 1 marks, modulo the longest

    def _state(self, key: tuple) -> int:
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.states)
            self.states.append(key)
            if k == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return k

    def _step(self, state: int, cls: int) -> tuple[int, int]:
        last, opened = self.states[state]
        if cls == 0:
            return self.free, 0
        if cls == self.mark:
            k = (last + 1) % LONGEST_RUN if isinstance(last, int) else 0
            return self.runs[k], self.longer[k]
        c = self.chars[cls]
        if isinstance(last, int):  # the last mark of the run opens a piece, before which stand the marks of a shorter run
            opened, last = ((self.child.get((0, MARK), 0), "", -self.longer[last]),), MARK
        count, token, still = None, None, []
        for node, before, rel in (*opened, (0, last, 0)):
            at = self.child.get((node, c))
            if at is None:
                continue
            p = self.piece[at]
            if p is not None and (count is None or rel + 1 <= count) and (not before or self.vocabulary.stays(before, p)):
                count, token = rel + 1, p
            if at in self.grows:
                still.append((at, before, rel))
        if token is None:  # a character of longer pieces that is none itself
            return self.free, int(self.cost[ord(c)])
        return self._state((token, tuple((n, b, r - count) for n, b, r in still))), count

    def compile(self, states: np.ndarray, classes: np.ndarray) -> None:
        """Fills in the transitions that are still missing."""
        width = self.next.shape[1]
        for x in np.unique(states.astype(np.int64) * width + classes).tolist():
            s, c = divmod(x, width)
            to, out = self._step(s, c)
            self.next[s, c], self.emit[s, c] = to, out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        ends = np.cumsum([len(t or "") for t in texts]) if texts else np.empty(0, np.int64)
        out, lo = [np.empty(0, np.int64)], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            out.append(self._count(texts[lo:hi]))
            lo = hi
        return np.concatenate(out)

    def _count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.states) > MAX_STATES:
            self._clear()
        texts = [t or "" for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        cls = self.class_of[code]
        if (cls == UNSEEN).any():
            for c in np.unique(code[cls == UNSEEN]).tolist():
                self.class_of[c] = len(self.chars)
                self.chars.append(chr(c))
            more = len(self.chars) - self.next.shape[1]
            if more > 0:
                more += -more % 32
                self.next = np.pad(self.next, ((0, 0), (0, more)), constant_values=-1)
                self.emit = np.pad(self.emit, ((0, 0), (0, more)))
            cls = self.class_of[code]
        plain = np.where(cls == 0, self.cost[code], 0).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(plain)])
        out = total[ends] - total[begins]
        # Chunks never span texts: chunk k of a text is its k-th run of CHUNK characters; padding is class 0, which emits nothing.
        n_chunks = -(-lengths // CHUNK)
        n = int(n_chunks.sum())
        if not n:
            return out
        text_of = np.repeat(np.arange(len(texts)), n_chunks)
        first = np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        k_of = np.arange(n) - first
        at = begins[text_of] + k_of * CHUNK
        width = np.minimum(CHUNK, ends[text_of] - at)
        order = np.argsort(-width, kind="stable")
        grid = np.zeros((CHUNK, n), np.uint16)
        cell = np.arange(CHUNK)[:, None]
        for lo in range(0, n, 4096):
            o = order[lo : lo + 4096]
            pos = at[o] + cell
            grid[:, lo : lo + 4096] = np.where(cell < width[o], cls[np.minimum(pos, len(cls) - 1)], 0)
        # The map of each chunk from the state after one mark, in which a text begins.
        tally = np.zeros(n, np.int64)
        state = np.full(n, self.runs[0], np.int32)
        longest = width[order]
        for step in range(int(longest[0])):
            m = int(np.searchsorted(-longest, -step, "left"))  # chunks longer than step come first
            s, row = state[:m], grid[step, :m]
            to = self.next[s, row]
            if to.min() < 0:
                lack = to < 0
                self.compile(s[lack], row[lack])
                to = self.next[s, row]
            tally[:m] += self.emit[s, row]
            state[:m] = to
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        leaves, tally = state[place], tally[place]
        # Composition: a chunk entered in another state runs its head again, beside the first run, until both agree.
        entered = np.full(n, self.runs[0], np.int32)
        inner = np.flatnonzero(k_of > 0)
        while True:
            want = leaves[inner - 1]
            redo = inner[want != entered[inner]]
            if not len(redo):
                break
            old, new = entered[redo].copy(), leaves[redo - 1].copy()
            entered[redo] = new
            live = np.arange(len(redo))
            for step in range(CHUNK):
                live = live[(width[redo[live]] > step) & (old[live] != new[live])]
                if not len(live):
                    break
                row = grid[step, place[redo[live]]]
                for now, sign in ((old, -1), (new, 1)):
                    s = now[live]
                    to = self.next[s, row]
                    if to.min() < 0:
                        lack = to < 0
                        self.compile(s[lack], row[lack])
                        to = self.next[s, row]
                    tally[redo[live]] += sign * self.emit[s, row].astype(np.int64)
                    now[live] = to
            apart = old != new
            leaves[redo[apart]] = new[apart]
        out += np.bincount(text_of, weights=tally, minlength=len(texts)).astype(np.int64)
        out[lengths > 0] += 1  # the mark that every text begins with
        return out


_made: dict[int, Transducer] = {}


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs; model is the content of the model file."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a model file has a fixed size, here 0.5 MB

    def run(batches):
        key = hash(sent.value)
        machine = _made.get(key)
        if machine is None:
            _made.clear()
            machine = _made[key] = Transducer(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                texts = part.column(1).to_pylist()
                counts = machine.count(texts)
                n_bytes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
