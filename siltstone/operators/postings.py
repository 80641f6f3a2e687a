"""A kept inverted index: positional postings in blocks with maxima, written as segments, searched by rank and by phrase.

An update adds a segment of the new texts' postings and, for texts that are gone, their keys and how often each term loses a
text; nothing that is stored is written again until segments are merged. Statistics of terms are sums over segments
less what is gone, so scores are those of an index built anew.

Within a segment rows are cut into ranges by (term, impact, key): a term of any size spreads over as many ranges as it needs, and a query
reads the ranges whose first and last term span one of its own. A block is a run of at most BLOCK postings of a term, those of the
largest impact first, and carries the largest impact it holds; blocks that cannot reach the k-th best score are not read. Parquet stores
positions as differences.

The pseudo-term '' has a posting for every text, which gives the number of texts and of tokens.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.text import query_tokens
from siltstone.sources.snapshots import SnapshotTable, tidy

K1, B = 1.2, 0.75
BLOCK = 128
#: Segments from which an update merges them, and the share of texts that may be gone before.
SEGMENTS, GONE_SHARE = 8, 0.25
#: Blocks up to which a search reads them all at once.
FEW_BLOCKS = 64
#: Bytes of texts that are counted at once, and blocks that leave Python at once.
AT_ONCE, BLOCKS_AT_ONCE = 8 << 20, 1 << 14
#: Tokens of a range, which a task holds; those of one where there are fewer ranges than the session has partitions; tokens of the texts by which ranges are cut.
RANGE, LEAST_RANGE, SAMPLE = 1 << 20, 1 << 16, 1 << 20
_Made = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_STATE = "seq long, kind string, path string, n long, total long, reference double, version long"


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + AT_ONCE, side="right")))
        yield b.slice(start, end - start)
        start = end


def _words(texts: DataFrame) -> DataFrame:
    """key, kh (a hash of the key) and words: the tokens of a text between single blanks, null for none. One string goes to Python faster than a list of them."""
    between = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]++", " "))
    return texts.select("key", F.xxhash64("key").alias("kh"), F.nullif(between, F.lit("")).alias("words"))


def _told(b: pa.RecordBatch) -> tuple:
    """Of the texts of a batch: the lengths, and by text and word (as places in the words) in the order of both the first place in `order`, which sorts the tokens."""
    lists = pc.split_pattern(b.column("words"), " ")
    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    words, doc = pc.list_flatten(lists).dictionary_encode(), np.repeat(np.arange(b.num_rows), dl)
    code, m = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    order = np.argsort(both := doc * m + code, kind="stable")
    own = both[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return dl, words.dictionary.cast(pa.string()), doc, order, first, own[first] // m, own[first] % m


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    """(term, key, kh, tf, dl, positions) of the texts of a batch of _words."""
    dl, words, doc, order, first, text, word = _told(b)
    at = np.arange(len(doc)) - (np.cumsum(dl) - dl)[doc]
    edges = np.append(first, len(doc)).astype(np.int32)
    texts = pa.array(np.concatenate([np.arange(b.num_rows), text]))
    none = np.zeros(b.num_rows, np.int32)
    terms = pa.concat_arrays([pa.array([""] * b.num_rows, pa.string()), words.take(pa.array(word))])
    positions = pa.ListArray.from_arrays(pa.array(np.concatenate([none, edges])), pa.array(at[order].astype(np.int32)))
    tf = np.concatenate([none, np.diff(edges)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([terms, b.column("key").take(texts), b.column("kh").take(texts), pa.array(tf), pa.array(dl).take(texts), positions], ["term", "key", "kh", "tf", "dl", "positions"])


def _of_words(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in _slices(b):
        yield _counted(part)


def _as_is(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if b.num_rows:
        yield b


def term_rows(texts: DataFrame) -> DataFrame:
    """(term, key, kh, tf, dl, positions) of texts (key, text), and a row of the term '' for each text."""
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield from _of_words(b)

    return _words(texts).mapInArrow(run, f"term string, key {kind}, kh long, tf int, dl int, positions array<int>")


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n, dl) of texts (key, text): the texts that have a term, and the tokens of all those; that of all texts under the term ''."""

    def run(batches):
        for b in batches:
            for part in _slices(b):
                dl, words, _, _, _, text, word = _told(part)
                n = np.bincount(word, minlength=len(words))
                size = np.bincount(word, weights=dl[text], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([""], pa.string()), words]), pa.array(np.append(part.num_rows, n)), pa.array(np.append(dl.sum(dtype=np.int64), size))], ["term", "n", "dl"])

    return _words(texts).mapInArrow(run, "term string, n long, dl long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))


def _impact(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _ranges(terms: pa.Array, impact: np.ndarray, kh: np.ndarray, bounds: Sequence[tuple]) -> np.ndarray:
    """The range of each row: the number of bounds (term, falling impact, hash of the key) that it does not stand before."""
    encoded = terms.dictionary_encode()
    code, firsts = encoded.indices.to_numpy(zero_copy_only=False), [t for t, _, _ in bounds]
    words = encoded.dictionary.to_pylist()
    low = np.fromiter((bisect_left(firsts, w) for w in words), np.int32, len(words))
    high = np.fromiter((bisect_right(firsts, w) for w in words), np.int32, len(words))
    at = low[code]
    if len(cut := np.flatnonzero(high > low)):
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        for w in cut:
            own = order[np.searchsorted(sorted_code, w) : np.searchsorted(sorted_code, w, "right")]
            for _, i, h in bounds[low[w] : high[w]]:
                at[own] += (impact[own] < i) | ((impact[own] == i) & (kh[own] >= h))
    return at


def _packed(b: pa.RecordBatch, reference: float, bounds: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """(part, size, rows): the rows of a batch of term_rows by range, those of a range as the compressed bytes of one batch and their number before, so that they need not be sorted and shuffled one by one."""
    number = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    impact = _impact(number("tf"), number("dl"), reference)
    at = _ranges(b.column("term"), impact, number("kh"), bounds)
    order = np.argsort(at, kind="stable")
    rows = pa.RecordBatch.from_arrays([b.column(c) for c in schema.names], schema=schema).take(pa.array(order))
    parts, starts = np.unique(at[order], return_index=True)
    ends = np.append(starts[1:], b.num_rows)
    whole = [rows.slice(s, e - s).serialize() for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([x.size for x in whole], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in whole], pa.binary())], ["part", "size", "rows"])


def _unpacked(rows: list[tuple], reference: float, schema: pa.Schema) -> pa.Table:
    """The rows of a range from (size, compressed bytes) as _packed makes them, with their impacts, which are made again and not shuffled."""
    t = pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(data.as_buffer(), size, "zstd"), schema) for size, data in rows])
    return t.append_column("impact", pa.array(_impact(t.column("tf").to_numpy(), t.column("dl").to_numpy(), reference)))


def _blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK rows of a term, of a range's rows: terms rise, impacts fall, keys rise."""
    encoded = t.column("term").combine_chunks().dictionary_encode()
    rank = np.empty(len(encoded.dictionary), np.int32)
    rank[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
    t = t.append_column("code", pa.array(rank[encoded.indices.to_numpy(zero_copy_only=False)]))
    t = t.take(pc.sort_indices(t, [("code", "ascending"), ("impact", "descending"), ("key", "ascending")])).combine_chunks()
    new = np.flatnonzero(np.diff(t.column("code").to_numpy(), prepend=-1))
    edges = np.concatenate([np.arange(s, e, BLOCK) for s, e in zip(new, [*new[1:], t.num_rows], strict=True)])
    for k in range(0, len(edges), BLOCKS_AT_ONCE):
        own = edges[k : k + BLOCKS_AT_ONCE]
        end = edges[k + BLOCKS_AT_ONCE] if k + BLOCKS_AT_ONCE < len(edges) else t.num_rows
        rows = t.slice(own[0], end - own[0]).combine_chunks()
        column = lambda c, rows=rows: pa.concat_arrays(rows.column(c).chunks)
        starts = own - own[0]
        offsets = pa.array(np.append(starts, rows.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, column(c)) for c in ("key", "tf", "dl", "positions")]
        impact = pc.take(column("impact"), pa.array(starts))
        yield pa.RecordBatch.from_arrays([column("term").take(pa.array(starts)), impact, pa.array(np.diff(np.append(starts, rows.num_rows)).astype(np.int32)), *lists], ["term", "impact", "n", "keys", "tfs", "dls", "positions"])


class Postings:
    """An index of texts (key, text) below a folder. `version` is a number of the caller's: that of the table which the index follows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = SnapshotTable(spark, f"{self.root}/state")
        self._spans: dict[str, list] = {}

    def _rows(self) -> list:
        """What the index consists of: a row for each segment and for each set of texts that are gone."""
        return [] if self.state.current() is None else self.state.read().orderBy("seq", "kind").collect()

    @property
    def version(self) -> int | None:
        rows = self._rows()
        return rows[-1].version if rows else None

    # ---- writing

    def _bounds(self, some: DataFrame, made: _Made, reference: float, many: int) -> list[tuple]:
        """Where the ranges begin, but for the first: (term, impact, hash of the key) by some term_rows."""

        def run(batches):
            for b in (x for y in batches for x in made(y)):
                tf, dl = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tf", "dl"))
                yield pa.RecordBatch.from_arrays([b.column("term"), pa.array(-_impact(tf, dl, reference)), b.column("kh")], ["term", "less", "kh"])

        order = ["term", "less", "kh"]
        spread = some.mapInArrow(run, "term string, less double, kh long").repartitionByRange(many, *order)
        # A row for each range.
        found = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("b")).select("b.*").collect()
        return [(t, -less, h) for t, less, h in sorted((r.term, r.less, r.kh) for r in found)[1:]]

    def _write(self, rows: DataFrame, made: _Made, reference: float, tokens: int) -> tuple[str, int, int]:
        """A segment of what is made of rows (key, kh, …) of about so many tokens, batches of term_rows: its folder, texts and tokens."""
        path = f"{self.root}/segment-{uuid.uuid4().hex}"
        kind = rows.schema["key"].dataType
        schema = pa.schema([("term", pa.string()), ("key", to_arrow_type(kind)), ("tf", pa.int32()), ("dl", pa.int32()), ("positions", pa.list_(pa.int32()))])
        many = max(tokens // RANGE, min(tokens // LEAST_RANGE, int(self.spark.conf.get("spark.sql.shuffle.partitions")))) + 1
        bounds = self._bounds(rows.where(F.pmod("kh", F.lit(max(1, tokens // SAMPLE))) == 0), made, reference, many) if many > 1 else []

        def pack(batches):
            for b in batches:
                for part in made(b):
                    yield _packed(part, reference, bounds, schema)

        def cut(batches):
            held = {}
            for b in batches:
                for part, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    held.setdefault(part, []).append((size, data))
            for part in sorted(held):
                for own in _blocks(_unpacked(held.pop(part), reference, schema)):
                    yield own.append_column("part", pa.array(np.full(own.num_rows, part, np.int32)))

        spread = rows.mapInArrow(pack, "part int, size int, rows binary").repartitionById(len(bounds) + 1, F.col("part"))
        kind = kind.simpleString()
        blocks = spread.mapInArrow(cut, f"term string, impact double, n int, keys array<{kind}>, tfs array<int>, dls array<int>, positions array<array<int>>, part int")
        before = self.spark.conf.get(_WRITERS)
        self.spark.conf.set(_WRITERS, "8")  # a task has blocks of one range, or of a few, which need not be sorted by it
        try:
            with tidy(self.spark):
                blocks.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
        finally:
            self.spark.conf.set(_WRITERS, before)
        blocks = self._open(path)
        blocks.groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.parquet(f"{path}/spans")
        size = blocks.where("term = ''").agg(F.sum("n").alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
        return path, size["n"] or 0, size["total"] or 0

    def _open(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{path}/blocks")

    def update(self, new: DataFrame | None, gone: DataFrame | None = None, version: int | None = None) -> None:
        """Adds texts and takes out others (both key, text; those that are gone as they were when they were added), in one step that readers see."""
        rows = self._rows()
        seq = max([0, *(r.seq for r in rows)]) + 1
        state = [tuple(r)[:6] + (version,) for r in rows]
        if gone is not None and (lost := self._gone(gone, seq)):
            state.append((*lost, version))
        if new is not None:
            n, total = self.size(rows)
            # Any mean length will do, as bounds hold; a near one, such as that of words between blanks, makes them tight.
            told = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("c")).first()
            tokens = told["c"] or 0
            if not n:
                n, total = told["n"], tokens
            if told["n"]:
                reference = max(1.0, total / n)
                state.append((seq, "segment", *self._write(_words(new), _of_words, reference, tokens), reference, version))
        self.state.replace(self.spark.createDataFrame(state, _STATE).coalesce(1))
        self._merge_if_due()

    def build(self, texts: DataFrame, version: int | None = None) -> None:
        """The index anew, of these texts alone."""
        self.state.replace(self.spark.createDataFrame([], _STATE))
        self.update(texts, version=version)

    def _gone(self, gone: DataFrame, seq: int) -> tuple | None:
        path = f"{self.root}/gone-{uuid.uuid4().hex}"
        term_counts(gone.select("key", "text")).write.parquet(f"{path}/terms")
        size = self.spark.read.parquet(f"{path}/terms").where("term = ''").first()
        if size is None or not size["n"]:
            return None
        gone.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/keys")
        return seq, "gone", path, -size["n"], -size["dl"], 0.0

    def _merge_if_due(self) -> None:
        rows = self._rows()
        added, lost = sum(r.n for r in rows if r.kind == "segment"), -sum(r.n for r in rows if r.kind == "gone")
        if sum(r.kind == "segment" for r in rows) > SEGMENTS or lost > GONE_SHARE * added:
            self.merge()

    def merge(self) -> None:
        """One segment of what is live; folders of before stay for readers that have begun (see prune)."""
        rows = self._rows()
        if not rows:
            return
        n, total = self.size(rows)
        posts = reduce(DataFrame.unionByName, [self._open(r.path).select(F.lit(r.seq).alias("seq"), "term", F.explode(F.arrays_zip("keys", "tfs", "dls", "positions")).alias("p")) for r in rows if r.kind == "segment"])
        live = self._live(posts.select("seq", "term", F.col("p.keys").alias("key"), F.xxhash64("p.keys").alias("kh"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "p.positions"), rows).drop("seq")
        reference = max(1.0, total / max(1, n))
        state = [(rows[-1].seq + 1, "segment", *self._write(live, _as_is, reference, total), reference, rows[-1].version)] if n else []
        self.state.replace(self.spark.createDataFrame(state, _STATE).coalesce(1))

    def prune(self, older_than: float = 1800.0) -> None:
        """Deletes folders that no state names any more."""
        import time

        fs, path, kept = self.state._fs, self.state._path, {r.path.rsplit("/", 1)[-1] for r in self._rows()}
        for s in fs.listStatus(path(self.root)):
            name = s.getPath().getName()
            if name.startswith(("segment-", "gone-")) and name not in kept and time.time() - s.getModificationTime() / 1000 >= older_than:
                fs.delete(s.getPath(), True)
        self.state.prune(older_than)

    # ---- reading

    @staticmethod
    def size(rows: Sequence) -> tuple[int, int]:
        """Live texts and their tokens."""
        return sum(r.n for r in rows), sum(r.total for r in rows)

    def _live(self, posts: DataFrame, rows: Sequence) -> DataFrame:
        """Postings (seq, key, …) without those that were taken out after they were added."""
        lost = [self.spark.read.parquet(f"{r.path}/keys").select(F.col("key").alias("_key"), F.lit(r.seq).alias("_seq")) for r in rows if r.kind == "gone"]
        if not lost:
            return posts
        last = reduce(DataFrame.unionByName, lost).groupBy("_key").agg(F.max("_seq").alias("_seq"))
        return posts.join(last, (F.col("key") == F.col("_key")) & (F.col("_seq") > F.col("seq")), "left_anti")

    def blocks(self, terms: Sequence[str], rows: Sequence) -> DataFrame | None:
        """(seq, reference, term, impact, n, keys, tfs, dls, positions) of the ranges that may hold the terms."""
        found = []
        for r in rows:
            if r.kind != "segment":
                continue
            if r.path not in self._spans:  # a row for each range, and segments never change
                self._spans[r.path] = self.spark.read.parquet(f"{r.path}/spans").collect()
            parts = [s.part for s in self._spans[r.path] if any(s.low <= t <= s.high for t in terms)]
            if parts:
                own = self._open(r.path).where(F.col("part").isin(parts) & F.col("term").isin(list(terms)))
                found.append(own.select(F.lit(r.seq).alias("seq"), F.lit(r.reference).alias("reference"), "term", "impact", "n", "keys", "tfs", "dls", "positions"))
        return reduce(DataFrame.unionByName, found) if found else None

    def statistics(self, terms: Sequence[str], rows: Sequence | None = None) -> dict[str, dict]:
        """df (live texts), blocks and the largest impact of each term that some text has."""
        rows = self._rows() if rows is None else rows
        own = self.blocks(terms, rows)
        if own is None:
            return {}
        told = own.select("term", "n", F.lit(1).alias("blocks"), F.struct("impact", "reference").alias("top"))
        for r in rows:
            if r.kind == "gone":
                lost = self.spark.read.parquet(f"{r.path}/terms").where(F.col("term").isin(list(terms)))
                told = told.unionByName(lost.select("term", (-F.col("n")).cast("int").alias("n"), F.lit(0).alias("blocks"), F.lit(None).cast("struct<impact:double,reference:double>").alias("top")))
        # A row for each term of the query.
        each = told.groupBy("term").agg(F.sum("n").alias("df"), F.sum("blocks").alias("blocks"), F.max("top.impact").alias("impact"), F.min("top.reference").alias("reference"))
        return {r.term: r.asDict() for r in each.collect() if r.df > 0}

    def _posts(self, own: DataFrame, rows: Sequence, *more: str) -> DataFrame:
        names = {"keys": "key", "tfs": "tf", "dls": "dl", "positions": "positions"}
        each = own.select("seq", "term", F.explode(F.arrays_zip("keys", "tfs", "dls", *more)).alias("p"))
        return self._live(each.select("seq", "term", *[F.col(f"p.{c}").alias(names[c]) for c in ("keys", "tfs", "dls", *more)]), rows)

    def _scored(self, posts: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
        """Sums in the order of the query's terms, so that equal texts have equal scores and ties are broken by key alone."""
        dl = F.max("dl").cast("double")
        score = F.lit(0.0)
        held = posts.groupBy("key").agg(dl.alias("dl"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).cast("double").alias(f"tf_{i}") for i, t in enumerate(idf)])
        for i, w in enumerate(idf.values()):
            tf = F.col(f"tf_{i}")
            score = score + F.lit(w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))
        return held.select("key", score.alias("score"))

    def search(self, query: str, k: int = 50, scope: DataFrame | None = None, notes: dict | None = None) -> DataFrame:
        """(key, score) of the k best live texts by BM25; scope (key) limits what is ranked but not the statistics.

        A lower bound of the k-th best score comes from the first blocks of the term that can score highest. A block is left out if its
        largest impact, with the largest ones of all other terms, stays below it: none of its texts can be among the k best.
        """
        rows, terms = self._rows(), query_tokens(query)
        n, total = self.size(rows)
        known = self.statistics(terms, rows) if terms and n else {}
        own = self.blocks(list(known), rows) if known else None
        if own is None:
            kind = self._open(next(r.path for r in rows if r.kind == "segment")).schema["keys"].dataType.elementType.simpleString() if n else "string"
            return self.spark.createDataFrame([], f"key {kind}, score double")
        mean = max(1e-9, total / max(1, n))
        known = {t: known[t] for t in terms if t in known}  # in the order of the query
        idf = {t: float(np.log(1 + (n - s["df"] + 0.5) / (s["df"] + 0.5))) for t, s in known.items()}
        # Impacts were taken at another mean length; this factor makes them bounds for the present one.
        factor = max(1.0, *(mean / s["reference"] for s in known.values()))
        most = {t: idf[t] * s["impact"] * factor for t, s in known.items()}
        within = lambda posts: posts if scope is None else posts.join(scope.select("key"), "key", "left_semi")
        needed = dict.fromkeys(known, 0.0)
        if sum(s["blocks"] for s in known.values()) > FEW_BLOCKS:
            best = max(most, key=most.get)
            head = own.where(F.col("term") == best).select("impact").orderBy(F.desc("impact")).limit(2 + 2 * k // BLOCK).collect()
            some = self._scored(within(self._posts(own.where((F.col("term") == best) & (F.col("impact") >= head[-1].impact)), rows)), {best: idf[best]}, mean)
            scores = [r.score for r in some.orderBy(F.desc("score")).limit(k).select("score").collect()]
            if len(scores) == k:
                rest = sum(most.values())
                needed = {t: (scores[-1] * (1 - 1e-9) - (rest - most[t])) / (idf[t] * factor) for t in known}
        read = own.where(reduce(Column.__or__, [(F.col("term") == t) & (F.col("impact") >= x) for t, x in needed.items()]))
        if notes is not None:
            notes |= {"blocks": sum(s["blocks"] for s in known.values()), "needed": needed, "read": read}
        return self._scored(within(self._posts(read, rows)), idf, mean).orderBy(F.desc("score"), "key").limit(k)

    def phrase(self, words: str, rows: Sequence | None = None) -> DataFrame | None:
        """(key, n): texts in which the words follow each other, and how often; None where a word is in no text.

        From the rarest word on, texts are joined with those of the next one and places are intersected, so what is carried only shrinks.
        """
        rows = self._rows() if rows is None else rows
        line = query_tokens(words, distinct=False)
        known = self.statistics(list(dict.fromkeys(line)), rows)
        if not line or any(t not in known for t in line):
            return None
        held = None
        for at in sorted(range(len(line)), key=lambda i: known[line[i]]["df"]):
            posts = self._posts(self.blocks([line[at]], rows), rows, "positions")
            starts = posts.select("key", F.transform("positions", lambda p: p - F.lit(at)).alias("s"))
            if held is None:
                held = starts.withColumnRenamed("s", "starts")
            else:
                held = held.join(starts, "key").select("key", F.array_intersect("starts", "s").alias("starts")).where(F.size("starts") > 0)
        return held.select("key", F.size("starts").alias("n"))

    def keyword_search(self, query: str, k: int = 50, scope: DataFrame | None = None) -> DataFrame:
        """search() by all words of a query over the texts that hold each of its quoted phrases; where none does, by its bare words."""
        quoted = [p for p in query.split('"')[1::2] if query_tokens(p)]
        if not quoted:
            return self.search(query, k, scope)
        rows = self._rows()
        held = [self.phrase(p, rows) for p in quoted]
        if all(h is not None for h in held):
            both = reduce(lambda a, b: a.join(b.select("key"), "key", "left_semi"), held)
            found = self.search(query, k, both if scope is None else both.join(scope.select("key"), "key", "left_semi"))
            if found.limit(1).count():
                return found
        return self.search(query, k, scope)
