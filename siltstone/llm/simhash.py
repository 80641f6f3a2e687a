"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt into cells by the
population counts of their two halves; a pair within the radius differs by no more than the radius in the sum of both
counts, so only neighbouring cells are compared and all other tile pairs are skipped without a look. Within a cell
pair, tiles of bounded size go through numpy exclusive-or and bit counts. No candidate is lost: the comparison is exact.

Copies of one fingerprint count once, a group emits a spanning forest and not its pairs, and large cells are cut into
tiles, so neither a hot text nor a dense group lands in one task.

Defined cases: a null text counts as empty; a text of fewer words than a shingle is one shingle; a text without words
has fingerprint zero and links like any other. Rows with a null doc_id get a fingerprint and link others, but never
name a component (component_id is null where a component has no id at all). Repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import Stored, components, forest, stored

SEED = 42
TILE = 16384
RADIUS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    h, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return h(norm, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    hashes = np.array([h(norm[s:e], SEED) for s, e in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp) for each row; th is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def half_counts(fp: str = "fp"):
    """Population counts of the upper and the lower half."""
    c = F.col(fp)
    return F.bit_count(F.shiftrightunsigned(c, 32)), F.bit_count(c.bitwiseAND(F.lit(0xFFFFFFFF)))


def close_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span every group of distinct fingerprints (column fp) within the radius of each other."""
    spark = fps.sparkSession
    hi, lo = half_counts()
    cells = fps.select("fp", hi.alias("hi"), lo.alias("lo"))
    # At most 33 x 33 rows whatever the input is.
    counts = {(r.hi, r.lo): r["count"] for r in cells.groupBy("hi", "lo").count().collect()}
    tiles = {c: -(-n // tile) for c, n in counts.items()}
    ahead = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) > (0, 0)]
    rows = []
    for (h, l), own in tiles.items():
        beside = [(h + i, l + j) for i, j in ahead if (h + i, l + j) in tiles]
        # As the left side against each tile of its own and the cells ahead, and as the right side of the cells behind.
        rows.append((h, l, h * 64 + l, True, own, max([own, *(tiles[c] for c in beside)])))
        rows += [(h, l, g * 64 + m, False, own, tiles[g, m]) for g, m in [(h, l)] + [(h - i, l - j) for i, j in ahead if (h - i, l - j) in tiles]]
    if not rows:
        return spark.createDataFrame([], "a long, b long")
    plan = spark.createDataFrame(rows, "hi int, lo int, cell int, left boolean, own int, times int")
    mine = F.pmod(F.xxhash64("fp"), F.col("own")).cast("int")
    sent = cells.join(F.broadcast(plan), ["hi", "lo"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    dealt = sent.select("cell", F.when(F.col("left"), F.col("mine")).otherwise(F.col("other")).alias("ta"), F.when(F.col("left"), F.col("other")).otherwise(F.col("mine")).alias("tb"), "left", "fp")

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        quarter = lambda x: np.bitwise_count(x >> np.uint64(48)).astype(np.int64)
        a, b = fp[left], fp[~left]
        a, b = a[np.argsort(quarter(a), kind="stable")], b[np.argsort(quarter(b), kind="stable")]
        qa, qb = quarter(a), quarter(b)
        xs, ys, held = [], [], 0
        for k in range(0, len(a), 64):
            part = a[k : k + 64]
            lo_b, hi_b = np.searchsorted(qb, qa[k] - radius), np.searchsorted(qb, qa[min(k + 63, len(a) - 1)] + radius, "right")
            for m in range(lo_b, hi_b, 4096):
                other = b[m : min(m + 4096, hi_b)]
                i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
                x, y = part[i], other[j]
                keep = x != y
                xs.append(x[keep])
                ys.append(y[keep])
                held += int(keep.sum())
                if held > 200_000:
                    x, y = forest(np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64))
                    xs, ys, held = [x.view(np.uint64)], [y.view(np.uint64)], len(x)
        if held:
            x, y = forest(np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64))
        else:
            x = y = np.empty(0, np.int64)
        return pa.table({"a": x, "b": y})

    return dealt.groupBy("cell", "ta", "tb").applyInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, tile: int) -> DataFrame:
    """doc_id, th, fp, component_id and group (a fingerprint that names the component) for each row of docs."""
    own = stored(fingerprints(docs, shingle))
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = Stored(close_links(fps.select("fp"), radius, tile))
    group = components(links.df)
    named = fps.join(group.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "first_id")
    first = named.groupBy("component").agg(F.min("first_id").alias("low"))
    linked = named.join(first, "component").select("fp", "low", "component")
    per_fp = fps.join(linked, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("group"))
    return own.join(per_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row of docs."""
    found = _grouped(docs, shingle, radius, tile)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, and of the texts of that id the one of the smallest fingerprint.

    Rows without an id give way to those that have one; of a component of such rows alone one stays.
    """
    found = _grouped(docs, shingle, radius, TILE).where("doc_id = component_id or component_id is null")
    first = found.groupBy("group", "doc_id").agg(F.min(F.struct("fp", "th")).alias("low")).select(F.col("doc_id").alias("kept_id"), F.coalesce("low.th", F.lit(0)).alias("kept_th"))
    th = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    marked = docs.select(F.struct("*").alias("row"), th.alias("th"), F.col("doc_id").cast("long").alias("id"))
    kept = marked.join(first, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left_semi").dropDuplicates(["id", "th"])
    return kept.select("row.*")
