"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors of one label count once, with their number of copies as a weight. Each distinct vector is signed by
`bits` random hyperplanes in each of several tables; vectors that share a label and the signs of a table meet there. The bits
grow with the logarithm of a label's vectors, so that a bucket has about BUCKET of them, and the tables with the bits, so that
the chance to miss a pair stays below MISS at any size.
A bucket is compared tile by tile in numpy with cosines in double precision, so no link is below the threshold. A pair
counts in the first table in which its signs agree, and for each vector a tile gives a number of links and a spanning
forest, never the list of pairs: a bucket of near copies costs arithmetic but no quadratic output. Large buckets are cut into tiles
that are compared in tasks of their own.

At cosine 0.98 a hyperplane parts a pair with probability 0.064, so a table of b bits finds it with 0.936**b, and t tables
miss it with (1 - 0.936**b)**t; nearer pairs are missed less often.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing (component_id is their own vec_id). Vectors of different lengths do not link. Rows with a null vec_id give a row without links. Repeated
vec_ids are separate rows; each counts the other vectors, copies of its id included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import Stored, components, forest, stored

THRESHOLD = 0.98
BUCKET = 512
MISS = 1e-9
TILE = 2048
SEED = 20177


def tables_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many tables of so many bits miss a pair at the threshold less often than `miss`."""
    found = (1 - np.arccos(threshold) / np.pi) ** bits
    return 1 if bits == 0 else int(np.ceil(np.log(miss) / np.log(1 - found)))


def _signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The key of each row in each table."""
    if not bits:
        return np.zeros((len(x), tables), np.int32)
    planes = np.random.default_rng([seed, x.shape[1], bits]).standard_normal((x.shape[1], bits * tables))
    on = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stored(base.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("same", F.when(F.col("ok"), F.sha2(F.concat_ws(",", "label", F.col("v").cast("array<string>")), 256))))
    one = stored(rows.where("ok").groupBy("same").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))

    dim = F.size("v").alias("dim")
    sizes = one.groupBy("label", dim).agg(F.count(F.lit(1)).alias("m")).select("label", "dim", F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("m") / bucket)))).cast("int").alias("bits"))
    sized = one.select("id", "n", "label", "v", dim).join(sizes, ["label", "dim"]).select("id", "n", "label", "v", "bits")

    def sign(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(3)
            size, bits = np.diff(lists.offsets.to_numpy()), b.column(4).to_numpy()
            for d, k in sorted(set(zip(size.tolist(), bits.tolist(), strict=True))):
                at = pa.array(np.flatnonzero((size == d) & (bits == k)))
                sub = lists.take(at)
                x = sub.flatten().to_numpy().reshape(len(at), d)
                tables = tables_for(k, threshold)
                keys = _signs(x / np.abs(x).max(axis=1, keepdims=True), k, tables, seed)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(at), b.column(1).take(at), b.column(2).take(at), sub, codes], ["id", "n", "label", "v", "codes"])

    signed = stored(sized.mapInArrow(sign, "id long, n long, label string, v array<double>, codes array<int>"))
    keyed = signed.select("id", "n", "label", "v", "codes", F.posexplode("codes").alias("t", "key")).withColumn("dim", F.size("v"))
    sizes = keyed.groupBy("label", "dim", "t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    met = keyed.join(sizes, ["label", "dim", "t", "key"])
    mine = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = met.select("label", "dim", "t", "key", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), (F.col("mine") <= F.col("other")).alias("left"), "id", "n", "v", "codes")

    def compare(group: pa.Table) -> pa.Table:
        t, dim = group.column("t")[0].as_py(), group.column("dim")[0].as_py()
        own = group.column("ta")[0].as_py() == group.column("tb")[0].as_py()
        n, ids, left = group.column("n").to_numpy(), group.column("id").to_numpy(), group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        x = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        codes = group.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        b = np.arange(len(ids)) if own else np.flatnonzero(~left)
        links = np.zeros(len(ids), np.int64)
        xs, ys, held = [], [], 0
        side = b if own else np.flatnonzero(left)
        for k in range(0, len(side), 256):
            i = side[k : k + 256]
            p, q = np.nonzero(x[i] @ x[b].T >= threshold)
            p, q = i[p], b[q]
            fresh = (p < q) if own else np.ones(len(p), bool)
            if t:  # seen in an earlier table?
                fresh &= ~(codes[p, :t] == codes[q, :t]).any(axis=1)
            p, q = p[fresh], q[fresh]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            xs.append(ids[p])
            ys.append(ids[q])
            held += len(p)
            if held > 1_000_000:
                u, w = forest(np.concatenate(xs), np.concatenate(ys))
                xs, ys, held = [u], [w], len(u)
        u, w = forest(np.concatenate(xs), np.concatenate(ys)) if held else (np.empty(0, np.int64),) * 2
        some = np.flatnonzero(links)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(u), pa.array(ids[some])]), "b": pa.concat_arrays([pa.array(w), none(len(some))]), "links": pa.concat_arrays([none(len(u)), pa.array(links[some])])})

    out = stored(dealt.groupBy("label", "dim", "t", "key", "ta", "tb").applyInArrow(compare, "a long, b long, links long"))
    per_one = out.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    group = components(out.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    known = one.select("same", "id", "n").join(per_one, "id", "left").join(group, "id", "left").select("same", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    full = rows.select("vec_id", "same").join(known, "same", "left")
    return full.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))
