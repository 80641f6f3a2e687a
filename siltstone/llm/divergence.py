"""How far the sources of a language stand apart in their words: chi-square sums over all pairs of sources, and each source's telling terms.

Terms are counted once. A language keeps the terms that at least LEAST of its documents have. Over its kept terms each source, and the
language itself, has whole-number shares p = 1 + floor(SCALE * (count + 1) / (N + V)), and a term adds floor((p - q)^2 / q). All of it is exact.

The sum over pairs of sources is split by how many sources have a term. Heavy terms (in over FEW sources, or in a quarter of the
language's sources) go to dense tiles: the sources' shares as numpy matrices, every pair at once. For light terms the sum is
what it would be if no source had them, plus what a source changes that has one (which depends on its count alone, so terms of
equal count are taken together), plus a correction for each pair of postings of a term, at most FEW squared. The partial sums
of tiles and postings are added.

Sources are dealt into blocks of SIDE and terms into blocks of about TILE, so a tile is bounded; words are counted within the rows and combined before
any shuffle, and the ranking by source keeps its best of each task before rows are moved.

Defined cases: null text, language and source are ''; repeated rows are documents of their own; a language without kept terms has
value 0 for each pair; a lone source has no pairs; equal values are ranked by the item's UTF-8; an empty table has no
rows. Ids are not read, nor are other columns. Texts of any length are counted whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siltstone.llm.shared import stored

LEAST, SCALE, RANKS = 3, 1_000_000_000, 200
FEW, SIDE, TILE = 32, 256, 2048
#: Bytes of text that are counted at once.
AT_ONCE = 8 << 20
#: Letters of ASCII in lower case, all other signs of it as blanks, bytes beyond it as they are.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, df long"


def _counted(langs: pa.Array, sources: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    """Occurrences and documents of each term by language and source."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.large_string()))
    doc, words = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split).dictionary_encode()
    terms, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if (blank := pc.index(terms, "").as_py()) >= 0:
        doc, code = doc[code != blank], code[code != blank]
    m = max(1, len(terms))
    own, n = np.unique(doc.astype(np.int64) * m + code, return_counts=True)
    pair = pa.StructArray.from_arrays([langs, sources], ["lang", "source"])
    keys: dict = {}
    group = np.array([keys.setdefault(x, len(keys)) for x in zip(langs.to_pylist(), sources.to_pylist(), strict=True)], np.int64)
    first = np.unique(group, return_index=True)[1]
    at, back = np.unique(group[own // m] * m + own % m, return_inverse=True)
    total, df = np.zeros(len(at), np.int64), np.bincount(back, minlength=len(at)).astype(np.int64)
    np.add.at(total, back, n)
    of = pair.take(pa.array(first[at // m]))
    return pa.RecordBatch.from_arrays([of.field(0), of.field(1), terms.take(pa.array(at % m)).cast(pa.string()), pa.array(total), pa.array(df)], ["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents."""

    def run(batches):
        for b in batches:
            start, size, texts = 0, 0, []
            for k, t in enumerate(b.column(2)):
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE))
                size += len(texts[-1])
                if size >= at_once or k + 1 == b.num_rows:
                    yield _counted(b.column(0).slice(start, len(texts)), b.column(1).slice(start, len(texts)), texts)
                    start, size, texts = k + 1, 0, []

    each = docs.select(_named("lang"), _named("source"), F.col("text").cast("string").alias("text"))
    return each.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a / b."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a term; 1 where a language has no terms."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.coalesce(1 + _whole(wide, F.nullif(total + terms, F.lit(0).cast("long"))), F.lit(1).cast("long"))


def apart(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), q)


class Shares:
    """kept: (lang, source, term, n, lang_n, m) of the kept terms, m being the sources that have one; groups: (lang, source, gid, s, total, v, base).

    gid numbers the sources of a language, s is how many there are, v the number of kept terms, base the share of a term that a source lacks.
    """

    def __init__(self, docs: DataFrame):
        by = W.partitionBy("lang", "term")  # no more rows than a language has sources
        every = term_counts(docs).withColumns({"lang_df": F.sum("df").over(by), "lang_n": F.sum("n").over(by), "m": F.count(F.lit(1)).over(by), "first": F.min("source").over(by)})
        self.kept = stored(every.where(F.col("lang_df") >= LEAST).select("lang", "source", "term", "n", "lang_n", "m", (F.col("first") == F.col("source")).alias("first")))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        own = self.kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
        named = docs.select(_named("lang"), _named("source")).distinct()
        g = named.join(totals, ["lang", "source"], "left").join(own, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
        beside = W.partitionBy("lang")
        g = g.withColumns({"gid": F.row_number().over(beside.orderBy("source")) - 1, "s": F.count(F.lit(1)).over(beside)})
        self.groups = stored(g.withColumn("base", share(F.lit(0), F.col("total"), F.col("v"))))

    def telling_terms(self, ranks: int = RANKS) -> DataFrame:
        """(lang, source, item, value, rank): terms that a source has more of than its language."""
        x = self.kept.join(self.groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
        x = x.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
        x = x.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return x.withColumn("rank", rank).where(F.col("rank") <= ranks)

    def pair_sums(self, few: int = FEW, side: int = SIDE, tile: int = TILE) -> DataFrame:
        """(lang, gid, other, value) for each two sources of a language."""
        g = self.groups.select("lang", "source", "gid", "s", "total", "v", "base")
        x = self.kept.join(g, ["lang", "source"]).select("lang", "term", "gid", "s", "m", "base", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
        heavy = (F.col("m") > few) | (4 * F.col("m") >= F.col("s"))
        # What a language has: tiles of terms and light terms.
        many = self.kept.where("first").join(self.groups.select("lang", "s").distinct(), "lang").groupBy("lang").agg(F.count_if(heavy).alias("heavy"), F.count_if(~heavy).alias("light"))
        sizes = stored(self.groups.select("lang", "s").distinct().join(many, "lang", "left").na.fill(0, ["heavy", "light"]).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("heavy") / tile)).cast("int")))
        dense = x.where(heavy).select("lang", "gid", F.lit("dense").alias("kind"), "term", "p", F.lit(0).cast("long").alias("times"), F.xxhash64("term").alias("deal"))
        light = x.where(~heavy)
        single = light.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("times")).select("lang", "gid", F.lit("single").alias("kind"), F.lit("").alias("term"), "p", "times", F.xxhash64("p").alias("deal"))
        rows = dense.unionByName(single).join(sizes.select("lang", "s", "tiles"), "lang").withColumn("tile", F.pmod("deal", F.col("tiles")).cast("int")).drop("deal", "tiles")
        # A tile also stands for terms that none of its sources has; the first one for all light terms.
        held = self.kept.where("first").join(sizes.select("lang", "s", "tiles"), "lang").where(heavy).groupBy("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile")).agg(F.count(F.lit(1)).alias("held"))
        each = g.join(sizes.select("lang", "light", "tiles"), "lang").select("lang", "gid", "base", "s", "light", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).join(held, ["lang", "tile"], "left")
        stands = F.coalesce("held", F.lit(0)) + F.when(F.col("tile") == 0, F.col("light")).otherwise(0)
        bases = each.select("lang", "gid", F.lit("base").alias("kind"), F.lit("").alias("term"), F.col("base").alias("p"), stands.alias("times"), "s", "tile")
        own = F.floor(F.col("gid") / side).cast("int")
        blocks = F.sequence(F.lit(0), F.floor((F.col("s") - 1) / side).cast("int"))
        sides = F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.array(F.struct(own.alias("i"), b.alias("j")), F.struct(b.alias("i"), own.alias("j"))))))
        dealt = rows.unionByName(bases).withColumn("at", F.explode(sides)).select("lang", "at.i", "at.j", "tile", "gid", "kind", "term", "p", "times")
        tiles = dealt.groupBy("lang", "i", "j", "tile").applyInPandas(lambda pdf: _tile(pdf, side), "lang string, gid int, other int, value long")
        # Two postings of a light term: what it is less what was counted for each of them alone.
        posts = light.where("m > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "base")).alias("a"))
        pairs = F.flatten(F.transform("a", lambda u: F.transform(F.filter("a", lambda w: w["gid"] != u["gid"]), lambda w: F.struct(u.alias("u"), w.alias("w")))))
        posted = posts.select("lang", F.explode(pairs).alias("e"))
        f = lambda a, b: apart(F.col(f"e.u.{a}"), F.col(f"e.w.{b}"))
        both = posted.select("lang", F.col("e.u.gid").alias("gid"), F.col("e.w.gid").alias("other"), (f("p", "p") - f("p", "base") - f("base", "p") + f("base", "base")).alias("value"))
        return tiles.unionByName(both).groupBy("lang", "gid", "other").agg(F.sum("value").alias("value"))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _tile(pdf: pd.DataFrame, side: int) -> pd.DataFrame:
    """Sums over a tile's heavy terms and over its single postings, for each source of block i against each of block j."""
    lang, i, j = (pdf[c].iloc[0] for c in ("lang", "i", "j"))
    base = pdf[pdf.kind == "base"].sort_values("gid")
    gid, base_p, stands = base.gid.to_numpy(), base.p.to_numpy(np.int64), int(base.times.iloc[0])
    left, right = np.flatnonzero(gid // side == i), np.flatnonzero(gid // side == j)
    dense = pdf[pdf.kind == "dense"]
    code, terms = pd.factorize(dense.term)
    p = np.repeat(base_p[:, None], len(terms), axis=1)
    p[np.searchsorted(gid, dense.gid.to_numpy()), code] = dense.p.to_numpy(np.int64)
    single = pdf[pdf.kind == "single"]
    of, sp, times = np.searchsorted(gid, single.gid.to_numpy()), single.p.to_numpy(np.int64), single.times.to_numpy(np.int64)
    order = np.argsort(of, kind="stable")
    of, sp, times = of[order], sp[order], times[order]
    edge = np.searchsorted(of, np.arange(len(gid) + 1))
    out = np.zeros((len(left), len(right)), np.int64)
    q0 = base_p[right]
    here = np.isin(of, right)  # postings of the right block, summed up by source
    to = np.searchsorted(right, of[here])
    for k, s in enumerate(left):
        none = _apart(base_p[s], q0)
        out[k] = _apart(p[s], p[right]).sum(axis=1) + (stands - len(terms)) * none
        own = slice(edge[s], edge[s + 1])
        out[k] += (times[own, None] * (_apart(sp[own, None], q0) - none)).sum(axis=0)
        np.add.at(out[k], to, times[here] * (_apart(base_p[s], sp[here]) - none[to]))
    a, b = np.meshgrid(gid[left], gid[right], indexing="ij")
    other = a != b
    return pd.DataFrame({"lang": lang, "gid": a[other], "other": b[other], "value": out[other]})


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank: all other sources of each source, and its telling terms to rank RANKS."""
    shares = Shares(docs)
    name = lambda gid, c: shares.groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(c))
    pairs = shares.pair_sums().join(name("gid", "source"), ["lang", "gid"]).join(name("other", "item"), ["lang", "other"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = shares.telling_terms().select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
