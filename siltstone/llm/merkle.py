"""Merkle manifest of a dataset with coordinate lookup proofs.

A row is a leaf: the SHA-256 of its fields. The leaves of a group (a language) stand in the order of their id; runs of 2 ** SHIFT
nodes become one node, level after level, until one is left, the group's subroot. Subroots, in the order of the groups, are
the leaves of one more tree, whose last node is the root.

A node's place is (tree, level, idx), so which siblings a leaf's proof needs follows from its index and the size of its group alone. Each leaf
explodes these coordinates, they are joined with the stored table of nodes, put in order, concatenated and folded up to
the root. Nodes of level k are asked for by 7 * 8 ** k leaves: levels of at most NODES nodes, which is counted, are broadcast, and
the lower ones are shuffled, where no node is asked for by more than about one leaf in 900.

Digests travel as 32 bytes and are put together as lower-case hexadecimal text. Texts are read once, where leaves are made, and never move.

Defined cases: each null field is "-"; a null id or group comes first; rows of equal id follow each other by their leaf, so equal rows
are leaves of their own, side by side; an empty text is "0:"; texts of any length are one value; a lone leaf is its tree's subroot and a lone subroot is
the root; the proof of a leaf without siblings is the SHA-256 of nothing; an empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import Stored, lower_ascii, stored
from siltstone.operators.numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A run has 2 ** SHIFT nodes.
SHIFT = 3
#: Levels of so many nodes at most are broadcast (about 6 MB).
NODES = 100_000
#: The number of the tree of subroots.
TOP = -1


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(h: Column) -> Column:
    return F.lower(F.hex(h))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field's byte count, a colon and the value, or "-"."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(F.concat(*parts))


def _up(c: Column, levels: Column) -> Column:
    """The index of what stands so many levels above."""
    return F.call_function("shiftright", c, (levels * SHIFT).cast("int"))


def _depth(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n >> SHIFT), d + 1
    return d


def depth(n: Column, most: int) -> Column:
    """Levels above n leaves, of `most` at most."""
    out = F.lit(0)
    for k in range(most):
        out = out + (n > F.lit(1 << SHIFT * k)).cast("int")
    return out


class Manifest:
    """Leaves, nodes, groups and the root of a table, stored in the shared folder.

    leaves: (tree, idx, id, leaf, other); trees: (tree, grp, n, levels, subroot); nodes: (tree, level, idx, h).
    """

    def __init__(self, rows: DataFrame):
        """rows: (id, grp, leaf, other), of which other is carried along."""
        at = numbered(rows, ["id", "leaf"], ["grp"], keep=stored)
        sizes = stored(at.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
        trees = stored(numbered(sizes, ["grp"], name="tree", keep=stored))
        told = trees.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m")).first()
        self.below, self.above = _depth(told["n"] or 0), _depth(told["m"])
        trees = trees.withColumn("levels", depth(F.col("n"), self.below))
        met = at.join(trees.select(F.col("grp").alias("g"), "tree"), F.col("grp").eqNullSafe(F.col("g")))
        self.leaves = stored(met.select("tree", "idx", "id", "leaf", "other"))
        # One row of numbers: nodes by level.
        per = lambda n, k: F.when((F.lit(k) == 0) | (n > F.lit(1 << SHIFT * max(0, k - 1))), F.ceil(n / F.lit(float(1 << SHIFT * k))))
        counts = trees.agg(*[F.sum(per(F.col("n"), k)).alias(str(k)) for k in range(self.below + 1)]).first()
        self.sizes = [int(c or 0) for c in counts]
        levels = [self.leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("h"))]
        for k in range(self.below):
            # A tree ends with its single node.
            more = levels[-1].join(trees.where(F.col("levels") > k).select("tree"), "tree", "left_semi")
            levels.append(stored(self._runs(more, k + 1)))
        ends = None
        for k, n in enumerate(levels):
            own = n.join(trees.where(F.col("levels") == k).select("tree", "grp", "n", "levels"), "tree").select("tree", "grp", "n", "levels", F.col("h").alias("subroot")).where("idx = 0")
            ends = own if ends is None else ends.unionByName(own)
        self.trees = stored(ends)
        upper = [self.trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("h"))]
        for k in range(self.above):
            upper.append(stored(self._runs(upper[-1], k + 1)))
        one = upper[-1].select(hexed(F.col("h")).alias("h")).first()
        self.root = one["h"] if one else None
        self.of_level, self.of_top, self.m = levels, upper, told["m"]

    @staticmethod
    def _runs(nodes: DataFrame, level: int) -> DataFrame:
        run = nodes.groupBy("tree", F.shiftright("idx", SHIFT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("r"))
        text = F.array_join(F.transform("r", lambda x: hexed(x["h"])), "")
        return run.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), digest(text).alias("h"))

    @property
    def nodes(self) -> DataFrame:
        """All nodes, also those of the tree of subroots (TOP)."""
        out = self.of_level[0]
        for n in [*self.of_level[1:], *self.of_top]:
            out = out.unionByName(n)
        return out

    def _siblings(self, tree: Column, idx: Column, n: Column, levels: Column, most: int, first: Column, trees: Column) -> Column:
        """Coordinates (step, tree, level, idx) of what a leaf's proof needs in one tree; step counts from `first`."""

        def of(k):
            own = _up(idx, k)
            low = F.call_function("shiftleft", _up(own, F.lit(1)), F.lit(SHIFT))
            last = F.least(low + ((1 << SHIFT) - 1), _up(n - 1, k))
            beside = F.filter(F.sequence(low, last), lambda q: q != own)
            return F.transform(beside, lambda q: F.struct((first + k).cast("int").alias("step"), trees.cast("long").alias("tree"), k.cast("int").alias("level"), q.alias("idx")))

        every = F.array(*[F.lit(k) for k in range(most)]) if most else F.array().cast("array<int>")
        return F.flatten(F.transform(F.filter(every, lambda k: k < levels), of))

    def proofs(self) -> DataFrame:
        """(tree, idx, id, leaf, other, grp, subroot, levels, siblings) of each leaf; siblings: (step, idx, h) by step and place, step counts the levels from the leaf up."""
        at = self.leaves.join(self.trees.select("tree", "grp", "n", "levels", "subroot"), "tree")
        m, top = F.lit(self.m).cast("long"), F.lit(self.above)
        low = self._siblings(F.col("tree"), F.col("idx"), F.col("n"), F.col("levels"), self.below, F.lit(0), F.col("tree"))
        high = self._siblings(F.lit(TOP), F.col("tree"), m, top, self.above, F.col("levels"), F.lit(TOP))
        asked = at.select("tree", "idx", F.explode(F.concat(low, high)).alias("c")).select(F.col("tree").alias("t"), F.col("idx").alias("i"), "c.*")
        small = [k for k in range(self.below + 1) if self.sizes[k] <= NODES]
        found = None
        for few in (False, True):
            own = [n for k, n in enumerate(self.of_level) if (k in small) == few] + [n for n in self.of_top if (self.m <= NODES) == few]
            if not own:
                continue
            table = own[0]
            for n in own[1:]:
                table = table.unionByName(n)
            here = F.when(F.col("tree") == TOP, F.lit(self.m <= NODES)).otherwise(F.col("level").isin(small) if small else F.lit(False))
            got = asked.where(here == F.lit(few)).join(F.broadcast(table) if few else table, ["tree", "level", "idx"]).select("t", "i", F.struct("step", "idx", "h").alias("s"))
            found = got if found is None else found.unionByName(got)
        lists = found.groupBy(F.col("t").alias("tree"), F.col("i").alias("idx")).agg(F.sort_array(F.collect_list("s")).alias("siblings"))
        none = F.array().cast("array<struct<step:int,idx:bigint,h:binary>>")
        return at.join(lists, ["tree", "idx"], "left").withColumn("siblings", F.coalesce("siblings", none))

    def fold(self, start: Column) -> Column:
        """The root that a leaf `start` (its digest) and the siblings of a row of proofs() lead to, as hexadecimal text."""
        sibs = F.transform("siblings", lambda s: F.struct(s["step"].alias("step"), s["idx"].alias("idx"), hexed(s["h"]).alias("h")))
        every = F.array(*[F.lit(k) for k in range(self.below + self.above)]) if self.below + self.above else F.array().cast("array<int>")
        levels, idx, tree = F.col("levels"), F.col("idx"), F.col("tree")

        def up(acc, k):
            own = F.when(k < levels, _up(idx, k)).otherwise(_up(tree, k - levels))
            side = lambda a, c: F.array_join(F.transform(F.filter(a, c), lambda s: s["h"]), "")
            run = F.filter(acc["s"], lambda s: s["step"] == k)
            text = F.concat(side(run, lambda s: s["idx"] < own), acc["h"], side(run, lambda s: s["idx"] > own))
            return F.struct(F.sha2(text, 256).alias("h"), acc["s"].alias("s"))

        steps = F.filter(every, lambda k: k < levels + self.above)
        return F.aggregate(steps, F.struct(hexed(start).alias("h"), sibs.alias("s")), up, lambda acc: acc["h"])


def rows(docs: DataFrame, by: str = "lang", fields: Sequence[str] = FIELDS, key: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, grp, leaf, other): the leaf of each row of docs, and where `where` holds its leaf with the fields of `tampered` in place of its own."""
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*fields, by, key])])
    other = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    changed = F.when(where, other) if where is not None else F.lit(None).cast("binary")
    return base.select(F.col(key).alias("id"), F.col(by).alias("grp"), leaf([F.col(c) for c in fields]).alias("leaf"), changed.alias("other"))


def lookup_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; where 3 divides the CRC-32 of the id the text is taken as tampered with (in lower case) and folded so."""
    third = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False))
    made = stored(rows(docs, tampered={"text": lower_ascii(F.col("text"))}, where=third))
    manifest = Manifest(made)
    p = manifest.proofs()
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: hexed(s["h"])), ""), 256)
    root = F.lit(manifest.root).cast("string")
    out = p.select(F.col("id").cast("long").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), manifest.fold(F.coalesce("other", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
