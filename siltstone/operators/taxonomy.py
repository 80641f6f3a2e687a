"""A taxonomy of tags, folders and document types: validation, aliases, usage, search, prompts.

Entries: id (kind:name), kind, name, description, aliases (array), status, usage_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings of the kinds in prompts, in their order.
HEADINGS = {"tag": "Tags", "folder": "Folders", "doc_type": "Document Types"}


def validate_tags(items: DataFrame, taxonomy: DataFrame, tag: str = "tag") -> DataFrame:
    """Adds known: whether the taxonomy has the tag."""
    have = taxonomy.where("kind = 'tag'").select(F.col("name").alias(tag), F.lit(True).alias("known")).distinct()
    return items.join(have, tag, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def suggest_folder(items: DataFrame, taxonomy: DataFrame, folder: str = "folder") -> DataFrame:
    """Adds suggested: the folder as the taxonomy names it, exactly or with a slash at its end, else null."""
    have = taxonomy.where("kind = 'folder'").select("name").distinct()
    exact = have.select(F.col("name").alias(folder), F.col("name").alias("_e"))
    slash = have.where(F.endswith("name", F.lit("/"))).select(F.regexp_replace("name", "/$", "").alias(folder), F.col("name").alias("_s"))
    return items.join(exact, folder, "left").join(slash, folder, "left").withColumn("suggested", F.coalesce("_e", "_s")).drop("_e", "_s")


def alias_map(taxonomy: DataFrame, kind: str) -> DataFrame:
    """(alias, canonical) of one kind in lower case; a name wins over an alias, and among aliases the smallest name."""
    own = taxonomy.where(F.col("kind") == kind)
    names = own.select(F.lower("name").alias("alias"), "name", F.lit(0).alias("rank"))
    also = own.select(F.explode("aliases").alias("alias"), "name").select(F.lower(F.trim("alias")).alias("alias"), "name", F.lit(1).alias("rank"))
    return names.unionByName(also).where("alias <> ''").groupBy("alias").agg(F.min(F.struct("rank", "name")).alias("b")).select("alias", F.col("b.name").alias("canonical"))


def resolve(items: DataFrame, taxonomy: DataFrame, kind: str, names: str = "names", key: str = "id") -> DataFrame:
    """(key, resolved): arrays of names by their canonical ones, in order, without repeats; unknown names stay."""
    each = items.select(key, F.posexplode_outer(names).alias("at", "raw")).withColumn("alias", F.lower(F.trim("raw")))
    done = each.join(alias_map(taxonomy, kind), "alias", "left").withColumn("to", F.coalesce("canonical", "raw"))
    listed = done.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("at", "to")))).alias("l"))
    return listed.select(key, F.array_distinct(F.transform("l", lambda x: x["to"])).alias("resolved"))


def count_usage(taxonomy: DataFrame, uses: DataFrame) -> DataFrame:
    """The taxonomy with usage_count raised by the uses (id) of its own entries."""
    delta = uses.groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    return taxonomy.join(delta, "id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_d", F.lit(0))).select(*taxonomy.columns)


def listed(taxonomy: DataFrame, kind: str | None = None, status: str | None = "active", most: int = 1000) -> DataFrame:
    for c, v in (("kind", kind), ("status", status)):
        taxonomy = taxonomy if v is None else taxonomy.where(F.col(c) == v)
    return taxonomy.orderBy("kind", "name").limit(most)


def prompt(taxonomy: DataFrame) -> DataFrame:
    """One row (text): active entries by kind under headings, sorted by name; a taxonomy is small, and so is its prompt."""
    line = F.concat(F.lit("- "), "name", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.substring("description", 1, 80))).otherwise(""))
    order = F.create_map(*[F.lit(x) for k, (kind, _) in enumerate(HEADINGS.items()) for x in (kind, k)])
    head = F.create_map(*[F.lit(x) for kind, h in HEADINGS.items() for x in (kind, f"## Available {h}")])
    own = taxonomy.where((F.col("status") == "active") & F.col("kind").isin(list(HEADINGS)))
    blocks = own.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    whole = F.array_sort(F.collect_list(F.struct(order[F.col("kind")].alias("o"), F.concat(head[F.col("kind")], F.lit("\n"), "b").alias("b"))))
    return blocks.agg(F.array_join(F.transform(whole, lambda x: x["b"]), "\n\n").alias("text"))


def upsert(taxonomy: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of the same id."""
    return taxonomy.join(entries.select("id"), "id", "left_anti").select(*taxonomy.columns).unionByName(entries.select(*taxonomy.columns))


def seed(taxonomy: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries are added where their id is not there yet."""
    return taxonomy.unionByName(entries.dropDuplicates(["id"]).join(taxonomy.select("id"), "id", "left_anti").select(*taxonomy.columns))


def read_sqlite(spark, path: str, query: str, kind: str) -> DataFrame:
    """Entries from a query (name, description, aliases as a comma-list) on a SQLite file of the driver; a taxonomy is small."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        rows = [(f"{kind}:{n}", kind, n, text or "", [a.strip() for a in (aliases or "").split(",") if a.strip()], "active", 0) for n, text, aliases in c.execute(query)]
    return spark.createDataFrame(rows, "id string, kind string, name string, description string, aliases array<string>, status string, usage_count long")
