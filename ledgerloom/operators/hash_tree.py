"""Digest of a whole table as an ordered hash tree: equal content has one root, however rows are ordered, repeated runs are partitioned, or many there are.

A row is known by its identity and stands for its values, each with its type: so 1 as a number, as text and as a duration
differ, 2.50 and 2.5 don't. The SHA-256 of the identity says where the row lies: its first six hex digits name a bucket, its first four and two the nodes above,
of which each digests its children in order. The shape depends on nothing but identities, so a changed row changes only its
bucket and the nodes above, and two tables are compared by going down where their digests differ (``differences``); trees are saved in
folders by the first two digits, and only folders of changed branches are read.

Scale: one shuffle of digests (not of values) by bucket, then tables of at most 16 million, 65,536 and 256 rows. A bucket holds a row in 16 million: about 600 of ten billion.

Identities are unique: ``root`` refuses a table in which one repeats. An empty table has the digest of no children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from .components import cut

#: Digits of the nodes' prefixes, from the buckets up to the root.
DIGITS = (6, 4, 2, 0)


def tagged(name: str, kind: T.DataType) -> Column:
    """A value as ``name=TAG:bytes:text``, by its type."""
    c = F.col(name)
    if isinstance(kind, T.DecimalType):
        tag, text = "DECIMAL", exact.text_of(c)
    elif isinstance(kind, T.TimestampType):
        tag, text = "DATETIME", exact.instant_of(c)
    elif isinstance(kind, T.DayTimeIntervalType):
        tag, text = "DURATION", F.expr(f"cast(extract(day from `{name}`) * 86400000000 + extract(hour from `{name}`) * 3600000000 + extract(minute from `{name}`) * 60000000 + cast(extract(second from `{name}`) * 1000000 as bigint) as string)")
    elif isinstance(kind, T.BooleanType):
        tag, text = "BOOLEAN", c.cast("string")
    elif isinstance(kind, T.IntegralType):
        tag, text = "INTEGER", c.cast("string")
    elif isinstance(kind, T.StringType):
        tag, text = "TEXT", c
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        item = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
        tag, text = "LIST", F.when(c.isNotNull(), F.concat_ws("", F.transform(c, item)))
    else:
        raise ValueError(f"column {name} of type {kind.simpleString()} has no canonical form")
    held = F.concat(F.lit(f"{name}={tag}:"), F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(held, F.lit(f"{name}=NULL:0:"))


@dataclass
class Tree:
    """leaves: the identity's columns, key, leaf. nodes: digits, prefix, digest, n (rows below), n_again (rows whose identity another row has too)."""

    leaves: DataFrame
    nodes: DataFrame
    identity: list[str]


def tree(rows: DataFrame, identity: list[str], columns: list[str] | None = None) -> Tree:
    """The tree of ``rows``, by ``identity`` and all other columns (or those of ``columns``), in order of their names."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    others = sorted(columns if columns is not None else [c for c in rows.columns if c not in identity])
    digest = lambda names: F.sha2(F.concat_ws("\n", *(tagged(c, kinds[c]) for c in names)), 256)
    leaves = cut(rows.select(*identity, digest(sorted(identity)).alias("key"), digest(others).alias("leaf")))
    pairs = F.array_sort(F.collect_list(F.struct("key", "leaf")))
    level = leaves.groupBy(F.substring("key", 1, DIGITS[0]).alias("prefix")).agg(pairs.alias("held"), F.count_distinct("key").alias("keys"))
    line = F.concat_ws("", F.transform("held", lambda x: F.concat(x["key"], x["leaf"])))
    level = level.select(F.lit(DIGITS[0]).alias("digits"), "prefix", F.sha2(line, 256).alias("digest"), F.size("held").cast("bigint").alias("n"), (F.size("held") - F.col("keys")).alias("n_again"))
    levels = [cut(level)]
    for digits in DIGITS[1:]:
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        # the root is there even if no row is
        groups = levels[-1].groupBy(F.substring("prefix", 1, digits).alias("up")) if digits else levels[-1].withColumn("up", F.lit("")).groupBy()
        up = F.col("up") if digits else F.lit("").alias("up")
        none = F.lit(0).cast("bigint")
        level = groups.agg(children.alias("held"), F.coalesce(F.sum("n"), none).alias("n"), F.coalesce(F.sum("n_again"), none).alias("n_again"))
        line = F.concat_ws("", F.transform("held", lambda x: F.concat(x["prefix"], x["digest"])))
        levels.append(level.select(F.lit(digits).alias("digits"), up.alias("prefix"), F.sha2(line, 256).alias("digest"), "n", "n_again"))
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    return Tree(leaves, nodes, identity)


def root(made: Tree) -> str:
    """The digest of the whole table; refuses repeated identities."""
    top = made.nodes.where("digits = 0").first()
    if top["n_again"]:
        raise ValueError(f"{top['n_again']} rows have an identity that another row has too")
    return top["digest"]


def saved(made: Tree, path: str) -> str:
    """Writes the tree under ``path`` and gives its root."""
    whole = root(made)
    top = lambda c: F.when(F.length(c) >= 2, F.substring(c, 1, 2)).otherwise(F.lit("-"))
    made.nodes.withColumn("top", top("prefix")).repartition("digits", "top").sortWithinPartitions("prefix").write.partitionBy("digits", "top").parquet(f"{path}/nodes")
    # a folder's rows come from several tasks, each with a range of its own of the keys
    made.leaves.withColumn("top", F.substring("key", 1, 2)).repartition("top", F.substring("key", 3, 1)).sortWithinPartitions("top", "key").write.partitionBy("top").parquet(f"{path}/leaves")
    return whole


def differences(spark: SparkSession, before: str, after: str, identity: list[str]) -> DataFrame:
    """The identity's columns and ``change`` (ADDED, DROPPED, CHANGED) of the rows in which two saved trees differ. Only branches of different digests are read."""
    nodes = lambda path, digits: spark.read.schema("prefix string, digest string, n bigint, n_again bigint, digits int, top string").parquet(f"{path}/nodes").where(F.col("digits") == digits)

    def unlike(digits: int, *within) -> DataFrame:
        a, b = (nodes(path, digits).where(F.lit(True) if not within else within[0]) for path in (before, after))
        a, b = a.select("prefix", F.col("digest").alias("a")), b.select("prefix", F.col("digest").alias("b"))
        return a.join(b, "prefix", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")

    tops = [r["prefix"] for r in unlike(2).collect()]  # 256 at most
    inside = F.col("top").isin(tops) if tops else F.lit(False)
    below = unlike(4, inside)
    deep = nodes(before, 6).where(inside).select("prefix", F.col("digest").alias("a")).join(nodes(after, 6).where(inside).select("prefix", F.col("digest").alias("b")), "prefix", "full_outer")
    deep = deep.where(~F.col("a").eqNullSafe(F.col("b"))).join(below.select(F.col("prefix").alias("up")), F.substring("prefix", 1, 4) == F.col("up"), "left_semi").select("prefix")
    deep = cut(deep)
    sides = []
    for path, name in ((before, "a"), (after, "b")):
        rows = spark.read.parquet(f"{path}/leaves").where(inside)
        rows = rows.join(deep, F.substring("key", 1, DIGITS[0]) == F.col("prefix"), "left_semi")
        sides.append(rows.select("key", F.struct(*identity).alias(f"id_{name}"), F.col("leaf").alias(name)))
    both = sides[0].join(sides[1], "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "DROPPED").otherwise("CHANGED")
    return both.select(F.coalesce("id_b", "id_a").alias("id"), change.alias("change")).select("id.*", "change")
