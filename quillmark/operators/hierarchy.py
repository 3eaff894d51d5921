"""Class hierarchies: closure, roll-up and lints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.lineage import settle


def reach(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): what lies above each node of (child, parent) edges, by the shortest way; depth from 1.

    A fixpoint by path doubling: each round puts two ways together and keeps the shortest for a pair, so rounds grow
    with the logarithm of the depth, diamonds count once, and a cycle, whose nodes lie above themselves, ends too.
    """
    known = settle(edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    told = None
    while True:
        size = tuple(known.agg(F.count("*"), F.sum("depth")).first())
        if size == told:
            return known
        told = size
        above = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("depth").alias("_more"))
        longer = known.join(above, "ancestor").select("node", F.col("_top").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        known = settle(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of (child, parent) edges, every node being its own ancestor at depth 0; null ends don't count."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).where("node IS NOT NULL").distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(reach(edges).where("node <> ancestor"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, length) of the nodes that lie above themselves: what a class hierarchy must not have; length of the shortest way round."""
    return reach(edges).where("node = ancestor").select("node", F.col("depth").alias("length"))


def roll_up(rows: DataFrame, value: str, over: DataFrame) -> DataFrame:
    """rows once for each ancestor of their value, itself included; values outside the hierarchy stand alone."""
    return rows.join(over.select(F.col("node").alias(value), "ancestor"), value, "left").withColumn("ancestor", F.coalesce("ancestor", value))


def under(rows: DataFrame, value: str, over: DataFrame, top: str) -> DataFrame:
    """rows whose value is top or below it."""
    return rows.join(over.where(F.col("ancestor") == top).select(F.col("node").alias(value)), value, "left_semi")


def redundant_ancestors(methods: DataFrame, over: DataFrame) -> DataFrame:
    """(path, item_id, method, descendant) where an item names a method and one above it."""
    strict = over.where("depth > 0").select(F.col("node").alias("descendant"), F.col("ancestor").alias("method"))
    have = methods.select("path", "item_id", F.col("method").alias("descendant"))
    return methods.join(strict, "method").join(have, ["path", "item_id", "descendant"], "left_semi").select("path", "item_id", "method", "descendant")


def unexplained_intermediates(methods: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """Items that name a method with children and have no uncertainty flag."""
    parents = edges.select(F.col("parent").alias("method")).distinct()
    return methods.join(parents, "method", "left_semi").join(flags.where("type = 'ai_uncertainty'").select("path", "item_id"), ["path", "item_id"], "left_anti")


def migrate(dims: DataFrame, migrations: DataFrame) -> DataFrame:
    """(path, item_id, value) with old values replaced where a migration of that item says so."""
    moves = migrations.where("old IS DISTINCT FROM new").select("path", "item_id", F.col("old").alias("value"), "new")
    return dims.join(moves, ["path", "item_id", "value"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")
