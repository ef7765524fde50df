"""Keys and references: joins and aggregates that find what doesn't fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the edge table.
EDGE = ["from_type", "from_id", "column", "ref_type", "ref_id"]


def with_local_types(edges: DataFrame) -> DataFrame:
    """References in a row without a type mean the row's own type."""
    return edges.withColumn("ref_type", F.coalesce("ref_type", "from_type"))


def _keys(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("type").alias("ref_type"), F.col("id").alias("ref_id")).distinct()


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_local_types(edges).join(_keys(nodes), ["ref_type", "ref_id"], "left_semi")


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_local_types(edges).join(_keys(nodes), ["ref_type", "ref_id"], "left_anti")


def invalid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that no node has under their type, nor under any type."""
    return unresolved(edges, nodes).join(nodes.select(F.col("id").alias("ref_id")).distinct(), "ref_id", "left_anti")


def unqualified(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """For bare ids (column ``ref_id``) the number of types that have them: 0 is unresolved, 2 or more ambiguous."""
    types = nodes.groupBy(F.col("id").alias("ref_id")).agg(F.count_distinct("type").alias("types"))
    return ids.join(types, "ref_id", "left").withColumn("types", F.coalesce("types", F.lit(0)))


def collisions(nodes: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Keys that occur more than once, how often, and where first."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1")


def childless(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    return parents.join(children.select(F.col(foreign).alias(key)).distinct(), key, "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "child_count") -> DataFrame:
    """Direct children of each parent, zero included. Children are counted before the join, which then has a row a parent."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def unused_types(declared: DataFrame, used: DataFrame) -> DataFrame:
    return declared.join(used.select("type").distinct(), "type", "left_anti")
