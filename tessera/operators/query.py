"""Lookup queries over nodes: by type and id, with children, by substring, and in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entities(nodes: DataFrame, type_name: str | None = None, ident: str | None = None) -> DataFrame:
    """Nodes of a type, with an id, or both. Equality on stored columns reaches the scan."""
    if type_name is not None:
        nodes = nodes.where(F.col("type") == type_name)
    if ident is not None:
        nodes = nodes.where(F.col("id") == ident)
    return nodes


def with_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, child: Column, name: str = "children") -> DataFrame:
    """Parents with the sorted array of their children."""
    own = children.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(child)).alias(name))
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose id or type has the text, whatever its case."""
    return nodes.where(F.lower("id").contains(text.lower()) | F.lower("type").contains(text.lower()))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order from an offset. With a limit Spark keeps offset + limit rows of each task, not a sorted table."""
    out = rows.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def exactly_one(rows: DataFrame) -> DataFrame:
    """The rows; an action on them fails unless there is exactly one."""
    n = rows.limit(2).agg(F.count("*").alias("n_")).select(F.assert_true(F.col("n_") == 1, F.lit("the query must give exactly one result")).alias("ok_"), "n_")
    return rows.limit(1).crossJoin(n.where("ok_ IS NULL").select("n_")).drop("n_")


def without(df: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*excluded)) if excluded else df
