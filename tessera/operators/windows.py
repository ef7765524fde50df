"""Window operators: fill-forward and its inverse, sibling order, batches and the last parent before a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _frame(partition: list[str], order: list) -> W:
    return W.partitionBy(*partition).orderBy(*order)


def ditto_compress(df: DataFrame, partition: list[str], order: list, columns: list[str]) -> DataFrame:
    """For each column ``<name>_ditto``: whether the value is that of the row before, type and null included."""
    w = _frame(partition, order)
    first = F.row_number().over(w) == 1
    return df.withColumns({f"{c}_ditto": ~first & F.lag(F.struct(c)).over(w).eqNullSafe(F.struct(c)) for c in columns})


def ditto_fill(df: DataFrame, partition: list[str], order: list, columns: dict[str, str]) -> DataFrame:
    """Fill ``columns`` forward where the flag column named with each is true. A struct around the value keeps explicit nulls."""
    w = _frame(partition, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.when(~F.col(flag), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w)["v"] for c, flag in columns.items()})


def sibling_order(df: DataFrame, parent: list[str], order: list, name: str = "ord") -> DataFrame:
    """Places from 0 among the children of a parent."""
    return df.withColumn(name, (F.row_number().over(_frame(parent, order)) - 1).cast("bigint"))


def batches(df: DataFrame, group: list[str], order: list, size: int, name: str = "batch") -> DataFrame:
    """Numbers of chunks of ``size`` rows in a group."""
    return df.withColumn(name, F.floor((F.row_number().over(_frame(group, order)) - 1) / size).cast("bigint"))


def last_before(df: DataFrame, partition: list[str], order: list, value: str, when: Column, name: str) -> DataFrame:
    """The value of the last row, up to the present one, for which ``when`` holds: an as-of join of a table with itself."""
    w = _frame(partition, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))
