"""Counts, statistics, exact percentiles, and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: From which whole percentage a slow-down counts as minor, moderate, severe.
MINOR, MODERATE, SEVERE = 5, 15, 50
#: Words in a benchmark's name and the category they mean, in the order in which they are tried.
CATEGORIES = [("parse", "parsing"), ("convert", "conversion"), ("json", "conversion"), ("yaml", "conversion"), ("stream", "streaming"), ("mem", "memory"), ("valid", "validation"), ("lsp", "lsp"), ("mcp", "mcp"), ("ffi", "ffi")]


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("count"))


def document_stats(items: DataFrame) -> DataFrame:
    """Scalars, objects, lists, nodes and the greatest depth, from rows of ``kind`` and ``depth``."""
    kinds = ["scalar", "object", "list", "node"]
    return items.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds], F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def selected(df: DataFrame, group: list[str], value: str, ranks: dict[str, str], bins: int = 256) -> DataFrame:
    """Exact order statistics of each group: for each name the element at the 0-based place that SQL over ``n`` (the count) gives.

    Two passes over counts, without sorting or gathering a group: values are counted in equal-width bins to find the bin that has each rank; then only
    values of those bins are counted one by one and summed up. Both counts combine on the map side, so hot groups and values cost little.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*group, v.alias("v_"))
    span = rows.groupBy(*group).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.count("*").alias("n"))
    span = span.select(*group, "lo_", "hi_", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(r).cast("bigint").alias("rank")) for k, r in ranks.items()])).alias("want")).select(*group, "lo_", "hi_", "n", "want.name", "want.rank")
    spans = span.select(*group, "lo_", "hi_").distinct()
    binned = (rows.join(spans, group) if group else rows.crossJoin(F.broadcast(spans))).withColumn("bin_", F.when(F.col("hi_") > F.col("lo_"), F.least(F.floor((F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    counts = binned.groupBy(*group, "bin_").agg(F.count("*").alias("c_"))
    upto = W.partitionBy(*group).orderBy("bin_")
    places = counts.withColumn("end_", F.sum("c_").over(upto)).withColumn("begin_", F.col("end_") - F.col("c_")).drop("c_")
    want = (places.join(span, group) if group else places.crossJoin(F.broadcast(span))).where((F.col("rank") >= F.col("begin_")) & (F.col("rank") < F.col("end_"))).select(*group, "bin_", "begin_", "name", "rank")
    single = binned.join(want.select(*group, "bin_", "begin_").distinct(), [*group, "bin_"]).groupBy(*group, "bin_", "begin_", "v_").agg(F.count("*").alias("c_"))
    inner = W.partitionBy(*group, "bin_").orderBy("v_")
    single = single.withColumn("to_", F.col("begin_") + F.sum("c_").over(inner)).withColumn("from_", F.col("to_") - F.col("c_"))
    hit = single.join(want.drop("begin_"), [*group, "bin_"]).where((F.col("rank") >= F.col("from_")) & (F.col("rank") < F.col("to_")))
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("v_"))).alias(k) for k in ranks])


def statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, least, greatest, and the upper median (the element at place n / 2)."""
    v = F.col(value).cast("double")
    plain = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"))
    median = selected(df, group, value, {"median": "n div 2"})
    return plain.join(median, group) if group else plain.crossJoin(median)


def percentiles(df: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-index percentiles: the element at place n * p / 100, whole, of the sorted values."""
    return selected(df, group, value, {f"p{p}": f"least(n * {p} div 100, n - 1)" for p in percents})


def extremes(df: DataFrame, group: list[str], what: str, by: str, tie: str) -> DataFrame:
    """The first of the least and the last of the greatest, in the order of ``tie``."""
    return df.groupBy(*group).agg(F.min_by(what, F.struct(by, tie)).alias("lowest"), F.max_by(what, F.struct(by, tie)).alias("highest"))


def regression(base: Column, current: Column) -> Column:
    """none, minor, moderate or severe, by the whole percentage of slow-down (at most 255)."""
    percent = F.least(F.floor(F.greatest((current - base) * 100.0 / base, F.lit(0.0))), F.lit(255))
    return F.when((base == 0) | (percent < MINOR), "none").when(percent < MODERATE, "minor").when(percent < SEVERE, "moderate").otherwise("severe")


def compare(baseline: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Names that both tables have, with the change in percent and its class."""
    both = baseline.select(key, F.col(value).cast("double").alias("base")).join(current.select(key, F.col(value).cast("double").alias("current")), key)
    change = F.when(F.col("base") == 0, F.lit(0.0)).otherwise((F.col("current") - F.col("base")) / F.col("base") * 100.0)
    return both.withColumn("change", change).withColumn("status", regression(F.col("base"), F.col("current")))


def scaling_issues(df: DataFrame, name: str, size: str, time: str, factor: float = 1.5) -> DataFrame:
    """Names whose time grows from the least to the greatest size by over factor * r * log2(r), for r the ratio of sizes."""
    ends = df.groupBy(name).agg(F.min(size).alias("least_size"), F.max(size).alias("most_size"), F.min_by(time, size).alias("least_time"), F.max_by(time, size).alias("most_time"))
    r, t = F.col("most_size") / F.col("least_size"), F.col("most_time") / F.col("least_time")
    return ends.withColumns({"size_ratio": r, "time_ratio": t}).where((F.col("size_ratio") > 1) & (F.col("time_ratio") > factor * F.col("size_ratio") * F.log2("size_ratio")))


def category(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("other")
    for word, label in reversed(CATEGORIES):
        out = F.when(low.contains(word), label).otherwise(out)
    return out


def summary(df: DataFrame, name: str, value: str) -> DataFrame:
    """Total, mean, fastest and slowest of results."""
    return df.agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min_by(name, F.struct(value, name)).alias("fastest"), F.max_by(name, F.struct(value, name)).alias("slowest"))


def throughput_mbs(bytes_: Column, nanos: Column) -> Column:
    return F.when(nanos > 0, bytes_ / 1e6 / (nanos / 1e9))


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text column with the type that all its values fit: null, bool, int, float or string."""
    from ..functions.infer import csv_kind_tests

    parts = [F.struct(*[F.bool_and(test).alias(k) for k, test in csv_kind_tests(F.col(c)).items()]).alias(c) for c in columns]
    one = df.agg(*parts)
    kind = lambda c: F.when(c["null"], "null").when(c["bool"], "bool").when(c["int"], "int").when(c["float"], "float").otherwise("string")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(F.col(c)).alias("type")) for c in columns])).alias("x")).select("x.*")
