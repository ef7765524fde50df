"""Documents and JSON lines as streams, and sinks by micro-batch. The same functions as in batch reads do the parsing."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import parse


def documents(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 100) -> DataFrame:
    """Files as they arrive: ``doc_id`` and ``data``. A file is taken once."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("data"))


def nodes(spark: SparkSession, path: str, type_name: str | None = None, fmt: str = "text", mode: str = "PERMISSIVE", **options: Any) -> DataFrame:
    """Nodes of arriving files, of one type if it is given."""
    out = parse(documents(spark, path), "nodes", fmt, mode, **options)
    return out if type_name is None else out.where(F.col("type") == type_name)


def json_lines(spark: SparkSession, path: str, max_line: int = 10 << 20) -> DataFrame:
    """Lines of arriving files as variants. Blank lines and comments are left out; bad and overlong lines have a null value."""
    lines = spark.readStream.format("text").load(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.col("value").alias("line"), F.when(F.octet_length("value") <= max_line, F.try_parse_json("value")).alias("value"))


def counts(stream: DataFrame) -> DataFrame:
    """Running counts of nodes by type."""
    return stream.groupBy("type").agg(F.count("*").alias("count"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``write(batch, number)`` for each micro-batch over what is there, then stop. A batch may come again after a failure, with its number."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Whether the query ended within the time; it is stopped if not."""
    done = query.awaitTermination(int(seconds)) if seconds >= 1 else query.awaitTermination(1)
    if not done:
        query.stop()
    return bool(done)
