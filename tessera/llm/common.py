"""What the operators share: table loading, the shared scratch folder and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_CHECKPOINT_DIR = "/tmp/tessera-checkpoints"
#: Rows and bytes of an Arrow batch that goes to a Python worker, at most. Texts are long, so Spark's own bounds let a worker and its task hold hundreds of MB.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, for operators that hand texts to Python. Smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a session on one machine may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or LOCAL_CHECKPOINT_DIR).rstrip("/")


def rows_marked(spark: SparkSession, docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a column ``name`` that tells rows apart and stays the same when they are read again.

    Rows that are read from Parquet go by their file and place in it, which costs nothing; others are numbered in a written table.
    """
    if "_metadata#" in docs._jdf.queryExecution().analyzed().metadataOutput().toString():
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return scratch.keep(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to fix results that must not be computed twice.

    A lost executor costs a task that reads a file again, never the steps before the table.
    ``keep`` writes a table and has the driver collect its garbage, on which Spark deletes the shuffle files of the step; ``drop`` deletes tables
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made:03d}-{tag}"
        df.write.parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, tables: Iterable[DataFrame | None]) -> None:
        for table in tables:
            path = getattr(table, "scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and small-star steps.

    Returns ``(node, component)`` for every node with an edge; ``component`` is the smallest node id that can
    be reached. Every step is a group-by with map-side combine and an equi-join, nothing is collected; rounds grow
    with the logarithm of the component size. Each round's edges are written to the shared folder.
    """
    current = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # The root of a large component has very many edges; against a written table the join can be split.
        least = scratch.keep(least, "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        following = scratch.keep(small, "edges")
        # A star forest is a fixed point. Counts and a combined hash of all edges tell whether anything changed.
        after = _mark(following)
        before = _mark(current) if before is None else before
        scratch.drop([current, least])
        current = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
