"""Row-oriented readers that stay in Spark: CSV, JSON and XML tables as nodes with typed cells, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import infer
from ..operators.stats import column_types


def read_csv(spark: SparkSession, path: str, type_name: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True, sample: int = 100, infer_types: bool = True, max_rows: int | None = None) -> DataFrame:
    """Nodes of a CSV table. Types come from the first ``sample`` rows; cells that don't fit stay strings.

    An action fails at rows of another width, at an empty id, and beyond ``max_rows``.
    """
    reader = spark.read.option("header", str(header).lower()).option("sep", delimiter).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("enforceSchema", "false" if header else "true")
    names = columns or spark.read.option("header", str(header).lower()).option("sep", delimiter).csv(path).columns
    rows = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    kinds = {r["column"]: r["type"] for r in column_types(rows.limit(sample), names).collect()} if infer_types else {}
    first = F.col(f"`{names[0]}`")
    ident = F.when(F.coalesce(first, F.lit("")) == "", F.raise_error(F.lit("empty id")).cast("string")).otherwise(first)
    if max_rows is not None:
        rows = at_most(rows, max_rows)
    cells = [x for i, c in enumerate(names) for x in (F.lit(c), infer.cell("string", s=first) if i == 0 else infer.typed_or_string(F.col(f"`{c}`"), kinds[c]) if c in kinds else infer.infer_csv_cell(F.col(f"`{c}`")))]
    return rows.select(F.lit(path).alias("doc_id"), F.lit(type_name).alias("type"), ident.alias("id"), F.create_map(*cells).alias("cells"))


def write_csv(nodes: DataFrame, type_name: str, columns: list[str], path: str, delimiter: str = ",", header: bool = True) -> None:
    """Nodes of a type as CSV; null is empty, references and expressions are text, tensors are JSON."""

    def text(name: str) -> Column:
        c = F.try_element_at("cells", F.lit(name))
        real = F.when(F.isnan(c["d"]), "NaN").when(c["d"] == float("inf"), "Infinity").when(c["d"] == float("-inf"), "-Infinity").otherwise(number_text(c["d"], ""))
        return F.when(c["k"] == "null", F.lit(None)).when(c["k"] == "float", real).when(c["k"] == "tensor", F.to_json(c["data"])).otherwise(infer.display(c)).alias(name)

    nodes.where(F.col("type") == type_name).select(*[text(c) for c in columns]).write.option("header", str(header).lower()).option("sep", delimiter).csv(path)


def number_text(d: Column, whole: str = ".0") -> Column:
    """A float as digits without an exponent; whole numbers end in ``whole``."""
    plain = F.when(F.abs(d) < 1e15, d.cast("decimal(38,17)").cast("string"))
    short = F.regexp_replace(plain, r"\.?0+$", "")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e18), F.concat(d.cast("bigint").cast("string"), F.lit(whole))).otherwise(F.when(d.cast("string").contains("E"), F.coalesce(short, d.cast("string"))).otherwise(d.cast("string")))


def read_json_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """JSON texts as ``doc_id, data``, for ``tables.parse``: a document for each line, or for each element of an array.

    Blank lines and comments are left out. Lines are numbered within their partition of the input.
    """
    if lines:
        rows = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
        return rows.select(F.concat(F.input_file_name(), F.lit("#"), F.monotonically_increasing_id().cast("string")).alias("doc_id"), F.col("value").alias("data"))
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("n", "v"))
    return rows.select(F.concat("f", F.lit("#"), F.col("n").cast("string")).alias("doc_id"), F.to_json("v").alias("data"))


def write_json_lines(texts: DataFrame, path: str) -> None:
    """One document a line, from ``text``."""
    texts.select(F.to_json(F.parse_json("text")).alias("value")).write.text(path)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, xsd: str | None = None, schema: str | None = None) -> DataFrame:
    """Elements with a tag as rows, each held against a schema document on request; a bad row is null but for ``_corrupt``."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE")
    if xsd:
        reader = reader.option("rowValidationXSDPath", xsd)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """The rows; an action fails if there are more than ``rows``."""
    n = df.limit(rows + 1).agg(F.count("*").alias("n_")).select(F.assert_true(F.col("n_") <= rows, F.lit(f"more than {rows} rows")).alias("ok_"))
    return df.crossJoin(F.broadcast(n.where("ok_ IS NULL").select(F.lit(1).alias("one_")))).drop("one_")
