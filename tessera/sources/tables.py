"""Documents as DataFrames: files to node, item, schema, list, alias and diagnostic tables, and tables back to text.

Files are read with Spark and parsed one by one inside tasks (`mapInPandas`); a file is the unit of parallel work and nothing
is gathered on the driver. A file that cannot be read is one row of diagnostics in permissive mode and fails the job otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.infer import CELL
from . import formats, treetext
from .document import Document, DocumentError, Expr, Ref, Table, Tensor, walk_nodes

NODES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("list_key", T.StringType()), T.StructField("ord", T.LongType()),
        T.StructField("line", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("parent_type", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("child_count", T.IntegerType()),
        T.StructField("cells", T.MapType(T.StringType(), CELL)),
    ]
)
SCHEMAS: dict[str, Any] = {
    "nodes": NODES,
    "items": T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("value", CELL), T.StructField("depth", T.IntegerType()), T.StructField("line", T.IntegerType())]),
    "lists": "doc_id string, list_key string, type string, n_rows long, count_hint long, line int",
    "schemas": "doc_id string, type string, pos int, column string, declared_count long",
    "nests": "doc_id string, parent string, child string",
    "aliases": "doc_id string, name string, value string, uses int",
    "diagnostics": "doc_id string, kind string, message string, line int",
}

READERS: dict[str, Callable[..., Document]] = {
    "text": lambda text, **o: treetext.parse(text, **o),
    "json": lambda text, **o: formats.from_json(text),
    "yaml": lambda text, **o: formats.from_yaml(text),
    "xml": lambda text, **o: formats.from_xml(text),
    "compact": lambda text, **o: formats.from_compact(text),
    "csv": lambda text, **o: formats.from_csv(text, **o),
}
WRITERS: dict[str, Callable[..., str]] = {"text": treetext.canonical, "json": formats.to_json, "yaml": formats.to_yaml, "xml": formats.to_xml, "compact": formats.to_compact, "csv": formats.to_csv}


def cell_of(v: Any) -> dict[str, Any]:
    out: dict[str, Any] = dict.fromkeys(f.name for f in CELL.fields)
    if v is None:
        out["k"] = "null"
    elif isinstance(v, bool):
        out |= {"k": "bool", "b": v}
    elif isinstance(v, int):
        out |= {"k": "int", "i": v}
    elif isinstance(v, float):
        out |= {"k": "float", "d": v}
    elif isinstance(v, Ref):
        out |= {"k": "ref", "ref_type": v.type, "ref_id": v.id}
    elif isinstance(v, Tensor):
        out |= {"k": "tensor", "shape": v.shape(), "data": v.flat()}
    elif isinstance(v, Expr):
        out |= {"k": "expr", "s": str(v)}
    else:
        out |= {"k": "string", "s": v}
    return out


def rows_of(doc_id: str, doc: Document, what: str, text: str = "") -> Iterator[tuple]:
    """The rows of one table of a document."""
    if what == "nodes":
        for key, table in doc.tables():
            for n, (node, parent, depth, inner) in enumerate(walk_nodes(table.rows)):
                columns = table.columns if parent is None else node.columns or doc.columns_of(node.type, len(node.values))
                cells = [(c, cell_of(v)) for c, v in zip(columns, node.values)]
                yield doc_id, node.type, node.id, inner or key, n, node.line, depth, parent.type if parent else None, parent.id if parent else None, node.hint, cells
    elif what == "items":

        def walk(found: dict[str, Any], path: str, depth: int) -> Iterator[tuple]:
            for key in sorted(found):
                at = f"{path}.{key}" if path else key
                if isinstance(found[key], dict):
                    yield from walk(found[key], at, depth + 1)
                elif not isinstance(found[key], Table):
                    yield doc_id, at, cell_of(found[key]), depth, doc.lines.get(key, 0)

        yield from walk(doc.root, "", 0)
    elif what == "lists":
        for key, table in doc.tables():
            yield doc_id, key, table.type, len(table.rows), table.hint, table.line
    elif what == "schemas":
        for kind, columns in sorted(doc.schemas.items()):
            for i, c in enumerate(columns):
                yield doc_id, kind, i, c, doc.counts.get(kind)
    elif what == "nests":
        for parent, child in sorted(doc.nests.items()):
            yield doc_id, parent, child
    elif what == "aliases":
        body = text.partition("\n---")[2]
        for name, value in sorted(doc.aliases.items()):
            yield doc_id, name, value, body.count(f"%{name}")


def files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``doc_id`` (the path) and ``data`` (bytes) of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("data"))


def parse(docs: DataFrame, what: str, fmt: str = "text", mode: str = "FAILFAST", **options: Any) -> DataFrame:
    """A table (``nodes``, ``items``, ``lists``, ``schemas``, ``nests``, ``aliases`` or ``diagnostics``) of documents in ``doc_id, data``."""
    read, schema = READERS[fmt], SCHEMAS[what]
    names = [f.name for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, data in zip(batch["doc_id"], batch["data"]):
                data = data.encode("utf-8") if isinstance(data, str) else bytes(data or b"")
                try:
                    doc = read(data if fmt == "text" else data.decode("utf-8"), **options)
                    found = list(rows_of(doc_id, doc, what, data.decode("utf-8", "replace") if what == "aliases" else ""))
                except (DocumentError, UnicodeDecodeError) as e:
                    if what != "diagnostics":
                        if mode == "FAILFAST":
                            raise
                        continue
                    error = e if isinstance(e, DocumentError) else DocumentError("Syntax", "invalid UTF-8 encoding", 1)
                    found = [(doc_id, error.kind, error.message, error.line)]
                frame = pd.DataFrame(found, columns=names, dtype=object)
                if what == "nodes":
                    frame["cells"] = frame["cells"].map(dict) if len(frame) else frame["cells"]
                yield frame

    return docs.select("doc_id", "data").mapInPandas(of, schema)


def tables(docs: DataFrame, fmt: str = "text", mode: str = "FAILFAST", **options: Any) -> dict[str, DataFrame]:
    return {what: parse(docs, what, fmt, mode, **options) for what in SCHEMAS}


def convert(docs: DataFrame, source: str, target: str, mode: str = "FAILFAST", read: dict[str, Any] | None = None, write: dict[str, Any] | None = None) -> DataFrame:
    """Documents from one format to another: ``doc_id, text, error``."""
    load, dump = READERS[source], WRITERS[target]
    read, write = read or {}, write or {}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, data in zip(batch["doc_id"], batch["data"]):
                data = data.encode("utf-8") if isinstance(data, str) else bytes(data or b"")
                try:
                    out.append((doc_id, dump(load(data if source == "text" else data.decode("utf-8"), **read), **write), None))
                except (DocumentError, UnicodeDecodeError) as e:
                    if mode == "FAILFAST":
                        raise
                    out.append((doc_id, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "error"], dtype=object)

    return docs.select("doc_id", "data").mapInPandas(of, "doc_id string, text string, error string")


def typed_view(nodes: DataFrame, type_name: str, columns: dict[str, str]) -> DataFrame:
    """Nodes of a type as plain columns: ``columns`` maps names to SQL types; cells of another kind are null."""
    parts = {"boolean": "b", "bigint": "i", "double": "d", "string": "s", "array<double>": "data"}

    def column(name: str, kind: str):
        c = F.try_element_at("cells", F.lit(name))
        if kind == "ref":
            return F.when(c["k"] == "ref", F.concat(F.lit("@"), F.coalesce(F.concat(c["ref_type"], F.lit(":")), F.lit("")), c["ref_id"])).alias(name)
        if kind == "double":
            return F.coalesce(c["d"], c["i"].cast("double")).alias(name)
        return c[parts[kind]].alias(name)

    return nodes.where(F.col("type") == type_name).select("doc_id", "id", *[column(n, k) for n, k in columns.items() if n != "id"])


def write_parquet(nodes: DataFrame, path: str) -> None:
    """All nodes, in a folder for each type, so that reads of a type leave the others out."""
    nodes.write.partitionBy("type").parquet(path)


def read_parquet_rows(spark: SparkSession, path: str, type_name: str) -> DataFrame:
    """Rows of a plain Parquet table as nodes: the first column is the id, text cells that begin with ``@`` are references."""
    from ..functions.infer import cell, parse_reference

    rows = spark.read.parquet(path)
    safe = {c: "".join(x if x.isalnum() or x == "_" else "_" for x in c.strip()) for c in rows.columns}

    def as_cell(name: str, kind: T.DataType):
        c = F.col(f"`{name}`")
        null = cell("null")
        if isinstance(kind, T.BooleanType):
            return F.when(c.isNull(), null).otherwise(cell("bool", b=c))
        if isinstance(kind, T.IntegralType):
            return F.when(c.isNull(), null).otherwise(cell("int", i=c.cast("bigint")))
        if isinstance(kind, T.FractionalType):
            return F.when(c.isNull(), null).otherwise(cell("float", d=c.cast("double")))
        if isinstance(kind, T.ArrayType):
            return F.when(c.isNull(), null).otherwise(cell("tensor", shape=F.array(F.size(c)), data=c.cast("array<double>")))
        text = c.cast("string")
        ref = parse_reference(text)
        return F.when(c.isNull(), null).when(ref.isNotNull(), cell("ref", ref_type=ref["type"], ref_id=ref["id"])).otherwise(cell("string", s=text))

    first = rows.columns[0]
    pairs = [x for f in rows.schema.fields for x in (F.lit(safe[f.name]), as_cell(f.name, f.dataType))]
    return rows.select(F.lit(path).alias("doc_id"), F.lit(type_name).alias("type"), F.col(f"`{first}`").cast("string").alias("id"), F.create_map(*pairs).alias("cells"))
