"""Nodes, edges and nesting as a property graph; statements of a graph query language as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .windows import batches, sibling_order


def edge_name(column: Column, target: Column, naming: str = "property") -> Column:
    """The type of a reference's relationship: by the property, generic, or by the target's type."""
    return {"property": X.relationship_type(column), "generic": F.lit("REFERENCES"), "target": F.coalesce(F.upper(target), X.relationship_type(column))}[naming]


def nest_name(child: Column, naming: str = "property") -> Column:
    return {"property": F.concat(F.lit("HAS_"), F.upper(child)), "generic": F.lit("HAS_CHILD"), "target": F.upper(child)}[naming]


def foreign_key_edges(df: DataFrame, from_type: str, key: str, column: str, to_type: str, prefix: tuple[str, str], naming: str = "property") -> DataFrame:
    """Edges of a foreign key: type and id of both ends, and the relationship's type. Null keys make none."""
    return df.where(F.col(column).isNotNull()).select(
        F.lit(from_type).alias("from_type"), F.concat(F.lit(prefix[0]), F.col(key).cast("string")).alias("from_id"), F.lit(to_type).alias("to_type"), F.concat(F.lit(prefix[1]), F.col(column).cast("string")).alias("to_id"), edge_name(F.lit(column), F.lit(to_type), naming).alias("rel_type")
    )


def reference_edges(nodes: DataFrame, naming: str = "property") -> DataFrame:
    """Edges of all reference cells; a reference without a type points to the node's own."""
    cells = nodes.select("doc_id", "type", "id", F.explode("cells").alias("column", "c")).where(F.col("c.k") == "ref")
    target = F.coalesce("c.ref_type", "type")
    return cells.select("doc_id", F.col("type").alias("from_type"), F.col("id").alias("from_id"), "column", target.alias("to_type"), F.col("c.ref_id").alias("to_id"), edge_name(F.col("column"), target, naming).alias("rel_type"))


def nest_edges(nodes: DataFrame, naming: str = "property") -> DataFrame:
    """Edges from parents to children with the child's place among its siblings."""
    children = sibling_order(nodes.where(F.col("parent_id").isNotNull()), ["doc_id", "parent_type", "parent_id", "type"], ["line"], "nest_order")
    return children.select("doc_id", F.col("parent_type").alias("from_type"), F.col("parent_id").alias("from_id"), F.col("type").alias("to_type"), F.col("id").alias("to_id"), nest_name(F.col("type"), naming).alias("rel_type"), "nest_order")


def property_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their properties: all cells but references, which are edges."""
    return nodes.select("doc_id", "type", "id", F.map_filter("cells", lambda _, c: c["k"] != "ref").alias("properties"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to_type", "to_id").agg(F.count("*").alias("references"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type", "from_type", "to_type").agg(F.count("*").alias("count"))


def schema_union(rows: DataFrame, group: str, keys: Column) -> DataFrame:
    """Distinct property names of each group, sorted, with ``id`` first where there is one."""
    names = rows.select(group, F.explode(keys).alias("key")).distinct().groupBy(group).agg(F.array_sort(F.collect_set("key")).alias("columns"))
    return names.withColumn("columns", F.when(F.array_contains("columns", "id"), F.concat(F.array(F.lit("id")), F.array_remove("columns", "id"))).otherwise(F.col("columns")))


def inferred_nests(edges: DataFrame) -> DataFrame:
    """Parent and child types of nesting relationships."""
    return edges.where(F.col("rel_type").startswith("HAS_")).select(F.col("from_type").alias("parent"), F.col("to_type").alias("child")).distinct()


def attach_children(parents: DataFrame, edges: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Parents with an array of their children in nesting order. The array is as large as a parent has children."""
    met = edges.join(children.select(F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.struct(*[c for c in children.columns]).alias("child")), ["to_type", "to_id"])
    own = met.groupBy(F.col("from_type").alias("type"), F.col("from_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nest_order", "child")), lambda a, b: (a["nest_order"] - b["nest_order"]).cast("int")), lambda x: x["child"]).alias(name))
    return parents.join(own, ["type", "id"], "left")


def reference_columns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References gathered back into a map from column (the relationship's type in lower case) to target; the last in order wins."""
    last = edges.groupBy("from_type", "from_id", F.lower("rel_type").alias("column")).agg(F.max_by(F.concat(F.lit("@"), F.col("to_type"), F.lit(":"), F.col("to_id")), F.struct("to_type", "to_id")).alias("target"))
    maps = last.groupBy(F.col("from_type").alias("type"), F.col("from_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "target")))).alias("references"))
    return nodes.join(maps, ["type", "id"], "left")


# ---- statements


def _literal(c: Column) -> Column:
    """A typed cell as a literal."""
    number = F.when(c["d"] == F.floor(c["d"]), F.format_string("%.1f", c["d"])).otherwise(c["d"].cast("string"))
    return (
        F.when(c["k"] == "null", F.lit("null"))
        .when(c["k"] == "bool", c["b"].cast("string"))
        .when(c["k"] == "int", c["i"].cast("string"))
        .when(c["k"] == "float", F.when(F.isnan(c["d"]), F.lit("null")).otherwise(number))
        .when(c["k"] == "tensor", F.concat(F.lit("["), F.array_join(F.transform(c["data"], lambda x: x.cast("string")), ", "), F.lit("]")))
        .otherwise(X.quote_string(c["s"]))
    )


def constraints(nodes: DataFrame, id_property: str = "_node_id") -> DataFrame:
    """One statement for each type, that its ids are unique."""
    return nodes.select("type").distinct().select(
        F.concat(F.lit("CREATE CONSTRAINT "), F.lower("type"), F.lit("_id IF NOT EXISTS FOR (n:"), X.escape_identifier(F.col("type")), F.lit(f") REQUIRE n.{id_property} IS UNIQUE")).alias("statement")
    )


def node_statements(nodes: DataFrame, size: int = 1000, id_property: str = "_node_id") -> DataFrame:
    """``MERGE`` statements over chunks of nodes of a type; a chunk has at most ``size`` rows."""
    numbered = batches(nodes, ["type"], ["doc_id", "line", "id"], size)
    pairs = F.transform(F.map_entries(F.map_filter("cells", lambda _, c: c["k"] != "ref")), lambda e: F.concat(X.escape_identifier(e["key"]), F.lit(": "), _literal(e["value"])))
    row = F.concat(F.lit(f"{{{id_property}: "), X.quote_string(F.col("id")), F.when(F.size(pairs) > 0, F.concat(F.lit(", "), F.array_join(pairs, ", "))).otherwise(F.lit("")), F.lit("}"))
    grouped = numbered.withColumn("row", row).groupBy("type", "batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("type", "batch", F.concat(F.lit("UNWIND ["), F.array_join("rows", ", "), F.lit("] AS row MERGE (n:"), X.escape_identifier(F.col("type")), F.lit(f" {{{id_property}: row.{id_property}}}) SET n += row")).alias("statement"))


def edge_statements(edges: DataFrame, size: int = 1000, id_property: str = "_node_id") -> DataFrame:
    """``MERGE`` statements over chunks of relationships with one type and one pair of labels."""
    numbered = batches(edges, ["rel_type", "from_type", "to_type"], ["from_id", "to_id"], size)
    row = F.concat(F.lit("{from: "), X.quote_string(F.col("from_id")), F.lit(", to: "), X.quote_string(F.col("to_id")), F.lit("}"))
    grouped = numbered.withColumn("row", row).groupBy("rel_type", "from_type", "to_type", "batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    statement = F.concat(
        F.lit("UNWIND ["), F.array_join("rows", ", "), F.lit("] AS row MATCH (a:"), X.escape_identifier(F.col("from_type")), F.lit(f" {{{id_property}: row.from}}), (b:"), X.escape_identifier(F.col("to_type")),
        F.lit(f" {{{id_property}: row.to}}) MERGE (a)-[:"), X.escape_identifier(F.col("rel_type")), F.lit("]->(b)"),
    )
    return grouped.select("rel_type", "from_type", "to_type", "batch", statement.alias("statement"))
