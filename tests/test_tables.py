"""Documents as DataFrames, graph, lint, streams and the data source."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, integrity, lint, query
from tessera.sources import tables
from tessera.sources.datasource import TreeTextSource
from tessera.streaming import files as streams
from tests.test_formats import TEXT

BAD = "%VERSION: 1.0\n---\n a: 1\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d1", TEXT), ("d2", TEXT.replace("u2", "u3")), ("bad", BAD)], "doc_id string, data string")


@pytest.fixture(scope="module")
def parsed(docs):
    return {k: v.cache() for k, v in tables.tables(docs, mode="PERMISSIVE").items()}


def test_node_table(parsed):
    nodes = parsed["nodes"]
    assert nodes.count() == 12
    got = nodes.where("doc_id = 'd1' AND type = 'Comment'").orderBy("line").select("id", "parent_type", "parent_id", "depth", F.col("cells")["score"]["d"].alias("score")).collect()
    assert [tuple(r) for r in got] == [("c1", "Post", "p1", 1, 1.5), ("c2", "Post", "p1", 1, -2.0)]
    view = tables.typed_view(nodes, "Post", {"title": "string", "views": "bigint", "author": "ref"}).where("doc_id = 'd1'").orderBy("id").collect()
    assert [tuple(r)[2:] for r in view] == [("One, two", 10, "@User:u1"), ("Three", None, "@User:u2")]
    assert query.entities(nodes, "User", "u1").count() == 2 and query.search(nodes, "COMM").count() == 4
    assert parsed["items"].where("path = 'info.ratio'").select("value.d").first()[0] == 0.5
    assert parsed["diagnostics"].select("doc_id", "kind").collect() == [("bad", "Syntax")]


def test_failfast(docs):
    with pytest.raises(Exception, match="odd number of blanks"):
        tables.parse(docs, "nodes").count()


def test_references_and_graph(parsed):
    nodes = parsed["nodes"].where("doc_id = 'd1'")
    edges = graph.reference_edges(nodes)
    assert {(r.from_id, r.to_id, r.rel_type) for r in edges.collect()} == {("p1", "u1", "AUTHOR"), ("p2", "u2", "AUTHOR")}
    assert [r.rel_type for r in graph.reference_edges(nodes, "target").limit(1).collect()] == ["USER"]
    nests = graph.nest_edges(nodes).orderBy("nest_order").collect()
    assert [(r.from_id, r.to_id, r.rel_type, r.nest_order) for r in nests] == [("p1", "c1", "HAS_COMMENT", 0), ("p1", "c2", "HAS_COMMENT", 1)]
    keyed = edges.select("from_type", "from_id", "column", F.col("to_type").alias("ref_type"), F.col("to_id").alias("ref_id"))
    assert integrity.unresolved(keyed, nodes).count() == 0 and integrity.unresolved(keyed, nodes.where("id <> 'u2'")).count() == 1
    assert graph.inferred_nests(graph.nest_edges(nodes)).collect() == [("Post", "Comment")]
    attached = graph.attach_children(nodes.where("type = 'Post'"), graph.nest_edges(nodes), nodes, "comments").orderBy("id").collect()
    assert [c.id for c in attached[0].comments] == ["c1", "c2"] and attached[1].comments is None
    back = graph.reference_columns(nodes, edges).where("id = 'p1'").first()
    assert back.references == {"author": "@User:u1"}
    statements = [r.statement for r in graph.node_statements(nodes.where("type = 'User'")).collect()]
    assert statements == ["UNWIND [{_node_id: 'u1', id: 'u1', name: 'Ann', age: 31, active: true}, {_node_id: 'u2', id: 'u2', name: 'Bob', age: null, active: false}] AS row MERGE (n:User {_node_id: row._node_id}) SET n += row"]
    one = graph.edge_statements(edges).collect()[0].statement
    assert one.startswith("UNWIND [{from: 'p1', to: 'u1'}") and "MERGE (a)-[:AUTHOR]->(b)" in one
    assert graph.schema_union(nodes, "type", F.map_keys("cells")).where("type = 'User'").first().columns == ["id", "active", "age", "name"]


def test_lint(spark):
    text = '%VERSION: 1.0\n%ALIAS: %used: "1"\n%ALIAS: %idle: "2"\n%STRUCT: A: [id,v]\n%STRUCT: B: [id]\n---\nxs: @A\n  |x,%used\n  |_12,~\nnone: @A\nr: @x\n'
    docs = spark.createDataFrame([("d", text)], "doc_id string, data string")
    parsed = tables.tables(docs)
    found = lint.run(parsed, enabled=("unused-alias",)).collect()
    assert sorted((r.rule, r.severity) for r in found) == [("empty-list", "hint"), ("id-naming", "hint"), ("id-naming", "hint"), ("unqualified-kv-ref", "warning"), ("unused-alias", "warning"), ("unused-schema", "warning")]
    strict = lint.run(parsed, disabled=("unused-schema",), least="error", escalate=True).collect()
    assert [r.rule for r in strict] == ["unqualified-kv-ref"]
    own = {"own": lambda t: t["nodes"].select("doc_id", F.lit("own").alias("rule"), F.lit("error").alias("severity"), F.lit("m").alias("message"), "line")}
    assert lint.run(parsed, custom=own, least="error").count() == 2


def test_convert_and_write(spark, docs, tmp_path):
    out = tables.convert(docs, "text", "json", mode="PERMISSIVE").collect()
    assert [r.error is not None for r in sorted(out, key=lambda r: r.doc_id)] == [True, False, False]
    nodes = tables.parse(docs.where("doc_id = 'd1'"), "nodes")
    tables.write_parquet(nodes, str(tmp_path / "nodes"))
    read = spark.read.parquet(str(tmp_path / "nodes")).where("type = 'User'")
    assert read.count() == 2 and "PartitionFilters: [isnotnull(type" in read._jdf.queryExecution().toString()
    spark.range(3).select(F.col("id").cast("string").alias("my id"), (F.col("id") / 2).alias("x"), F.lit("@T:a").alias("r")).write.parquet(str(tmp_path / "plain"))
    row = tables.read_parquet_rows(spark, str(tmp_path / "plain"), "Row").where("id = '1'").first()
    assert row.cells["x"].d == 0.5 and row.cells["r"].ref_id == "a" and "my_id" in row.cells


def test_sources_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.txt").write_text(TEXT.replace("p1", f"p1x{n}"))
    (folder / "bad.txt").write_text(BAD)
    spark.dataSource.register(TreeTextSource)
    read = spark.read.format("treetext").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.txt").load(str(folder))
    assert read.count() == 18 and read.where("type = 'User' AND id = 'u1'").select(F.col("cells")["age"]["i"]).first()[0] == 31
    batch = tables.parse(tables.files(spark, str(folder), "*.txt"), "nodes", mode="PERMISSIVE")
    assert {(r.type, r.id, r.n) for r in batch.groupBy("type", "id").agg(F.count("*").alias("n")).collect()} == {(r.type, r.id, r.n) for r in read.groupBy("type", "id").agg(F.count("*").alias("n")).collect()}

    got = []
    streams.each_batch(streams.nodes(spark, str(folder), "User"), lambda df, n: got.extend(r.id for r in df.collect()), str(tmp_path / "log")).awaitTermination()
    assert sorted(got) == ["u1"] * 3 + ["u2"] * 3
    own = spark.readStream.format("treetext").option("mode", "PERMISSIVE").load(str(folder))
    q = own.writeStream.format("memory").queryName("own_nodes").option("checkpointLocation", str(tmp_path / "log2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("own_nodes").count() == 18
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"a": 1}\n\n# c\n{bad\n')
    rows = []
    streams.each_batch(streams.json_lines(spark, str(lines)).selectExpr("line", "value IS NULL AS bad"), lambda df, n: rows.extend(df.collect()), str(tmp_path / "log3")).awaitTermination()
    assert sorted((r.line, r.bad) for r in rows) == [('{"a": 1}', False), ("{bad", True)]
