"""The named functions, the commands, and the readers that stay in Spark."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import api, cli
from tessera.functions import infer
from tessera.sources import rows, tables
from tests.test_formats import TEXT


def test_one_document():
    assert api.validate(TEXT)["valid"] and api.validate("x")["kind"] == "Syntax"
    assert api.inspect(TEXT)["entities"] == {"Comment": 2, "Post": 2, "User": 2}
    sizes = api.stats(TEXT)
    assert sizes["json"]["bytes"] > sizes["text"]["bytes"] and sizes["json"]["saved_tokens"] > 0
    assert api.format_text(api.format_text(TEXT)) == api.format_text(TEXT) and "|[2] p1" in api.format_text(TEXT, with_counts=True)
    small = api.optimize(json.dumps({"users": [{"id": f"u{i}", "name": "Ann", "role": "admin"} for i in range(50)]}))
    assert small["saved"] > 30 and api.parse(small["text"]).root["users"].rows[9].values == ["u9", "Ann", "admin"]
    assert json.loads(api.schema(TEXT))["definitions"]["User"]


def test_commands(tmp_path, capsys):
    good, bad = tmp_path / "a.txt", tmp_path / "b.txt"
    good.write_text(TEXT)
    bad.write_text("%VERSION: 1.0\n---\nx: @none\n")
    assert cli.run(["validate", str(good)]) == 0 and cli.run(["validate", str(bad)]) == 1 and cli.run(["validate", "--lenient", str(bad)]) == 0
    assert cli.run(["to-json", str(good), "-o", str(tmp_path / "a.json")]) == 0 and cli.run(["from-json", str(tmp_path / "a.json")]) == 0
    assert "users: @User" in capsys.readouterr().out
    for name in ("yaml", "xml", "compact", "csv"):
        assert cli.run([f"to-{name}", str(good), "-o", str(tmp_path / name)]) == 0 and cli.run([f"from-{name}", str(tmp_path / name)]) == 0
    for name in ("format", "inspect", "stats", "schema"):
        assert cli.run([name, str(good)]) == 0
    assert cli.run(["format", str(bad)]) == 1


def test_commands_with_spark(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    (tmp_path / "in/b.txt").write_text("%VERSION: 1.0\n---\n a: 1\n")
    capsys.readouterr()
    assert cli.run(["batch-validate", str(tmp_path / "in")]) == 1 and "odd number of blanks" in capsys.readouterr().out
    assert cli.run(["batch-format", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 1
    assert json.loads(capsys.readouterr().out) == {"total": 2, "succeeded": 1, "failed": 1}
    assert cli.run(["lint", str(tmp_path / "in/a.txt")]) == 0 and cli.run(["batch-lint", str(tmp_path / "in")]) == 0
    assert cli.run(["to-parquet", str(tmp_path / "in/a.txt"), "-o", str(tmp_path / "nodes")]) == 0 and spark.read.parquet(str(tmp_path / "nodes")).count() == 6


def test_many_documents(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "%VERSION: 1.0\n---\n a: 1\n")], "doc_id string, data string")
    got = {r.doc_id: (r.valid, r.diagnostics, r.error and r.error.kind) for r in api.validate_all(docs).collect()}
    assert got == {"a": (True, 0, None), "b": (False, 0, "Syntax")}
    assert [r.id for r in api.query(docs, "Comment", limit=1, offset=1).collect()] == ["c2"] and api.exists(api.query(docs), "User", "u2") and not api.exists(api.query(docs), "User", "c1")
    sizes = {r.format: r.saved for r in api.sizes(docs).collect()}
    assert set(sizes) == set(api.FORMATS) and sizes["json"] > 0


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,n,x,ok,r\na,1,1.5,true,@T:x\nb,~,2,false,z\nc,3,1e3,,NaN\n")
    nodes = rows.read_csv(spark, str(path), "Row")
    got = {r.id: {k: (v.k, infer.CELL.fieldNames() and (v.i if v.k == "int" else v.d if v.k == "float" else v.b if v.k == "bool" else v.s)) for k, v in r.cells.items()} for r in nodes.collect()}
    assert got["a"] == {"id": ("string", "a"), "n": ("int", 1), "x": ("float", 1.5), "ok": ("bool", True), "r": ("string", "@T:x")} and got["b"]["n"][0] == "null" and got["c"]["x"] == ("float", 1000.0)
    assert "Python" not in nodes._jdf.queryExecution().toString()
    rows.write_csv(nodes, "Row", ["id", "n", "x", "ok"], str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect() if not r.value.startswith("id")) == ["a,1,1.5,true", "b,,2,false", "c,3,1000,"]
    with pytest.raises(Exception, match="more than 2 rows"):
        rows.read_csv(spark, str(path), "Row", max_rows=2).count() and rows.read_csv(spark, str(path), "Row", max_rows=2).collect()
    (tmp_path / "u.csv").write_text("id,n\n,1\n")
    with pytest.raises(Exception, match="empty id"):
        rows.read_csv(spark, str(tmp_path / "u.csv"), "Row").collect()


def test_json_and_xml_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": [{"id": "x", "n": 1}]}\n\n# note\n{"ts": [{"id": "y", "n": 2}]}\n')
    docs = rows.read_json_documents(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.id for r in tables.parse(docs, "nodes", "json").collect()) == ["x", "y"] and docs.select("doc_id").distinct().count() == 2
    (tmp_path / "a.json").write_text('[{"ts": [{"id": "x"}]}, {"ts": [{"id": "z"}]}]')
    assert sorted(r.id for r in tables.parse(rows.read_json_documents(spark, str(tmp_path / "a.json"), lines=False), "nodes", "json").collect()) == ["x", "z"]
    texts = tables.convert(docs, "json", "json")
    rows.write_json_lines(texts, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    (tmp_path / "a.xml").write_text("<all><row><id>a</id><n>1</n></row><row><id>b</id><n>x</n></row></all>")
    (tmp_path / "a.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="row"><xs:complexType><xs:sequence><xs:element name="id" type="xs:string"/><xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    assert rows.read_xml_rows(spark, str(tmp_path / "a.xml"), "row").count() == 2
    held = rows.read_xml_rows(spark, str(tmp_path / "a.xml"), "row", str(tmp_path / "a.xsd"), "id string, n string, _corrupt string").collect()
    assert sorted(r._corrupt is not None for r in held) == [False, True]


def test_number_text(spark):
    values = [1.0, -0.5, 1e-7, 123456.789, 1e10, 0.1]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d double")
    assert [r[0] for r in frame.orderBy("i").select(rows.number_text(F.col("d"))).collect()] == ["1.0", "-0.5", "0.0000001", "123456.789", "10000000000.0", "0.1"]
