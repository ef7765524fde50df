"""Column functions against what they must give, and paths against a plain evaluation."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import infer
from tessera.functions import text as X
from tessera.operators import query, stats
from tessera.plans import jsonpath


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_ladder(spark):
    texts = ["~", "true", "^", "[1, 2]", "[[1],[2]]", "[x]", "@T:a", "@a", "@1", "$(f(x))", "%k", "%none", "-7", "1.5e3", "1e10", "5.", "99999999999999999999", "+1", " x ", "", "1d"]
    got = apply(spark, lambda c: infer.infer_cell(c, aliases=F.create_map(F.lit("k"), F.lit("12"))), texts)
    assert [g.k for g in got] == ["null", "bool", "ditto", "tensor", "tensor", "string", "ref", "ref", "error", "expr", "int", "error", "int", "float", "string", "string", "string", "string", "string", "string", "string"]
    assert got[3].shape == [2] and got[4].shape == [2, 1] and got[4].data == [1.0, 2.0] and (got[6].ref_type, got[7].ref_type) == ("T", None) and got[10].i == 12 and got[18].s == "x"
    kinds = apply(spark, infer.kind_of, texts)
    assert [k for k, t in zip(kinds, texts) if t[:1] != "%"] == [g.k for g, t in zip(got, texts) if t[:1] != "%"]
    csv = apply(spark, infer.infer_csv_cell, ["", "NaN", "+1", "1e3", "@T:x", "false", "null", None])
    assert [g.k for g in csv] == ["null", "float", "int", "float", "ref", "bool", "string", "null"]
    assert apply(spark, lambda c: infer.display(infer.infer_cell(c)), ["~", "true", "5", "@T:a", "[1]", "x"]) == ["~", "true", "5", "@T:a", "[tensor]", "x"]


@pytest.mark.parametrize(
    "f, pairs",
    [
        (X.type_name, [("users", "User"), ("categories", "Category"), ("boxes", "Box"), ("user_posts", "UserPost"), ("types", "Type"), ("s", "S"), ("classes", "Class")]),
        (X.plural, [("box", "boxes"), ("city", "cities"), ("day", "days"), ("key", "keys"), ("user", "users"), ("buzz", "buzzes")]),
        (X.plural_irregular, [("child", "children"), ("Person", "People"), ("MAN", "MEN"), ("user", "users"), ("USER", "USERS"), ("", "")]),
        (X.snake_case, [("userName", "user_name"), ("User-Name", "user_name"), ("x", "x")]),
        (X.identifier, [("a b", "a_b"), ("1x", "_1x"), ("", "_")]),
        (X.relationship_type, [("createdBy", "CREATED_BY"), ("a--b", "A_B"), ("_x_", "X")]),
        (X.quote_string, [("it's", "'it\\'s'"), ("a\nb", "'a\\nb'")]),
        (X.escape_identifier, [("name", "name"), ("match", "`match`"), ("a`b", "`a``b`")]),
        (X.string_format, [("a@b.c", "email"), ("https://x", "uri"), ("2024-01-01T00:00:00Z", "date-time"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("x", None)]),
        (X.name_format, [("user_email", "email"), ("updated_on", "date-time"), ("guid", "uuid"), ("n", None)]),
        (X.normal_integer, [(" 1,234 ", "1234"), ("$5", "5"), ("7.9", "7"), ("x", None)]),
        (lambda c: X.normal_number(c, 2), [("1,234.567", "1234.57"), ("3", "3.00"), ("45%", "0.45"), ("x", None)]),
        (X.normal_boolean, [("Yes", "true"), ("off", "false"), ("?", None)]),
        (X.normal_date, [("2024-03-01T10:00", "2024-03-01"), ("03/01/2024", "2024-03-01"), ("x", None)]),
        (X.clean_answer, [(' "a b" ', "a b"), ("```json\n[1]\n```", "[1]"), ("x", "x")]),
        (lambda c: X.normal_list(c, False), [("b, A ,c", "a,b,c")]),
        (lambda c: X.estimate_tokens(c).cast("string"), [("ab, c\u00a0d!", "3"), ("", "0")]),
        (lambda c: X.estimate_tokens_coarse(c).cast("string"), [("aaaa bbbb cc  d", "3")]),
    ],
)
def test_text(spark, f, pairs):
    assert apply(spark, f, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_cells_out_and_in(spark):
    texts = ["~", "true", "5", "1.5", 'a "b"', "@T:x", "[1, 2]", "$(f(x))"]
    assert apply(spark, lambda c: infer.as_json(infer.infer_cell(c)), texts) == ["null", "true", "5", "1.5", '"a \\"b\\""', '"@T:x"', '{"tensor":{"shape":[2],"data":[1.0,2.0]}}', '"$(f(x))"']
    assert [g.k for g in apply(spark, infer.property_cell, ["@T:x", "[1]", "x", None])] == ["ref", "tensor", "string", "null"]
    assert apply(spark, X.safe_name, ["cafe\u0301", "a\u200bb", "x", None]) == ["caf\u00e9", "ab", "x", None]
    with pytest.raises(Exception, match="exceeds 2 bytes"):
        apply(spark, lambda c: X.at_most_bytes(c, 2), ["abc"])


DOC = '{"a": {"b": [1, 2.5, "x", null, true], "c": "t"}, "items": [{"n": 1, "t": "x", "k": {"n": 9}}, {"n": 5}, {"t": "y", "n": 3, "q": null}], "e": [], "s\'q": 1}'


@pytest.mark.parametrize(
    "path, want",
    [
        ("$.a.c", ["t"]), ("$['a']['c']", ["t"]), ("$.a.b[0]", ["1"]), ("$.a.b[-1]", ["true"]), ("$.a.b[1:3]", ["2.5", "x"]), ("$.a.b[::2]", ["1", "x", "true"]), ("$.a.b[-2:]", ["null", "true"]), ("$.a.b[9]", []), ("$.none", []), ("$.a.b.c", []),
        ("$.items[*].n", ["1", "5", "3"]), ("$.items[0,2].n", ["1", "3"]), ("$.a['c','b'][0]", ["1"]), ("$..n", ["1", "5", "3", "9"]), ("$.items[?@.n > 2].n", ["5", "3"]), ("$.items[?@.t == 'x' || @.n == 5].n", ["1", "5"]), ("$.items[?@.t].n", ["1", "3"]),
        ("$.items[?!@.t].n", ["5"]), ("$.items[?@.n >= 3 && @.t].t", ["y"]), ("$.items[?(@.n != 1)].n", ["5", "3"]), ("$.items[?@.q == null].n", ["3"]), ("$.items[?@.k.n == 9].n", ["1"]), ("$.items[?2 < @.n].n", ["5", "3"]), ("$.e[*]", []), ("$.a.b[?@ == true]", ["true"]), ("$.items[?@.t < 'y'].t", ["x"]), ("$[\"s'q\"]", ["1"]),
    ],
)
def test_paths(spark, path, want):
    df = spark.createDataFrame([(1, DOC)], "i int, j string")
    got = [r.value for r in jsonpath.values(df, F.col("j"), path, ["i"]).collect()]
    assert (sorted(got) if ".." in path else got) == (sorted(want) if ".." in path else want)


def test_path_forms(spark):
    df = spark.createDataFrame([(1, DOC), (2, "not json"), (3, None)], "i int, j string")
    assert [r.n for r in jsonpath.count(df, F.col("j"), "$.items[*]", ["i"], "n").orderBy("i").collect()] == [3, 0, 0]
    assert [r.found for r in jsonpath.exists(df, F.col("j"), "$.a.c", ["i"], "found").orderBy("i").collect()] == [True, False, False]
    assert [r.value for r in jsonpath.first(df, F.col("j"), "$.items[*].n", ["i"]).orderBy("i").collect()] == ["1", None, None]
    assert jsonpath.single(df.where("i = 1"), F.col("j"), "$.a.c", ["i"]).first().value == "t"
    with pytest.raises(Exception, match="exactly one"):
        jsonpath.single(df, F.col("j"), "$.items[*].n", ["i"]).collect()
    for bad in ("a", "$.", "$[", "$[x]", "$[?@.a ==]", "$[?1]", "$.a[::-1]"):
        with pytest.raises(jsonpath.PathError):
            jsonpath.parse(bad)


def test_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 4, 2, 100)] + [("b", 7.0)] + [("b", None)], "g string, x double")
    got = {r.g: r for r in stats.statistics(rows, ["g"], "x").collect()}
    assert (got["a"].median, got["a"].n, got["b"].median, got["b"].stddev) == (4.0, 6, 7.0, 0.0)
    p = {r.g: (r.p0, r.p50, r.p99) for r in stats.percentiles(rows, ["g"], "x", [0, 50, 99]).collect()}
    assert p == {"a": (1.0, 4.0, 100.0), "b": (7.0, 7.0, 7.0)}
    assert stats.percentiles(rows, [], "x", [50]).collect() == [(4.0,)]
    marks = spark.createDataFrame([(100, c) for c in (104, 105, 114, 115, 149, 150, 90, 1000)], "b int, c int")
    assert [r[0] for r in marks.select(stats.regression(F.col("b"), F.col("c"))).collect()] == ["none", "minor", "minor", "moderate", "moderate", "severe", "none", "severe"]
    assert [r.g for r in query.exactly_one(rows.where("x = 7").select("g")).collect()] == ["b"]
    with pytest.raises(Exception, match="exactly one"):
        query.exactly_one(rows).collect()
