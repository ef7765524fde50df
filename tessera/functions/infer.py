"""The value ladder as Column expressions: a cell's text becomes a tagged struct inside whole-stage code.

Order: null and booleans, ditto, tensor, reference, expression, alias, number, string. The variants for CSV and XML text
differ as the tables below say. Nothing here needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A typed cell: ``k`` is null, bool, int, float, string, ref, tensor, expr, ditto or error; ``s`` has the text or the message.
CELL = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("ref_type", T.StringType()),
        T.StructField("ref_id", T.StringType()),
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)

# The lexical rules of tokens and literals.
KEY_TOKEN = r"^[a-z_][a-z0-9_]*$"
TYPE_NAME = r"^[A-Z][A-Za-z0-9]*$"
ID_TOKEN = r"^[A-Za-z_][A-Za-z0-9_\-]*$"
REFERENCE = r"^@(?:([A-Z][A-Za-z0-9]*):)?([A-Za-z_][A-Za-z0-9_\-]*)$"
INTEGER = r"^-?[0-9]+$"
#: A float has a point that isn't last; an exponent may follow.
DECIMAL = r"^-?[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?$"
TENSOR = r"^\[[0-9.,\-\[\] \t]*\]$"


def is_key_token(c: Column) -> Column:
    return c.rlike(KEY_TOKEN)


def is_type_name(c: Column) -> Column:
    return c.rlike(TYPE_NAME)


def is_id_token(c: Column) -> Column:
    return c.rlike(ID_TOKEN)


def parse_reference(c: Column) -> Column:
    """``@Type:id`` or ``@id`` as a struct of type and id; null if malformed."""
    kind = F.regexp_extract(c, REFERENCE, 1)
    return F.when(c.rlike(REFERENCE), F.struct(F.when(kind != "", kind).alias("type"), F.regexp_extract(c, REFERENCE, 2).alias("id")))


def reference_text(kind: Column, ident: Column) -> Column:
    return F.concat(F.lit("@"), F.coalesce(F.concat(kind, F.lit(":")), F.lit("")), ident)


def parse_int(c: Column) -> Column:
    """A 64-bit integer, or null. Plain casts accept blanks, ``+1`` and ``1d``; the pattern doesn't."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    d = F.when(c.rlike(DECIMAL), c.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def cell(k: str, **values: Column) -> Column:
    return F.struct(*[(F.lit(k) if f.name == "k" else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CELL.fields])


def number(text: Column) -> Column:
    """An int or float cell, or null. Integers beyond 64 bits aren't numbers. Texts of usual length are cast once, without a second look."""
    whole, real, long = text.rlike(INTEGER), text.rlike(DECIMAL), F.octet_length(text) > 18
    exact, finite = parse_int(text), parse_float(text)
    return (
        F.when(~text.rlike("^-?[0-9]"), F.lit(None).cast(CELL))
        .when(~text.contains("."), F.when(whole & ~long, cell("int", i=text.cast("bigint"))).when(whole & exact.isNotNull(), cell("int", i=exact)))
        .when(real & ~long & ~text.rlike("[eE]"), cell("float", d=text.cast("double")))
        .when(real & finite.isNotNull(), cell("float", d=finite))
    )


def tensor(text: Column) -> Column:
    """Tensors of rank one and two with their shape; null for other text. Higher ranks and ragged ones are left to the text source."""
    one = F.from_json(F.when(text.rlike(r"^\[[^\[\]]*\]$"), text), "array<double>")
    two = F.from_json(F.when(text.rlike(r"^\[\s*\[[^\[\]]*\](\s*,\s*\[[^\[\]]*\])*\s*\]$"), text), "array<array<double>>")
    return F.when(
        text.rlike(TENSOR),
        F.coalesce(
            F.when(two.isNotNull(), cell("tensor", shape=F.array(F.size(two), F.size(F.get(two, F.lit(0)))), data=F.flatten(two))),
            F.when(one.isNotNull(), cell("tensor", shape=F.array(F.size(one)), data=one)),
        ),
    )


def alias_value(text: Column) -> Column:
    """An alias expands to a boolean, a number or a string, never to null."""
    return F.coalesce(F.when(text.isin("true", "false"), cell("bool", b=text == "true")), number(text), cell("string", s=text))


def infer_cell(text: Column, quoted: Column | None = None, aliases: Column | None = None, ditto: bool = True) -> Column:
    """The value ladder. ``aliases`` is a map from names to texts; ``quoted`` marks text that is a string as it stands."""
    t = F.trim(text)
    ref = parse_reference(t)
    expanded = F.try_element_at(aliases, F.substr(t, F.lit(2))) if aliases is not None else F.lit(None).cast("string")
    ladder = (
        F.when(t == "~", cell("null"))
        .when(t.isin("true", "false"), cell("bool", b=t == "true"))
        .when(F.lit(ditto) & (t == "^"), cell("ditto"))
        .when(t.startswith("[") & tensor(t).isNotNull(), tensor(t))
        .when(t.startswith("@"), F.coalesce(F.when(ref.isNotNull(), cell("ref", ref_type=ref["type"], ref_id=ref["id"])), cell("error", s=F.concat(F.lit("invalid reference: "), t))))
        .when(t.startswith("$("), F.when(t.endswith(")"), cell("expr", s=t)).otherwise(cell("error", s=F.concat(F.lit("invalid expression: "), t))))
        .when(t.startswith("%"), F.coalesce(F.when(expanded.isNotNull(), alias_value(expanded)), cell("error", s=F.concat(F.lit("undefined alias: "), t))))
        .otherwise(F.coalesce(number(t), cell("string", s=t)))
    )
    if quoted is None:
        return F.when(text.isNotNull(), ladder)
    return F.when(text.isNotNull(), F.when(quoted, cell("string", s=F.replace(text, F.lit('""'), F.lit('"')))).otherwise(ladder))


def kind_of(text: Column) -> Column:
    """The kind that the ladder gives a cell, without its value; aliases aren't looked up."""
    t = F.trim(text)
    long = F.octet_length(t) > 18
    number_kind = (
        F.when(~t.rlike("^-?[0-9]"), F.lit(None).cast("string"))
        .when(~t.contains("."), F.when(t.rlike(INTEGER) & (~long | t.try_cast("bigint").isNotNull()), "int"))
        .when(t.rlike(DECIMAL) & ((~long & ~t.rlike("[eE]")) | parse_float(t).isNotNull()), "float")
    )
    return (
        F.when(t == "~", "null")
        .when(t.isin("true", "false"), "bool")
        .when(t == "^", "ditto")
        .when(t.startswith("["), F.when(tensor(t).isNotNull(), "tensor").otherwise("string"))
        .when(t.startswith("@"), F.when(t.rlike(REFERENCE), "ref").otherwise("error"))
        .when(t.startswith("$("), F.when(t.endswith(")"), "expr").otherwise("error"))
        .when(t.startswith("%"), "alias")
        .otherwise(F.coalesce(number_kind, F.lit("string")))
    )


def infer_csv_cell(text: Column) -> Column:
    """The ladder of CSV cells: empty is null, ``+1`` and exponents are numbers, not-a-number and infinities have names."""
    t = F.trim(text)
    ref = parse_reference(t)
    integer = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    real = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    special = F.when(t == "NaN", F.lit(float("nan"))).when(t == "Infinity", F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    return (
        F.when(text.isNull() | (t == "") | (t == "~"), cell("null"))
        .when(t.isin("true", "false"), cell("bool", b=t == "true"))
        .when(special.isNotNull(), cell("float", d=special))
        .when(ref.isNotNull(), cell("ref", ref_type=ref["type"], ref_id=ref["id"]))
        .when(t.startswith("$(") & t.endswith(")"), cell("expr", s=t))
        .when(integer.isNotNull(), cell("int", i=integer))
        .when(real.isNotNull(), cell("float", d=real))
        .when(tensor(t).isNotNull(), tensor(t))
        .otherwise(cell("string", s=t))
    )


def csv_kind_tests(c: Column) -> dict[str, Column]:
    """Predicates by which a column's type is inferred from sampled texts; null, ``~`` and the word null are skipped."""
    t = F.trim(c)
    empty = c.isNull() | t.isin("", "~", "null")
    return {
        "bool": empty | t.isin("true", "false"),
        "int": empty | (t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull()),
        "float": empty | t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        "null": empty,
    }


def typed_or_string(c: Column, kind: str) -> Column:
    """A cell of the column's type, or a string where the text doesn't fit it."""
    t = F.trim(c)
    tests = csv_kind_tests(c)
    typed = {"bool": cell("bool", b=t == "true"), "int": cell("int", i=t.try_cast("bigint")), "float": cell("float", d=t.try_cast("double")), "string": cell("string", s=t), "null": cell("null")}[kind]
    return F.when(c.isNull() | t.isin("", "~"), cell("null")).when(tests.get(kind, F.lit(True)) & (t != "null"), typed).otherwise(cell("string", s=t))


def as_float(c: Column) -> Column:
    """The number of a cell; integers are widened."""
    return F.coalesce(c["d"], c["i"].cast("double"))


def display(c: Column) -> Column:
    """A cell as text; tensors are named only."""
    return (
        F.when(c["k"] == "null", F.lit("~"))
        .when(c["k"] == "bool", c["b"].cast("string"))
        .when(c["k"] == "int", c["i"].cast("string"))
        .when(c["k"] == "float", c["d"].cast("string"))
        .when(c["k"] == "ref", reference_text(c["ref_type"], c["ref_id"]))
        .when(c["k"] == "tensor", F.lit("[tensor]"))
        .otherwise(c["s"])
    )


def as_json(c: Column) -> Column:
    """A cell as JSON: references and expressions are text, tensors have shape and data."""
    return (
        F.when(c["k"] == "null", F.lit("null"))
        .when(c["k"].isin("bool", "int"), display(c))
        .when(c["k"] == "float", F.when(F.isnan(c["d"]) | (F.abs(c["d"]) == float("inf")), F.lit("null")).otherwise(c["d"].cast("string")))
        .when(c["k"] == "tensor", F.to_json(F.struct(F.struct(c["shape"].alias("shape"), c["data"].alias("data")).alias("tensor"))))
        .otherwise(F.regexp_extract(F.to_json(F.struct(display(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    )


def property_cell(text: Column) -> Column:
    """A text property of a graph as a cell: references and tensors are told by their first character."""
    ref = parse_reference(text)
    return F.when(text.isNull(), cell("null")).when(ref.isNotNull(), cell("ref", ref_type=ref["type"], ref_id=ref["id"])).when(tensor(text).isNotNull(), tensor(text)).otherwise(cell("string", s=text))
