"""JSONPath compiled to Column expressions over the variant type.

Root, children by name or index (negative from the end), slices, wildcards, recursive descent, unions of selectors, and filters with comparisons, existence, ``&&``,
``||``, ``!`` and parentheses. A path becomes a chain of array functions over variants, evaluated row by row without a shuffle;
where it gives many values they are exploded at the end. Recursive descent unrolls some levels and walks on below them, to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of ``..`` that are unrolled; those below are walked in a loop.
UNROLLED = 8


class PathError(ValueError):
    """A path that isn't well-formed."""


@dataclass(frozen=True)
class Step:
    selectors: tuple
    deep: bool = False


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Slice:
    start: int | None
    stop: int | None
    step: int


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Filter:
    test: Any


_TOKEN = re.compile(r"""\s*(?:(?P<op>&&|\|\||==|!=|<=|>=|<|>|!|\(|\))|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)\b|(?P<path>[@$](?:\.\.?(?:[A-Za-z_][\w]*|\*)|\[(?:[^\[\]'"]|'[^']*'|"[^"]*")*\])*))""")


def parse(path: str) -> list[Step]:
    if not path or path[0] not in "$@":
        raise PathError(f"a path starts with $: {path!r}")
    steps, at = [], 1
    while at < len(path):
        deep = path.startswith("..", at)
        if deep:
            at += 2
        elif path[at] == ".":
            at += 1
        elif path[at] != "[":
            raise PathError(f"unexpected {path[at]!r} at {at} in {path!r}")
        if at < len(path) and path[at] == "[":
            inner, at = _bracket(path, at)
            steps.append(Step(tuple(_selector(s) for s in _split(inner)), deep))
            continue
        m = re.compile(r"\*|[^\W\d][\w]*").match(path, at)
        if not m:
            raise PathError(f"a name is missing at {at} in {path!r}")
        steps.append(Step((Wild() if m[0] == "*" else Name(m[0]),), deep))
        at = m.end()
    return steps


def _bracket(path: str, at: int) -> tuple[str, int]:
    depth, quote, i = 0, "", at
    while i < len(path):
        c = path[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
            if not depth:
                return path[at + 1 : i], i + 1
        i += 1
    raise PathError(f"unclosed bracket in {path!r}")


def _split(inner: str) -> list[str]:
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(inner):
        if quote:
            quote = "" if c == quote and inner[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == "," and not depth:
            parts.append(inner[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, inner[last:]]]


def _selector(text: str) -> Any:
    if text == "*":
        return Wild()
    if text[:1] == "?":
        return Filter(_Tests(text[1:]).whole())
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return Name(re.sub(r"\\(.)", r"\1", text[1:-1]))
    if re.fullmatch(r"-?\d+", text):
        return Index(int(text))
    m = re.fullmatch(r"\s*(-?\d*)\s*:\s*(-?\d*)\s*(?::\s*(-?\d*)\s*)?", text)
    if m:
        start, stop, step = (int(x) if x else None for x in m.groups())
        if step is not None and step < 1:
            raise PathError("slices go forward")
        return Slice(start, stop, step or 1)
    raise PathError(f"unknown selector {text!r}")


class _Tests:
    """A filter's boolean expression, by precedence: or, and, not, comparison."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def whole(self) -> tuple:
        out = self.either()
        if self.peek()[0] != "end":
            raise PathError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.peek() == ("op", "||"):
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.single()
        while self.peek() == ("op", "&&"):
            self.take()
            out = ("and", out, self.single())
        return out

    def single(self) -> tuple:
        if self.peek() == ("op", "!"):
            self.take()
            return ("not", self.single())
        if self.peek() == ("op", "("):
            self.take()
            out = self.either()
            if self.take() != ("op", ")"):
                raise PathError("unclosed parenthesis")
            return out
        left = self.operand()
        if self.peek()[1] in ("==", "!=", "<", "<=", ">", ">="):
            return ("compare", self.take()[1], left, self.operand())
        if left[0] != "path":
            raise PathError("a test needs a path or a comparison")
        return ("exists", left[1])

    def operand(self) -> tuple:
        kind, text = self.take()
        if kind == "path":
            return ("path", tuple(parse(text)))
        if kind == "str":
            return ("value", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "num":
            return ("value", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "word":
            return ("value", {"true": True, "false": False, "null": None}[text])
        raise PathError(f"an operand is missing before {text!r}")


# ---- columns

_ELEMENTS = "array<variant>"


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _none() -> Column:
    return F.array().cast(_ELEMENTS)


def _elements(v: Column) -> Column:
    """Elements of an array, in order; none for anything else."""
    return F.when(_is_array(v), F.try_variant_get(v, "$", _ELEMENTS)).otherwise(_none())


def _members(v: Column) -> Column:
    """Elements of an array or values of an object."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.when(_is_array(v), F.try_variant_get(v, "$", _ELEMENTS)).when(_is_object(v), values).otherwise(_none())


def _one(v: Column) -> Column:
    return F.when(v.isNotNull(), F.array(v)).otherwise(_none())


def _select(v: Column, selector: Any) -> Column:
    if isinstance(selector, Name):
        if re.fullmatch(r"[A-Za-z_]\w*", selector.name):
            value = F.try_variant_get(v, f"$.{selector.name}", "variant")
        else:  # a name that the engine's own paths can't write
            value = F.try_element_at(F.try_variant_get(v, "$", "map<string, variant>"), F.lit(selector.name))
        return F.when(_is_object(v), _one(value)).otherwise(_none())
    if isinstance(selector, Wild):
        return _members(v)
    items = _elements(v)
    if isinstance(selector, Index):
        return _one(F.try_element_at(items, F.lit(selector.at + 1 if selector.at >= 0 else selector.at)))
    if isinstance(selector, Slice):
        n = F.size(items)

        def bound(x: int | None, default: Column) -> Column:
            return default if x is None else F.least(n, F.greatest(F.lit(0), F.lit(x) if x >= 0 else n + x))

        start, stop = bound(selector.start, F.lit(0)), bound(selector.stop, n)
        return F.filter(items, lambda _, i: (i >= start) & (i < stop) & ((i - start) % selector.step == 0))
    return F.filter(_members(v), lambda x: _test(x, selector.test))


def _chooser(selector: Any) -> Callable[[Column], Column]:
    return lambda v: _select(v, selector)


def _below(level: Column) -> Column:
    """All values below those of ``level``, level by level down to the last."""
    none = _none()

    def down(acc: Column, _: Column) -> Column:
        following = F.flatten(F.transform(acc["level"], _members))
        return F.when(F.size(acc["level"]) > 0, F.struct(following.alias("level"), F.concat(acc["all"], following).alias("all"))).otherwise(acc)

    # There are at most as many levels as opening brackets, those in strings included.
    brackets = F.aggregate(level, F.lit(0), lambda n, v: n + F.coalesce(F.regexp_count(F.to_json(v), F.lit(r"[\[{]")), F.lit(0)))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), brackets)), F.struct(level.alias("level"), none.alias("all")), down, lambda acc: acc["all"])
    return F.when(F.exists(level, lambda v: F.size(_members(v)) > 0), walked).otherwise(none)


def _apply(found: Column, step: Step) -> Column:
    if step.deep:
        level, levels = found, [found]
        for _ in range(UNROLLED):
            level = F.flatten(F.transform(level, _members))
            levels.append(level)
        found = F.concat(*levels, _below(level))
    parts = [F.flatten(F.transform(found, _chooser(s))) for s in step.selectors]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _found(v: Column, steps) -> Column:
    out = _one(v)
    for step in steps:
        out = _apply(out, step)
    return out


def _scalar(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _text_of(v: Column) -> Column:
    """The text of a string; null for other kinds."""
    return F.when(F.schema_of_variant(v) == "STRING", _scalar(v, "string"))


def _number_of(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _scalar(v, "double"))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _test(v: Column, test: tuple) -> Column:
    op = test[0]
    if op == "or":
        return _test(v, test[1]) | _test(v, test[2])
    if op == "and":
        return _test(v, test[1]) & _test(v, test[2])
    if op == "not":
        return ~_test(v, test[1])
    if op == "exists":
        return F.size(_found(v, test[1])) > 0
    _, sign, left, right = test
    if sign == "!=":
        return ~_test(v, ("compare", "==", left, right))
    if left[0] == "value" and right[0] == "path":
        return _test(v, ("compare", {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}[sign], right, left))
    if left[0] == "value":
        try:
            return F.lit({"==": left[1] == right[1], "<": left[1] < right[1], "<=": left[1] <= right[1], ">": left[1] > right[1], ">=": left[1] >= right[1]}[sign])
        except TypeError:
            return F.lit(False)
    a = F.get(_found(v, left[1]), F.lit(0))
    if right[0] == "path":
        b = F.get(_found(v, right[1]), F.lit(0))
        result = F.coalesce(_COMPARE[sign](_number_of(a), _number_of(b)), _COMPARE[sign](_text_of(a), _text_of(b)))
        if sign in ("==", "<=", ">="):
            result = F.coalesce(result, (F.to_json(a) == F.to_json(b)), a.isNull() & b.isNull())
        return F.coalesce(result, F.lit(False))
    value = right[1]
    if value is None:
        return F.coalesce(F.is_variant_null(a), F.lit(False)) if sign in ("==", "<=", ">=") else F.lit(False)
    if isinstance(value, bool):
        return F.coalesce((F.schema_of_variant(a) == "BOOLEAN") & (_scalar(a, "boolean") == value), F.lit(False)) if sign in ("==", "<=", ">=") else F.lit(False)
    if isinstance(value, str):
        return F.coalesce(_COMPARE[sign](_text_of(a), F.lit(value)), F.lit(False))
    return F.coalesce(_COMPARE[sign](_number_of(a), F.lit(float(value))), F.lit(False))


def select(json: Column, path: str, most: int = 0) -> Column:
    """All that a path gives for a JSON text, as an array of variants; ``most`` of them if it isn't zero."""
    out = _found(F.try_parse_json(json), parse(path))
    return F.slice(out, 1, most) if most else out


def as_text(v: Column) -> Column:
    """A variant as text: strings as they are, all else as JSON."""
    return F.coalesce(_text_of(v), F.to_json(v))


def values(df: DataFrame, json: Column, path: str, keep: list[str], most: int = 0) -> DataFrame:
    """One row for each value that the path gives, as text, with the columns to keep."""
    return df.select(*keep, F.explode(select(json, path, most)).alias("v_")).select(*keep, as_text(F.col("v_")).alias("value"))


def first(df: DataFrame, json: Column, path: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, as_text(F.get(select(json, path), F.lit(0))).alias("value"))


def single(df: DataFrame, json: Column, path: str, keep: list[str]) -> DataFrame:
    """The only value of each row; an action fails where a path gives none or several."""
    found = select(json, path)
    return df.select(*keep, F.when(F.size(found) == 1, as_text(F.get(found, F.lit(0)))).otherwise(F.raise_error(F.lit("the path must give exactly one value"))).alias("value"))


def count(df: DataFrame, json: Column, path: str, keep: list[str], name: str = "count") -> DataFrame:
    return df.select(*keep, F.size(select(json, path)).cast("bigint").alias(name))


def exists(df: DataFrame, json: Column, path: str, keep: list[str], name: str = "exists") -> DataFrame:
    return df.select(*keep, (F.size(select(json, path)) > 0).alias(name))
