"""One parsed document: scalars, objects and tables of nodes, as all formats share them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

KEY = re.compile(r"[a-z_][a-z0-9_]*\Z")
TYPE = re.compile(r"[A-Z][A-Za-z0-9]*\Z")
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*\Z")
_REF = re.compile(r"@(?:([A-Z][A-Za-z0-9]*):)?([A-Za-z_][A-Za-z0-9_\-]*)\Z")

#: Kinds of errors that a document can have.
KINDS = ("Syntax", "Version", "Schema", "Alias", "Shape", "Semantic", "OrphanRow", "Collision", "Reference", "Security", "Conversion", "IO")


class DocumentError(ValueError):
    def __init__(self, kind: str, message: str, line: int = 0):
        super().__init__(f"{kind} error at line {line}: {message}")
        self.kind, self.message, self.line = kind, message, line


@dataclass(frozen=True)
class Ref:
    type: str | None
    id: str

    def __str__(self) -> str:
        return f"@{self.type}:{self.id}" if self.type else f"@{self.id}"


@dataclass(frozen=True)
class Expr:
    """The text between ``$(`` and ``)``."""

    text: str

    def __str__(self) -> str:
        return f"$({self.text})"


@dataclass
class Tensor:
    """Nested lists of floats; they may be ragged."""

    items: Any

    def flat(self) -> list[float]:
        out: list[float] = []

        def walk(x: Any) -> None:
            if isinstance(x, list):
                for y in x:
                    walk(y)
            else:
                out.append(x)

        walk(self.items)
        return out

    def shape(self) -> list[int]:
        out, x = [], self.items
        while isinstance(x, list):
            out.append(len(x))
            x = x[0] if x else None
        return out


@dataclass(slots=True)
class Node:
    type: str
    id: str
    values: list[Any]
    line: int = 0
    hint: int | None = None
    children: dict[str, list[Node]] = field(default_factory=dict)
    #: Columns of the children's types, for types that no schema declares.
    columns: list[str] | None = None


@dataclass
class Table:
    type: str
    columns: list[str]
    rows: list[Node] = field(default_factory=list)
    hint: int | None = None
    line: int = 0


@dataclass
class Document:
    root: dict[str, Any] = field(default_factory=dict)
    version: tuple[int, int] = (1, 0)
    schemas: dict[str, list[str]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    nests: dict[str, str] = field(default_factory=dict)
    lines: dict[str, int] = field(default_factory=dict)

    def tables(self) -> Iterator[tuple[str, Table]]:
        """Tables at any depth of objects, with the path of keys."""

        def walk(items: dict[str, Any], path: str) -> Iterator[tuple[str, Table]]:
            for key in sorted(items):
                item, at = items[key], f"{path}.{key}" if path else key
                if isinstance(item, Table):
                    yield at, item
                elif isinstance(item, dict):
                    yield from walk(item, at)

        return walk(self.root, "")

    def columns_of(self, kind: str, width: int) -> list[str]:
        known = self.schemas.get(kind)
        return known if known and len(known) >= width else [f"field_{i}" for i in range(width)]


def walk_nodes(nodes: list[Node], parent: Node | None = None, depth: int = 0) -> Iterator[tuple[Node, Node | None, int, str | None]]:
    """Nodes in document order with parent, depth and the key of their list under the parent."""
    for node in nodes:
        yield node, parent, depth, None
        for key, own in node.children.items():
            for child, above, level, inner in walk_nodes(own, node, depth + 1):
                yield child, above, level, inner or key


# ---- the value ladder in Python, for texts that are read document by document


def parse_ref(text: str) -> Ref | None:
    m = _REF.match(text)
    return Ref(m[1], m[2]) if m else None


def parse_number(text: str) -> int | float | None:
    if re.fullmatch(r"-?[0-9]+", text):
        n = int(text)
        return n if -(1 << 63) <= n < 1 << 63 else None
    if re.fullmatch(r"-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?", text):
        d = float(text)
        return d if math.isfinite(d) else None
    return None


def parse_tensor(text: str) -> Tensor | None:
    """A tensor literal, or None where the text has other characters or unbalanced brackets. Malformed ones raise ``ValueError``."""
    if not re.fullmatch(r"\[[0-9.,\-\[\] \t]*\]", text):
        return None
    depth = 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if depth < 0:
            return None
    if depth:
        return None

    def read(at: int) -> tuple[list, int]:
        out: list = []
        at += 1
        while True:
            while text[at] in " \t":
                at += 1
            if text[at] == "]":
                if not out:
                    raise ValueError("empty tensor")
                raise ValueError("a value is missing")
            if text[at] == "[":
                value, at = read(at)
            else:
                m = re.compile(r"-?[0-9]+(\.[0-9]+)?").match(text, at)
                if not m:
                    raise ValueError(f"invalid number at {at}")
                value, at = float(m[0]), m.end()
            out.append(value)
            while text[at] in " \t":
                at += 1
            if text[at] == "]":
                return out, at + 1
            if text[at] != ",":
                raise ValueError(f"unexpected {text[at]!r}")
            at += 1

    items, end = read(0)
    if text[end:].strip():
        raise ValueError("text after the tensor")
    return Tensor(items)


_EXPR_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.|"")*")|(?P<num>-?[0-9]+(?:\.[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[().,]))')


def check_expression(text: str) -> Any:
    """The tree of an expression: literals, names, calls and access by dots. ``ValueError`` if it doesn't fit the grammar."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _EXPR_TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:].strip()[0]!r} in expression")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place]

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal place
        got = tokens[place]
        if want is not None and got[1] != want:
            raise ValueError(f"expected {want!r} in expression")
        place += 1
        return got

    def whole() -> Any:
        kind, word = take()
        if kind == "str":
            out: Any = ("literal", word[1:-1].replace('""', '"'))
        elif kind == "num":
            out = ("literal", float(word) if "." in word else int(word))
        elif kind == "name":
            out = ("literal", word == "true") if word in ("true", "false") else ("name", word)
        elif word == "(":
            out = whole()
            take(")")
        else:
            raise ValueError("unexpected end or mark in expression")
        while True:
            if peek()[1] == "(":
                if out[0] != "name":
                    raise ValueError("only names are called")
                take()
                args = []
                if peek()[1] != ")":
                    args.append(whole())
                    while peek()[1] == ",":
                        take()
                        args.append(whole())
                take(")")
                out = ("call", out[1], args)
            elif peek()[1] == ".":
                take()
                kind, word = take()
                if kind != "name":
                    raise ValueError("a field name is missing")
                out = ("access", out, word)
            else:
                return out

    tree = whole()
    if peek()[0] != "end":
        raise ValueError("text after the expression")
    return tree


def expanded(text: str) -> Any:
    """An alias's value: boolean, number or string."""
    if text in ("true", "false"):
        return text == "true"
    number = parse_number(text)
    return text if number is None else number


# ---- text of values


def float_text(x: float, whole: str = ".0") -> str:
    """Digits without an exponent; whole numbers end in ``whole``."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if x == math.floor(x):
        return f"{x:.0f}{whole}"
    text = repr(x)
    if "e" not in text:
        return text
    from decimal import Decimal

    return format(Decimal(text), "f")


def singular_type(key: str) -> str:
    """The type that a key names: singular, words with capitals, no underscores."""
    if key.endswith("ies") and len(key) > 3:
        key = key[:-3] + "y"
    elif key.endswith("es") and len(key) > 2:
        key = key[:-2] if key[:-2].endswith(("ss", "sh", "ch", "x")) else key[:-1]
    elif key.endswith("s") and len(key) > 1:
        key = key[:-1]
    return "".join(p[0].upper() + p[1:] for p in key.split("_") if p)
