"""Documents from and to JSON, YAML, XML, CSV and the compact object notation.

JSON and YAML share one tree form. Each function handles one document; ``tables`` and ``files`` spread documents over tasks.
"""

from __future__ import annotations

import csv as csvlib
import io
import json
import math
import re
import xml.etree.ElementTree as ET
from typing import Any

from .document import Document, DocumentError, Expr, Node, Ref, Table, Tensor, check_expression, float_text, parse_number, parse_ref, parse_tensor, singular_type

DEFAULT_COLUMNS = ["id"]
MAX_DEPTH = 10_000


# ---- tree form, of JSON and YAML


def to_tree(doc: Document, metadata: bool = False, flatten: bool = False, children: bool = True) -> dict[str, Any]:
    """Nested dicts and lists: references as ``{"@ref": …}``, tables as lists of objects, children under their type."""

    def value(v: Any) -> Any:
        if isinstance(v, Ref):
            return {"@ref": str(v)}
        if isinstance(v, Tensor):
            return _finite(v.items)
        if isinstance(v, Expr):
            return str(v)
        if isinstance(v, float) and not math.isfinite(v):
            return None
        return v

    def row(node: Node, columns: list[str]) -> dict[str, Any]:
        out = {c: value(v) for c, v in zip(columns, node.values)}
        if metadata:
            out["__type__"] = node.type
        if children:
            for kind, own in sorted(node.children.items()):
                out[kind] = [row(n, n.columns or doc.columns_of(n.type, len(n.values))) for n in own]
        return out

    def item(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: item(x[k]) for k in sorted(x)}
        if not isinstance(x, Table):
            return value(x)
        rows = [row(n, x.columns) for n in x.rows]
        if metadata and not flatten:
            out = {"__type__": x.type, "__schema__": x.columns, "items": rows}
            return out | ({"__count_hint__": x.hint} if x.hint is not None else {})
        return rows

    return {k: item(doc.root[k]) for k in sorted(doc.root)}


def _finite(x: Any) -> Any:
    if isinstance(x, list):
        return [_finite(y) for y in x]
    return x if math.isfinite(x) else None


def from_tree(tree: Any, max_depth: int = MAX_DEPTH) -> Document:
    """Objects, tables (arrays of objects, by the keys of the first, sorted, ``id`` first), tensors (other arrays) and scalars."""
    if not isinstance(tree, dict):
        raise DocumentError("Conversion", "the root must be an object")
    doc = Document()

    def scalar(v: Any) -> Any:
        if isinstance(v, str) and v.startswith("$(") and v.endswith(")"):
            try:
                check_expression(v[2:-1])
            except ValueError as e:
                raise DocumentError("Conversion", f"invalid expression: {e}") from None
            return Expr(v[2:-1])
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        if isinstance(v, int):
            return v if -(1 << 63) <= v < 1 << 63 else float(v)
        if isinstance(v, float):
            return v
        return str(v)  # dates that YAML recognises

    def numbers(xs: list) -> list:
        out = []
        for x in xs:
            if isinstance(x, list):
                out.append(numbers(x))
            elif isinstance(x, (int, float)) and not isinstance(x, bool):
                out.append(float(x))
            else:
                raise DocumentError("Conversion", "arrays hold objects, or numbers only")
        return out

    def is_objects(v: Any) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)

    def cell(v: Any) -> Any:
        if isinstance(v, dict):
            if isinstance(v.get("@ref"), str):
                return reference(v["@ref"])
            raise DocumentError("Conversion", "a nested object isn't allowed in a cell")
        if isinstance(v, list):
            return None if is_objects(v) else Tensor(numbers(v))
        return scalar(v)

    def reference(text: str) -> Ref:
        ref = parse_ref(text)
        if ref is None:
            raise DocumentError("Conversion", f"invalid reference: {text}")
        return ref

    def table(rows: list[dict], key: str, depth: int, kind: str | None = None, columns: list[str] | None = None) -> Table:
        if depth > max_depth:
            raise DocumentError("Security", f"depth exceeds {max_depth}")
        kind = kind or singular_type(key)
        if columns is None:
            columns = sorted(k for k, v in rows[0].items() if not k.startswith("__") and not is_objects(v))
            if "id" in columns:
                columns = ["id", *[c for c in columns if c != "id"]]
        columns = columns or DEFAULT_COLUMNS
        doc.schemas[kind] = columns
        out = Table(kind, columns, hint=len(rows))
        for row in rows:
            ident = row.get(columns[0])
            node = Node(kind, ident if isinstance(ident, str) else "", [cell(row.get(c)) for c in columns])
            for k in sorted(row):
                if is_objects(row[k]):
                    child = table(row[k], k, depth + 1)
                    node.children[child.type] = child.rows
                    doc.nests.setdefault(kind, child.type)
            out.rows.append(node)
        return out

    def item(v: Any, key: str, depth: int) -> Any:
        if depth > max_depth:
            raise DocumentError("Security", f"depth exceeds {max_depth}")
        if isinstance(v, dict):
            if isinstance(v.get("@ref"), str):
                return reference(v["@ref"])
            if isinstance(v.get("items"), list) and isinstance(v.get("__type__"), str):
                columns = v.get("__schema__") if isinstance(v.get("__schema__"), list) else None
                return table(v["items"], key, depth + 1, v["__type__"], columns) if v["items"] else Table(v["__type__"], columns or DEFAULT_COLUMNS, hint=0)
            return {str(k): item(x, str(k), depth + 1) for k, x in v.items() if not str(k).startswith("__")}
        if isinstance(v, list):
            if not v:
                kind = singular_type(key)
                doc.schemas.setdefault(kind, DEFAULT_COLUMNS)
                return Table(kind, DEFAULT_COLUMNS, hint=0)
            return table(v, key, depth + 1) if is_objects(v) else Tensor(numbers(v))
        return scalar(v)

    doc.root = {str(k): item(v, str(k), 0) for k, v in tree.items() if not str(k).startswith("__")}
    return doc


def from_json(text: str) -> Document:
    try:
        return from_tree(json.loads(text))
    except json.JSONDecodeError as e:
        raise DocumentError("Conversion", f"invalid JSON: {e.msg}", e.lineno) from None
    except RecursionError:
        raise DocumentError("Security", "the document is nested too deeply") from None


def to_json(doc: Document, pretty: bool = True, **options: Any) -> str:
    return json.dumps(to_tree(doc, **options), ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def from_yaml(text: str) -> Document:
    import yaml

    class Loader(yaml.SafeLoader):
        """Tags are ignored."""

    Loader.add_multi_constructor("!", lambda loader, _, node: loader.construct_scalar(node) if isinstance(node, yaml.ScalarNode) else loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True))
    try:
        tree = yaml.load(text, Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise DocumentError("Conversion", f"invalid YAML: {e}") from None
    return from_tree({} if tree is None else tree)


def to_yaml(doc: Document, metadata: bool = True, **options: Any) -> str:
    import yaml

    return yaml.safe_dump(to_tree(doc, metadata=metadata, **options), allow_unicode=True, sort_keys=False)


def json_lines(text: str) -> list[Document | DocumentError]:
    """A document for each line that isn't blank or a comment; a bad line gives its error."""
    out: list[Document | DocumentError] = []
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            try:
                out.append(from_json(line))
            except DocumentError as e:
                out.append(DocumentError(e.kind, e.message, n))
    return out


# ---- XML

#: Attributes that mark references and nested rows. On reading, any name between the underscores is taken.
REF_MARK, CHILD_MARK = "__node_type__", "__node_child__"
_REF_ATTRIBUTE, _CHILD_ATTRIBUTE = re.compile(r"__\w*type__\Z"), re.compile(r"__\w*child__\Z")


def snake(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.rpartition("}")[2])).lower()


def xml_value(text: str) -> Any:
    """The ladder of XML text: empty is null, then expression, boolean, integer, number, string."""
    text = text.strip()
    if not text:
        return None
    if text.startswith("$(") and text.endswith(")"):
        return Expr(text[2:-1])
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    try:
        if "_" not in text:
            return float(text)
    except ValueError:
        pass
    return text


def from_xml(text: str) -> Document:
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise DocumentError("Security", "document types and entities aren't allowed")
    try:
        root = ET.fromstring(text.encode("utf-8"))
    except ET.ParseError as e:
        raise DocumentError("Conversion", f"invalid XML: {e}", e.position[0]) from None
    doc = Document()
    m = re.fullmatch(r"([0-9]+)\.([0-9]+)", root.get("version", ""))
    if m:
        doc.version = int(m[1]), int(m[2])

    def table(kind: str, found: list[Any]) -> Table:
        first = next((x for x in found if isinstance(x, dict)), {})
        columns = ["id", *sorted(k for k, v in first.items() if k != "id" and not isinstance(v, (dict, Table)))]
        doc.schemas[kind] = columns
        out = Table(kind, columns, hint=len(found))
        for n, x in enumerate(found):
            x = x if isinstance(x, dict) else {"id": str(n), "value": x}
            ident = x.get("id")
            ident = ident if isinstance(ident, str) else "" if ident is None else str(ident)
            node = Node(kind, ident, [ident, *[x.get(c) for c in columns[1:]]])
            for key, own in x.items():
                if isinstance(own, Table):
                    node.children[own.type] = own.rows
                    doc.nests.setdefault(kind, own.type)
            out.rows.append(node)
        return out

    def numeric(x: Any) -> bool:
        return isinstance(x, (int, float)) and not isinstance(x, bool) or isinstance(x, Tensor)

    def element(e: ET.Element) -> Any:
        attributes = {snake(k): v for k, v in e.attrib.items() if not _REF_ATTRIBUTE.match(k) and not _CHILD_ATTRIBUTE.match(k)}
        if len(e):
            plain: dict[str, list] = {}
            nested: dict[str, list] = {}
            for c in e:
                marked = any(_CHILD_ATTRIBUTE.match(k) and v == "true" for k, v in c.attrib.items())
                (nested if marked else plain).setdefault(c.tag.rpartition("}")[2] if marked else snake(c.tag), []).append(element(c))
            out: dict[str, Any] = {}
            for key, found in plain.items():
                if len(found) == 1:
                    out[key] = found[0]
                elif key == "item" and all(map(numeric, found)):
                    out[key] = Tensor([x.items if isinstance(x, Tensor) else float(x) for x in found])
                else:
                    out[key] = table(singular_type(key), found)
            for kind, found in nested.items():
                out[snake(kind)] = table(kind[:1].upper() + kind[1:], found)
            if len(out) == 1:
                key, only = next(iter(out.items()))
                if isinstance(only, Tensor) and key == "item":
                    return only
                if not isinstance(only, Table) and e.get("type", "").lower() == key.replace("_", "") and key:
                    only = table(e.get("type"), [only])  # a list with one row, which its type tells
                    return only
                if isinstance(only, Table) and singular_type(snake(e.tag)).lower() == singular_type(key).lower():
                    kind = e.get("type") or only.type
                    doc.schemas[kind] = doc.schemas.pop(only.type)
                    only.type = kind
                    for n in only.rows:
                        n.type = kind
                    return only
            return out
        text = (e.text or "").strip()
        if text:
            if any(_REF_ATTRIBUTE.match(k) and v == "ref" for k, v in e.attrib.items()):
                ref = parse_ref(text)
                if ref is None:
                    raise DocumentError("Conversion", f"invalid reference: {text}")
                return ref
            return xml_value(text)
        return {k: xml_value(v) for k, v in attributes.items()} if attributes else None

    plain: dict[str, list] = {}
    for c in root:
        plain.setdefault(snake(c.tag), []).append(element(c))
    doc.root = {k: v[0] if len(v) == 1 else table(singular_type(k), v) for k, v in plain.items()}
    return doc


def to_xml(doc: Document, root: str = "document", metadata: bool = True, pretty: bool = True) -> str:
    top = ET.Element(root, {"version": f"{doc.version[0]}.{doc.version[1]}"} if metadata else {})

    def tensor(e: ET.Element, x: list) -> None:
        for y in x:
            inner = ET.SubElement(e, "item")
            if isinstance(y, list):
                tensor(inner, y)
            else:
                inner.text = float_text(y, "")

    def put(e: ET.Element, key: str, v: Any) -> None:
        if isinstance(v, dict):
            inner = ET.SubElement(e, key)
            for k in sorted(v):
                put(inner, k, v[k])
        elif isinstance(v, Table):
            inner = ET.SubElement(e, key, {"type": v.type} if metadata else {})
            for node in v.rows:
                row(inner, v.type.lower(), node, v.columns, {})
        else:
            inner = ET.SubElement(e, key, {REF_MARK: "ref"} if isinstance(v, Ref) else {})
            if isinstance(v, Tensor):
                tensor(inner, v.items)
            elif v is not None:
                inner.text = str(v).lower() if isinstance(v, bool) else float_text(v, "") if isinstance(v, float) else _xml_safe(str(v))

    def row(e: ET.Element, tag: str, node: Node, columns: list[str], marks: dict[str, str]) -> None:
        inner = ET.SubElement(e, tag, marks)
        for c, v in zip(columns, node.values):
            put(inner, c, v)
        for kind, own in sorted(node.children.items()):
            for n in own:
                row(inner, kind, n, n.columns or doc.columns_of(n.type, len(n.values)), {CHILD_MARK: "true"})

    for key in sorted(doc.root):
        put(top, key, doc.root[key])
    if pretty:
        ET.indent(top)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(top, encoding="unicode")


def _xml_safe(text: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)


# ---- CSV


def from_csv(text: str, kind: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True, trim: bool = True, max_rows: int = 1_000_000, sample: int = 100, infer: bool = True, key: str | None = None) -> Document:
    """One table. Column types come from a sample of rows; a cell that doesn't fit its column's type stays a string."""
    rows = [r for r in csvlib.reader(io.StringIO(text), delimiter=delimiter) if r]
    names = [c.strip() for c in rows.pop(0)] if header and rows else []
    columns = columns or names
    if not columns:
        raise DocumentError("Conversion", "a table needs columns")
    if len(rows) > max_rows:
        raise DocumentError("Security", f"more than {max_rows} rows")
    if trim:
        rows = [[c.strip() for c in r] for r in rows]
    for n, r in enumerate(rows, 1 + header):
        if len(r) != len(columns):
            raise DocumentError("Shape", f"expected {len(columns)} columns, got {len(r)}", n)
        if not r[0]:
            raise DocumentError("Semantic", "empty id", n)
    kinds = [csv_type([r[i] for r in rows[:sample]]) if infer else None for i in range(len(columns))]
    table = Table(kind, list(columns), hint=len(rows))
    for n, r in enumerate(rows, 1 + header):
        table.rows.append(Node(kind, r[0], [r[0], *[csv_value(c, k) for c, k in zip(r[1:], kinds[1:])]], n))
    return Document(root={key or kind.lower() + "s": table}, schemas={kind: list(columns)})


def csv_type(values: list[str]) -> str:
    seen = [v.strip() for v in values if v.strip() not in ("", "~", "null")]
    for kind, test in (("null", lambda v: False), ("bool", lambda v: v in ("true", "false")), ("int", lambda v: re.fullmatch(r"[+-]?[0-9]+", v) and -(1 << 63) <= int(v) < 1 << 63), ("float", lambda v: re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v))):
        if all(map(test, seen)):
            return kind
    return "string"


def csv_value(text: str, kind: str | None = None) -> Any:
    text = text.strip()
    if text in ("", "~"):
        return None
    if kind == "bool" and text in ("true", "false"):
        return text == "true"
    if kind == "int" and csv_type([text]) == "int":
        return int(text)
    if kind == "float" and csv_type([text]) in ("int", "float"):
        return float(text)
    if kind in ("bool", "int", "float"):
        return text
    if text in ("true", "false"):
        return text == "true"
    if text in ("NaN", "Infinity", "-Infinity"):
        return float(text.replace("Infinity", "inf"))
    if text.startswith("@") and parse_ref(text):
        return parse_ref(text)
    if text.startswith("$(") and text.endswith(")"):
        return Expr(text[2:-1])
    guess = csv_type([text])
    if guess in ("int", "float"):
        return int(text) if guess == "int" else float(text)
    try:
        return parse_tensor(text) or text
    except ValueError:
        return text


def to_csv(doc: Document, name: str | None = None, delimiter: str = ",", header: bool = True) -> str:
    """The first table in key order, or the one with a name. Children are left out, null is empty."""
    found = dict(doc.tables())
    if name is not None and name not in found:
        raise DocumentError("Conversion", f"no list '{name}'; there are: {', '.join(found) or 'none'}")
    if not found:
        raise DocumentError("Conversion", "the document has no list")
    table = found[name if name is not None else next(iter(found))]
    out = io.StringIO()
    writer = csvlib.writer(out, delimiter=delimiter, lineterminator="\n")
    if header:
        writer.writerow(table.columns)
    for node in table.rows:
        writer.writerow([csv_text(v) for v in node.values])
    return out.getvalue()


def csv_text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("Infinity" if v > 0 else "-Infinity") if math.isinf(v) else float_text(v, "")
    if isinstance(v, Tensor):
        return json.dumps(_whole(v.items), separators=(",", ":"))
    return str(v)


def _whole(x: Any) -> Any:
    return [_whole(y) for y in x] if isinstance(x, list) else int(x) if math.isfinite(x) and x == int(x) else x


# ---- the compact object notation

_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def compact_text(v: Any, delimiter: str = ",") -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            return "null"
        if v == 0 or abs(v - round(v)) < 2.220446049250313e-16:
            return str(round(v))
        return f"{v:.15f}".rstrip("0").rstrip(".")
    if isinstance(v, Tensor):
        flat = v.flat()
        return f"[{len(flat)}] {delimiter.join(float_text(x, '') for x in flat)}"
    return _compact_string(str(v), delimiter)


def _compact_string(s: str, delimiter: str) -> str:
    plain = s and s not in ("true", "false", "null") and not re.match(r"[@\s0-9-]", s) and not re.search(r'[:\[\]{}"\\\n\r\t]', s) and delimiter not in s and not s[-1].isspace()
    return s if plain else json.dumps(s, ensure_ascii=False)


def _compact_key(key: str) -> str:
    return key if _BARE.match(key) else json.dumps(key, ensure_ascii=False)


def to_compact(doc: Document, delimiter: str = ",", indent: int = 2) -> str:
    """Tables of plain values as a header and delimited rows, others as lists of objects."""
    from ..functions.text import IRREGULAR

    if delimiter not in (",", "\t", "|"):
        raise DocumentError("Conversion", f"unknown delimiter {delimiter!r}")
    out: list[str] = []
    mark = "" if delimiter == "," else delimiter

    def put(depth: int, text: str) -> None:
        out.append(" " * (indent * depth) + text)

    def table(key: str, columns: list[str], rows: list[Node], hint: int | None, depth: int) -> None:
        name = _compact_key(key)
        if not rows:
            put(depth, f"{name}[0{mark}]:")
        elif all(not n.children and not any(isinstance(v, Tensor) for v in n.values) for n in rows):
            put(depth, f"{name}[{hint if hint is not None else len(rows)}{mark}]{{{delimiter.join(map(_compact_key, columns))}}}:")
            for n in rows:
                put(depth + 1, delimiter.join(compact_text(v, delimiter) for v in n.values))
        else:
            put(depth, f"{name}[{hint if hint is not None else len(rows)}{mark}]:")
            for n in rows:
                for i, (c, v) in enumerate(zip(columns, n.values)):
                    put(depth + 1 + (i > 0), f"{'' if i else '- '}{_compact_key(c)}: {compact_text(v, delimiter)}")
                for kind, own in sorted(n.children.items()):
                    low = kind.lower()
                    table(IRREGULAR.get(low, low + "s"), doc.columns_of(kind, len(own[0].values)) if own else [], own, None, depth + 2)

    def items(found: dict[str, Any], depth: int) -> None:
        for key in sorted(found):
            v = found[key]
            if isinstance(v, dict):
                put(depth, f"{_compact_key(key)}:")
                items(v, depth + 1)
            elif isinstance(v, Table):
                table(key, v.columns, v.rows, v.hint, depth)
            else:
                put(depth, f"{_compact_key(key)}: {compact_text(v, delimiter)}")

    items(doc.root, 0)
    return "\n".join(out)


_ARRAY = re.compile(r'((?:[A-Za-z_][\w.]*|"(?:[^"\\]|\\.)*"))\[(\d+)([|\t]?)\](?:\{(.*)\})?:\Z')


def from_compact(text: str) -> Document:
    lines = [(len(s) - len(s.lstrip(" ")), s.strip(), n) for n, s in enumerate(text.split("\n"), 1) if s.strip()]
    doc, at = Document(), 0

    def value(s: str) -> Any:
        s = s.strip()
        if s.startswith('"'):
            try:
                s = json.loads(s)
            except json.JSONDecodeError:
                raise DocumentError("Syntax", f"invalid string {s}") from None
            return special(s)
        if s in ("", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        m = re.fullmatch(r"\[(\d+)\] ?(.*)", s)
        if m:
            return Tensor([float(x) for x in re.split(r"[,|\t]", m[2]) if x])
        number = parse_number(s)
        return special(s) if number is None else number

    def special(s: str) -> Any:
        return parse_ref(s) or (Expr(s[2:-1]) if s.startswith("$(") and s.endswith(")") else s)

    def cells(s: str, delimiter: str) -> list[str]:
        return [m[0] for m in re.finditer(rf'"(?:[^"\\]|\\.)*"|[^{re.escape(delimiter)}]+|(?<={re.escape(delimiter)})(?={re.escape(delimiter)}|\Z)|\A(?={re.escape(delimiter)})', s)]

    def key_of(s: str) -> str:
        return json.loads(s) if s.startswith('"') else s

    def pair(s: str, n: int) -> tuple[str, str]:
        m = re.match(r'((?:[^":]+|"(?:[^"\\]|\\.)*")):(?: |\Z)(.*)', s)
        if not m:
            raise DocumentError("Syntax", f"expected 'key: value', got {s!r}", n)
        return key_of(m[1]), m[2]

    def array(m: re.Match, level: int, n: int) -> Table:
        nonlocal at
        key, count, delimiter = key_of(m[1]), int(m[2]), m[3] or ","
        kind = singular_type(key)
        columns = [key_of(c.strip()) for c in cells(m[4], delimiter)] if m[4] is not None else None
        out = Table(kind, columns or DEFAULT_COLUMNS, hint=count, line=n)
        while at < len(lines) and lines[at][0] > level:
            depth, s, row_line = lines[at]
            if columns is not None:
                at += 1
                values = [value(c) for c in cells(s, delimiter)]
                if len(values) != len(columns):
                    raise DocumentError("Shape", f"expected {len(columns)} columns, got {len(values)}", row_line)
                out.rows.append(Node(kind, str(values[0]), values, row_line))
                continue
            if not s.startswith("- "):
                raise DocumentError("Syntax", "expected a list item", row_line)
            lines[at] = (depth + 2, s[2:], row_line)
            fields = items(depth + 2)
            plain = {k: v for k, v in fields.items() if not isinstance(v, (dict, Table))}
            out.columns = list(plain) if not out.rows else out.columns
            node = Node(kind, str(next(iter(plain.values()), "")), [plain.get(c) for c in out.columns], row_line)
            for child in fields.values():
                if isinstance(child, Table):
                    node.children[child.type] = child.rows
                    doc.nests.setdefault(kind, child.type)
            out.rows.append(node)
        if len(out.rows) != count:
            raise DocumentError("Shape", f"declared {count} rows, got {len(out.rows)}", n)
        doc.schemas[kind] = out.columns
        return out

    def items(level: int) -> dict[str, Any]:
        nonlocal at
        found: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == level and not (lines[at][1].startswith("- ")):
            _, s, n = lines[at]
            at += 1
            m = _ARRAY.match(s)
            if m:
                found[key_of(m[1])] = array(m, level, n)
                continue
            key, rest = pair(s, n)
            if rest.strip():
                found[key] = value(rest)
            elif at < len(lines) and lines[at][0] > level:
                found[key] = items(lines[at][0])
            else:
                found[key] = {}
        return found

    doc.root = items(0)
    if at < len(lines):
        raise DocumentError("Syntax", "unexpected indentation", lines[at][2])
    return doc


# ---- schemas of documents


def json_schema(doc: Document, title: str = "Document", strict: bool = False) -> dict[str, Any]:
    """A draft-07 schema: a definition for each type, with the kinds of the first row."""
    definitions: dict[str, Any] = {}

    def of(v: Any, name: str) -> dict[str, Any]:
        if v is None:
            return {"type": "null"}
        if isinstance(v, bool):
            return {"type": "boolean"}
        if isinstance(v, int):
            return {"type": "integer"}
        if isinstance(v, float):
            return {"type": "number"}
        if isinstance(v, Ref):
            return {"type": "object", "properties": {"@ref": {"type": "string", "pattern": "^@([A-Z][A-Za-z0-9]*:)?[A-Za-z_][A-Za-z0-9_-]*$"}}, "required": ["@ref"]}
        if isinstance(v, Tensor):
            inner: dict[str, Any] = {"type": "number"}
            for _ in v.shape():
                inner = {"type": "array", "items": inner}
            return inner
        if isinstance(v, Expr):
            return {"type": "string", "pattern": r"^\$\(.*\)$"}
        kind = text_format(v, name)
        return {"type": "string"} | ({"format": kind} if kind else {})

    def define(kind: str, columns: list[str], rows: list[Node]) -> None:
        if kind in definitions:
            return
        first = rows[0].values if rows else []
        definitions[kind] = {"type": "object", "properties": {c: of(first[i], c) if i < len(first) else {"type": "string"} for i, c in enumerate(columns)}, "required": columns[:1], "additionalProperties": not strict}
        for node in rows:
            for child, own in node.children.items():
                define(child, doc.columns_of(child, len(own[0].values)), own)

    def item(v: Any, name: str) -> dict[str, Any]:
        if isinstance(v, dict):
            return {"type": "object", "properties": {k: item(v[k], k) for k in sorted(v)}}
        if isinstance(v, Table):
            define(v.type, v.columns, v.rows)
            return {"type": "array", "items": {"$ref": f"#/definitions/{v.type}"}}
        return of(v, name)

    properties = {k: item(doc.root[k], k) for k in sorted(doc.root)}
    for kind, columns in sorted(doc.schemas.items()):
        define(kind, columns, [])
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": title, "type": "object", "properties": properties, "definitions": definitions}


def text_format(text: str, name: str = "") -> str | None:
    if "@" in text and "." in text and not text.startswith("@"):
        return "email"
    if text.startswith(("http://", "https://", "ftp://")):
        return "uri"
    if "T" in text and any(c in text for c in "Z+-") and len(text.encode("utf-8")) >= 19:
        return "date-time"
    if len(text) == 36 and text.count("-") == 4:
        return "uuid"
    low = name.lower()
    for words, kind in ((("email",), "email"), (("url", "uri"), "uri"), (("date",), "date-time"), (("uuid", "guid"), "uuid")):
        if any(w in low for w in words) or kind == "date-time" and low.endswith(("_at", "_on")):
            return kind
    return None


def check_schema(schema: Any) -> None:
    """A schema's own structure: known types, objects where objects belong, references that have a definition."""
    known = {"null", "boolean", "integer", "number", "string", "array", "object"}
    if not isinstance(schema, dict):
        raise DocumentError("Schema", "a schema is an object")

    def walk(x: Any, path: str) -> None:
        if not isinstance(x, dict):
            raise DocumentError("Schema", f"not a schema at {path}")
        if "type" in x and not (x["type"] in known if isinstance(x["type"], str) else set(x["type"]) <= known):
            raise DocumentError("Schema", f"unknown type at {path}")
        for key in ("properties", "definitions"):
            for name, inner in x.get(key, {}).items():
                walk(inner, f"{path}/{key}/{name}")
        if "items" in x:
            walk(x["items"], f"{path}/items")
        ref = x.get("$ref")
        if ref is not None and ref.rpartition("/")[2] not in schema.get("definitions", {}):
            raise DocumentError("Schema", f"no definition for {ref}")

    walk(schema, "#")
