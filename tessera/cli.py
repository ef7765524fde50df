"""Commands: one document, conversions, and whole folders with Spark. ``python -m tessera.cli --help``."""

from __future__ import annotations

import argparse
import json
import sys

from . import api
from .sources.document import DocumentError

NAMES = {"json": "json", "yaml": "yaml", "xml": "xml", "csv": "csv", "compact": "compact"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, many: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("file", nargs="+" if many else None)
        if not many:
            p.add_argument("-o", "--output")
        return p

    add("validate", "parse, check references").add_argument("--lenient", action="store_true")
    p = add("format", "canonical text")
    p.add_argument("--no-ditto", action="store_true")
    p.add_argument("--with-counts", action="store_true")
    add("inspect", "header and entity counts")
    add("stats", "sizes in each format")
    add("schema", "JSON schema")
    lint = add("lint", "diagnostics")
    lint.add_argument("--warn-error", action="store_true")
    for name in NAMES:
        add(f"to-{name}", f"table text to {name}")
        p = add(f"from-{name}", f"{name} to table text")
        if name == "csv":
            p.add_argument("--type", default="Row")
    add("to-parquet", "nodes of a document to a Parquet folder")
    p = add("from-parquet", "rows of a Parquet table to JSON lines of nodes")
    p.add_argument("--type", default="Row")
    for name, about in (("batch-validate", "validate files"), ("batch-format", "canonical text of files"), ("batch-lint", "lint files")):
        p = add(name, about, many=True)
        p.add_argument("-o", "--output")
    return top


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").getOrCreate()


def run(arguments: list[str]) -> int:
    a = parser().parse_args(arguments)
    try:
        out, code = _run(a)
    except DocumentError as e:
        print(e, file=sys.stderr)
        return 1
    if getattr(a, "output", None) and out:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    elif out:
        print(out)
    return code


def _run(a: argparse.Namespace) -> tuple[str, int]:
    kind, _, name = a.command.partition("-")
    if a.command.startswith("batch-") or a.command in ("lint", "to-parquet", "from-parquet"):
        return _with_spark(a)
    with open(a.file, encoding="utf-8", newline="") as f:
        text = f.read()
    if a.command == "validate":
        found = api.validate(text, not a.lenient)
        return json.dumps(found), 0 if found["valid"] else 1
    if a.command == "format":
        return api.format_text(text, ditto=not a.no_ditto, with_counts=a.with_counts).rstrip("\n"), 0
    if a.command == "inspect":
        return json.dumps(api.inspect(text), indent=2), 0
    if a.command == "stats":
        return json.dumps(api.stats(text), indent=2), 0
    if a.command == "schema":
        return api.schema(text), 0
    if kind == "to":
        return api.convert(text, "text", NAMES[name]).rstrip("\n"), 0
    return api.convert(text, NAMES[name], "text", read={"kind": a.type} if name == "csv" else None).rstrip("\n"), 0


def _with_spark(a: argparse.Namespace) -> tuple[str, int]:
    from functools import reduce

    from .sources import tables

    spark = _spark()
    if a.command == "from-parquet":
        return "\n".join(tables.read_parquet_rows(spark, a.file, a.type).toJSON().take(1_000_000)), 0
    paths = a.file if isinstance(a.file, list) else [a.file]
    docs = reduce(lambda x, y: x.union(y), [api.read(spark, p) for p in paths])
    if a.command == "to-parquet":
        tables.write_parquet(tables.parse(docs, "nodes"), a.output or f"{paths[0]}.parquet")
        a.output = None
        return "", 0
    if a.command == "batch-format":
        results = api.format_all(docs)
        if a.output:
            api.write_text(results, a.output)
            a.output = None
        counts = api.outcome(results).first()
        return json.dumps(counts.asDict()), int(counts.failed > 0)
    if a.command == "batch-validate":
        bad = [r.asDict(True) for r in api.validate_all(docs, with_lint=False).where("NOT valid").collect()]
        return "\n".join(map(json.dumps, bad)), int(bool(bad))
    found = [r.asDict() for r in api.lint_all(docs, escalate=getattr(a, "warn_error", False)).collect()]
    return "\n".join(map(json.dumps, found)), int(any(r["severity"] == "error" for r in found))


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
