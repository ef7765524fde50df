"""What a caller does with documents, by name: validate, format, lint, inspect, count, query, convert, and over many files at once."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import lint as rules
from .operators import query as lookups
from .sources import formats, tables, treetext
from .sources.document import Document, DocumentError, walk_nodes

FORMATS = tuple(tables.WRITERS)


# ---- one document


def parse(text: bytes | str, strict: bool = True) -> Document:
    return treetext.parse(text, strict)


def validate(text: bytes | str, strict: bool = True) -> dict[str, Any]:
    """Whether a document is valid, and its error if not."""
    try:
        doc = treetext.parse(text, strict)
    except DocumentError as e:
        return {"valid": False, "kind": e.kind, "message": e.message, "line": e.line}
    return {"valid": True, "version": f"{doc.version[0]}.{doc.version[1]}", "schemas": len(doc.schemas), "aliases": len(doc.aliases), "nests": len(doc.nests), "items": len(doc.root)}


def format_text(text: bytes | str, ditto: bool = True, with_counts: bool = False, inline: bool = False, always_quote: bool = False) -> str:
    doc = treetext.parse(text)
    if with_counts:
        treetext.add_count_hints(doc)
    return treetext.canonical(doc, always_quote=always_quote, ditto=ditto, inline=inline)


def convert(text: str, source: str, target: str, read: dict[str, Any] | None = None, write: dict[str, Any] | None = None) -> str:
    """A document from one format to another."""
    return tables.WRITERS[target](tables.READERS[source](text, **(read or {})), **(write or {}))


def count_entities(doc: Document) -> dict[str, int]:
    found: dict[str, int] = {}
    for _, table in doc.tables():
        for node, *_ in walk_nodes(table.rows):
            found[node.type] = found.get(node.type, 0) + 1
    return dict(sorted(found.items()))


def inspect(text: bytes | str) -> dict[str, Any]:
    doc = treetext.parse(text)
    return {"version": list(doc.version), "schemas": doc.schemas, "aliases": doc.aliases, "nests": doc.nests, "entities": count_entities(doc), "keys": sorted(doc.root)}


def estimate_tokens(text: str) -> int:
    """(bytes + white space + ASCII punctuation) / 4, whole."""
    return (len(text.encode("utf-8")) + sum(c.isspace() for c in text) + sum(33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 for c in text)) // 4


def stats(text: str) -> dict[str, dict[str, int]]:
    """Bytes and tokens of a document in each format, and the share that the table text saves against it."""
    doc = treetext.parse(text)
    own = len(text.encode("utf-8")), estimate_tokens(text)
    out = {"text": {"bytes": own[0], "tokens": own[1], "saved_bytes": 0, "saved_tokens": 0}}
    for name in FORMATS:
        if name == "text" or name == "csv" and not dict(doc.tables()):
            continue
        other = tables.WRITERS[name](doc)
        size, tokens = len(other.encode("utf-8")), estimate_tokens(other)
        percent = lambda a, b: 0 if not a else int((a - b) * 100 / a + (0.5 if a >= b else -0.5))
        out[name] = {"bytes": size, "tokens": tokens, "saved_bytes": percent(size, own[0]), "saved_tokens": percent(tokens, own[1])}
    return out


def optimize(json_text: str) -> dict[str, Any]:
    """JSON as table text, with the share of tokens saved."""
    out = treetext.canonical(formats.from_json(json_text))
    before, after = estimate_tokens(json_text), estimate_tokens(out)
    return {"text": out, "tokens_before": before, "tokens_after": after, "saved": 0 if not before else round((before - after) * 100 / before)}


def schema(text: bytes | str, **options: Any) -> str:
    return json.dumps(formats.json_schema(treetext.parse(text), **options), indent=2)


# ---- many documents, as DataFrames of ``doc_id, data``


def read(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    return tables.files(spark, path, glob, recursive)


def validate_all(docs: DataFrame, strict: bool = True, least: str = "hint", with_lint: bool = True) -> DataFrame:
    """One row a document: whether it is valid, its error, and how many diagnostics of lint it has."""
    errors = tables.parse(docs, "diagnostics", mode="PERMISSIVE", strict=strict).select("doc_id", F.struct("kind", "message", "line").alias("error"))
    out = docs.select("doc_id").join(errors, "doc_id", "left").withColumn("valid", F.col("error").isNull())
    if not with_lint:
        return out
    found = lint_all(docs, strict=strict, least=least).groupBy("doc_id").agg(F.count("*").alias("diagnostics"))
    return out.join(found, "doc_id", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.lit(0)))


def lint_all(docs: DataFrame, strict: bool = True, **options: Any) -> DataFrame:
    return rules.run(tables.tables(docs, mode="PERMISSIVE", strict=strict), **options)


def format_all(docs: DataFrame, **options: Any) -> DataFrame:
    return tables.convert(docs, "text", "text", mode="PERMISSIVE", write=options)


def outcome(results: DataFrame) -> DataFrame:
    """Total, successes and failures of a conversion."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def query(docs: DataFrame, type_name: str | None = None, ident: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Nodes by type and id, in document order, in pages."""
    found = lookups.entities(tables.parse(docs, "nodes", mode="PERMISSIVE"), type_name, ident)
    return lookups.page(found, ["doc_id", "line", "ord"], offset, limit) if offset or limit is not None else found


def exists(nodes: DataFrame, type_name: str | None, ident: str) -> bool:
    return not lookups.entities(nodes, type_name, ident).isEmpty()


def sizes(docs: DataFrame) -> DataFrame:
    """Bytes and estimated tokens of documents in each format, with what the table text saves."""
    out = None
    for name in FORMATS:
        part = tables.convert(docs, "text", name, mode="PERMISSIVE").where("error IS NULL").select("doc_id", F.lit(name).alias("format"), F.octet_length("text").alias("bytes"), X.estimate_tokens(F.col("text")).alias("tokens"))
        out = part if out is None else out.union(part)
    own = docs.select("doc_id", X.estimate_tokens(F.col("data").cast("string")).alias("own"))
    return out.join(own, "doc_id").withColumn("saved", X.savings_percent(F.col("tokens"), F.col("own"))).drop("own")


def write_text(results: DataFrame, path: str) -> None:
    """Converted documents as a table of ``doc_id, text``."""
    results.where("error IS NULL").select("doc_id", "text").write.parquet(path)
