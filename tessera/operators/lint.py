"""Data-quality rules: each takes the tables and returns diagnostics; a run is their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least first.
SEVERITIES = ["hint", "warning", "error"]
MOST_DIAGNOSTICS = 10_000
Rule = Callable[[dict[str, DataFrame]], DataFrame]


def _found(df: DataFrame, rule: str, severity: str, message, line=None) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"))


def id_naming(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids of one byte, and ids of digits and underscores only. An id may be both."""
    nodes = tables["nodes"]
    short = _found(nodes.where(F.octet_length("id") == 1), "id-naming", "hint", F.concat(F.lit("id '"), F.col("id"), F.lit("' is very short")), "line")
    numeric = _found(nodes.where(F.col("id").rlike("^[0-9_]*$") & F.col("id").rlike("[0-9]")), "id-naming", "hint", F.concat(F.lit("id '"), F.col("id"), F.lit("' is only a number")), "line")
    return short.unionByName(numeric)


def unused_schema(tables: dict[str, DataFrame]) -> DataFrame:
    declared = tables["schemas"].select("doc_id", "type").distinct()
    used = tables["nodes"].select("doc_id", "type").union(tables["lists"].select("doc_id", "type")).distinct()
    return _found(declared.join(used, ["doc_id", "type"], "left_anti"), "unused-schema", "warning", F.concat(F.lit("type '"), F.col("type"), F.lit("' is declared but not used")))


def unused_alias(tables: dict[str, DataFrame]) -> DataFrame:
    """Aliases that no line of the document names. Not run by default."""
    return _found(tables["aliases"].where("uses = 0"), "unused-alias", "warning", F.concat(F.lit("alias '"), F.col("name"), F.lit("' is not used")))


def empty_list(tables: dict[str, DataFrame]) -> DataFrame:
    return _found(tables["lists"].where("n_rows = 0"), "empty-list", "hint", F.concat(F.lit("list '"), F.col("list_key"), F.lit("' is empty")), "line")


def unqualified_reference(tables: dict[str, DataFrame]) -> DataFrame:
    bare = tables["items"].where((F.col("value.k") == "ref") & F.col("value.ref_type").isNull())
    return _found(bare, "unqualified-kv-ref", "warning", F.concat(F.lit("reference '@"), F.col("value.ref_id"), F.lit("' has no type")), "line")


RULES: dict[str, Rule] = {"id-naming": id_naming, "unused-schema": unused_schema, "empty-list": empty_list, "unqualified-kv-ref": unqualified_reference}
EXTRA_RULES: dict[str, Rule] = {"unused-alias": unused_alias}


def run(tables: dict[str, DataFrame], disabled: tuple[str, ...] = (), enabled: tuple[str, ...] = (), custom: dict[str, Rule] | None = None, least: str = "hint", escalate: bool = False, most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """Diagnostics of the rules, from severity ``least``, warnings raised to errors on request, ``most`` of them at most."""
    rules = {**RULES, **{k: EXTRA_RULES[k] for k in enabled}, **(custom or {})}
    found = reduce(DataFrame.unionByName, [rule(tables) for name, rule in rules.items() if name not in disabled])
    if escalate:
        found = found.withColumn("severity", F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")))
    wanted = SEVERITIES[SEVERITIES.index(least) :]
    return found.where(F.col("severity").isin(*wanted)).orderBy("doc_id", "line", "rule", "message").limit(most)
