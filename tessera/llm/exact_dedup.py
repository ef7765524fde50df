"""Exact dedup by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are sorted and get integer names; then
adjacent names are paired, distinct pairs are sorted and named, and so on until each document has one name. Two texts
are equal exactly if they have the same number of blocks and the same last name: names stand for contents, not for
hashes. A 128-bit hash only routes blocks to the table of names; were one hash to stand for two blocks, which the table shows, all
blocks would be hashed anew with another seed, so that a clash of hashes cannot merge documents.

At scale: texts are read twice, once for what is known of each row (numbers and hashes, in a written table) and once for the names, where
block texts are shuffled after map-side combine, so a block that a third of all documents share costs
one row a task; everything else moves integers. Rows halve from level to level. Skewed joins against the tables
of names are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

#: Characters that normalisation deletes.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def block_hash(block: Column, seed: int) -> Column:
    """128 bits, as two integers."""
    return F.struct(F.xxhash64(block, F.lit(seed)).alias("h"), F.xxhash64(block, F.lit(-1 - seed)).alias("g"))


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``rows`` with ``name``, an integer that follows the sort order within each hash partition."""
    return rows.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(data: Column, block_bytes: int) -> Column:
    """The blocks of some bytes; nothing has one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.substring(data, at * block_bytes + 1, F.lit(block_bytes)))


def _facts(docs: DataFrame, scratch: Scratch, block_bytes: int, key: str, text: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A written table of ``row, k, carried columns, chars, sha, hs`` and the names ``h, g, name`` of distinct blocks."""
    own = docs.select(F.col(key).alias("k"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], text_or_empty(text).alias("o"))
    own = own.withColumn("b", F.encode(normalised(F.col("o")), "UTF-8"))
    for seed in range(100):
        hashes = F.transform(_blocks(F.col("b"), block_bytes), lambda block: block_hash(block, seed))
        rows = own.select(F.monotonically_increasing_id().alias("row"), "k", *[f"c_{i}" for i in range(len(carry))], F.char_length("o").cast("long").alias("chars"), F.unhex(F.sha2("b", 256)).alias("sha"), hashes.alias("hs"))
        blocks = own.select(F.explode(_blocks(F.col("b"), block_bytes)).alias("block")).withColumn("x", block_hash(F.col("block"), seed))
        named = _numbered(blocks.select("x.h", "x.g", "block").groupBy("h", "g", "block").agg(F.lit(1).alias("one")), "h", "g", "block")
        names = scratch.keep(named.select("h", "g", "name"), "blocks")
        if names.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return scratch.keep(rows, "rows"), names
        scratch.drop([names])
    raise RuntimeError("hashes of different blocks clash under each seed")


def _identities(rows: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, n, name``: the number of blocks and the last name of each row of ``rows(row, hs)``."""
    # Both sides of the join are written tables, so that adaptive execution can split a block that very many documents share.
    level = rows.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("i", "x")).select("row", "n", "i", "x.h", "x.g").join(names, ["h", "g"]).select("row", "n", "i", "name")
    level = scratch.keep(level, "level")
    done: list[DataFrame] = []
    longest = level.agg(F.max("n")).first()[0] or 1
    width = 1
    while True:
        # A document with at most `width` blocks has one name now.
        done.append(level.where(F.col("n") <= width).select("row", "n", "name"))
        if longest <= width:
            break
        rest = level.where(F.col("n") > width)
        pairs = rest.groupBy("row", "n", F.expr("i div 2").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")
        )
        pairs = scratch.keep(pairs, "pairs")
        paired = scratch.keep(_numbered(pairs.groupBy("l", "r").agg(F.lit(1).alias("one")).select("l", "r"), "l", "r"), "names")
        level = scratch.keep(pairs.join(paired, ["l", "r"]).select("row", "n", "i", "name"), "level")
        scratch.drop([pairs, paired])
        width *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_dedup(spark: SparkSession, docs: DataFrame, block_bytes: int = 4096, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256, n_chars, and the columns named in ``carry``.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most
    code points in its original text stays, then the one with the smallest key, null last. Null text counts as empty, and so do
    texts of white space: all of these are one group. A key that occurs on several rows gives as many rows; ``kept`` is true for
    one row of each group, also where rows repeat as a whole. Texts are read whole, however long. An empty table gives an empty result.
    Other columns are not read, so their names cannot clash.
    """
    scratch = Scratch(spark, "exact-dedup")
    rows, names = _facts(docs, scratch, block_bytes, key, text, carry)
    identities = _identities(rows.select("row", "hs"), names, scratch)
    scratch.drop([names])
    # Both sides of the last join are written tables, so that adaptive execution can split a group with very many copies.
    whole = scratch.keep(rows.drop("hs").join(identities, "row"), "whole")
    scratch.drop([rows])
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("k").isNull().alias("z"), F.col("k").alias("k"), F.col("row").alias("row")))
    groups = scratch.keep(whole.groupBy("n", "name").agg(best.alias("best"), F.count("*").alias("size")), "groups")
    return whole.join(groups, ["n", "name"]).select(
        F.col("k").alias(key), F.col("best.k").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("chars").alias("n_chars"),
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)],
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (SELECT *, sha256(t) AS sha FROM n), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM g
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
"""
