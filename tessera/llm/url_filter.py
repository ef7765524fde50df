"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join, with DataFrame functions only.

The list has canonical entries of a host, a path prefix and a verdict. An entry fits its host and all subdomains of it if
the url's path starts with the entry's; the longest entry wins. A url is looked up by its expansions: every
suffix of its host at a label border, with every prefix of its path of a length that occurs in the list. The filter drops
nearly all expansions that aren't listed; an equi-join on the whole entry removes its false positives.

The filter is a table of 64-bit blocks. It is broadcast only if its size, computed from the number of entries, is under
``max_broadcast_bytes``; beyond that the joins on the block number and on the entry are shuffles.
Hosts and paths are looked up once per distinct pair, so a hot url costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: The rules to judge pages by.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
BITS_PER_ENTRY = 16
BITS_SET = 4


def rules(spark: SparkSession) -> DataFrame:
    """``RULES`` as a table of host, path and verdict."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _key() -> Column:
    return F.concat_ws("/", F.col("host"), F.col("path"))  # a host has no slash and paths start with one, or are empty


def _mask(h: Column) -> Column:
    """The bits that an entry sets in its block."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_SET)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    df = df.withColumn("key_", _key()).withColumn("h_", F.xxhash64("key_"))
    return df.withColumn("block_", F.pmod(F.xxhash64("key_", F.lit(1)), F.lit(blocks))).withColumn("mask_", _mask(F.col("h_")))


def filter_urls(spark: SparkSession, pages: DataFrame, entries: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (host and path of the entry that wins, else null), verdict.

    Null urls and urls without ``://`` have an empty host and path, and only an entry for the empty host would fit
    them. Of entries of one length the one with the longer host wins; of entries listed twice, ``allow``. Repeated
    rows and keys give as many rows. Other columns are not read. ``default`` is the verdict where no entry fits.
    """
    listed = entries.select("host", "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    size = listed.agg(F.count("*").alias("n"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    lengths = sorted(size.lengths or [0])  # no more than a url has characters
    blocks = max(1, -(-size.n * BITS_PER_ENTRY // 64))
    bloom = _hashed(listed, blocks).groupBy("block_").agg(F.bit_or("mask_").alias("bits_"))
    if blocks * 32 <= max_broadcast_bytes:
        bloom = F.broadcast(bloom)

    urls = pages.select(F.col(key).alias("key"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    looked = pairs.select("host", "path", F.explode(suffixes).alias("s"), prefixes.alias("p")).select("host", "path", "s", F.explode(F.filter("p", lambda x: x.isNotNull())).alias("p"))
    looked = looked.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("s").alias("host"), F.col("p").alias("path"))
    possible = _hashed(looked, blocks).join(bloom, "block_").where(F.col("bits_").bitwiseAND(F.col("mask_")) == F.col("mask_"))
    hits = possible.select("of_host", "of_path", "host", "path").join(listed, ["host", "path"])
    best = hits.groupBy(F.col("of_host").alias("host"), F.col("of_path").alias("path")).agg(
        F.max(F.struct((F.char_length("host") + F.char_length("path")).alias("n"), F.char_length("host").alias("m"), F.concat("host", "path").alias("rule"), "verdict")).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, load(spark, sf_dir, "pages"), rules(spark))


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (
  SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS rn
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE rn = 1
"""
