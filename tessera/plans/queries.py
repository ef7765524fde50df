"""Named queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as X
from ..operators import graph, integrity, query, stats, windows
from . import jsonpath

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables as node types: the type's name, its table, its key and the letter before its ids.
TYPES = [("Region", "region", "r_regionkey", "r"), ("Nation", "nation", "n_nationkey", "n"), ("Customer", "customer", "c_custkey", "c"), ("Supplier", "supplier", "s_suppkey", "s"), ("Part", "part", "p_partkey", "p"), ("Order", "orders", "o_orderkey", "o")]
#: Columns that tell lines of an order apart, for orders that don't depend on how rows arrive.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
_LINES = ", ".join(LINE_ORDER)


def query_of(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_ids(spark: SparkSession, sf_dir: str, types=TYPES) -> DataFrame:
    """Type and id of all rows of the tables."""
    out = None
    for kind, name, key, letter in types:
        part = table(spark, sf_dir, name).select(F.lit(kind).alias("type"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"))
        out = part if out is None else out.union(part)
    return out


_NODE_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS type, '{letter}' || {key} AS id FROM {name}" for kind, name, key, letter in TYPES)


# ---- counts and lookup


@query_of(f"SELECT type, count(*)::BIGINT AS count FROM ({_NODE_SQL} UNION ALL SELECT 'LineItem', 'l' FROM lineitem) GROUP BY 1")
def count_entities(spark, d):
    lines = table(spark, d, "lineitem").select(F.lit("LineItem").alias("type"), F.lit("l").alias("id"))
    return stats.count_by_type(node_ids(spark, d).union(lines))


@query_of("SELECT 'Customer' AS type, 'c' || c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 42")
def entity_query_type_id(spark, d):
    nodes = table(spark, d, "customer").select(F.lit("Customer").alias("type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    # The id's number is compared too, so that the lookup is pushed down to the scan.
    return query.entities(nodes.where(F.col("c_custkey") == 42), "Customer", "c42").drop("c_custkey")


@query_of("SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def entity_query_children(spark, d):
    out = query.with_children(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey", F.col("o_orderkey"))
    return out.withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query_of("SELECT type, id FROM (" + _NODE_SQL + ") WHERE contains(lower(id), 'c10') OR contains(lower(type), 'c10')")
def symbol_search(spark, d):
    return query.search(node_ids(spark, d), "C10")


@query_of("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return query.page(rows, ["o_orderkey"], 50, 25)


@query_of("SELECT 'Supplier' AS type, 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'Part', 'p' || p_partkey FROM part")
def exclude_labels(spark, d):
    return query.without(node_ids(spark, d), "type", ["Region", "Nation", "Customer", "Order"])


# ---- references


def _order_edges(spark, d):
    return table(spark, d, "orders").select(F.lit("Order").alias("from_type"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("from_id"), F.lit("o_custkey").alias("column"), F.lit("Customer").alias("ref_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ref_id"))


@query_of("SELECT c_mktsegment, count(*)::BIGINT AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1")
def ref_resolve_qualified(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.lit("Customer").alias("type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_mktsegment")
    edges = integrity.resolved(_order_edges(spark, d), known)
    return edges.join(known.select(F.col("id").alias("ref_id"), "c_mktsegment"), "ref_id").groupBy("c_mktsegment").agg(F.count("*").alias("orders"))


@query_of("SELECT 'o' || o_orderkey AS from_id, 'c' || o_custkey AS ref_id FROM orders WHERE o_custkey % 7 = 0")
def ref_unresolved(spark, d):
    known = query.entities(node_ids(spark, d), "Customer").where("substring(id, 2) % 7 <> 0")
    return integrity.unresolved(_order_edges(spark, d), known).select("from_id", "ref_id")


@query_of("SELECT count(*)::BIGINT AS invalid FROM orders WHERE o_custkey % 7 = 0 AND 'c' || o_custkey NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def ref_invalid(spark, d):
    known = node_ids(spark, d).where("type <> 'Customer' OR substring(id, 2) % 7 <> 0")
    return integrity.invalid(_order_edges(spark, d), known).agg(F.count("*").alias("invalid"))


@query_of("SELECT e.event_type, count(*)::BIGINT AS resolved FROM events e JOIN events p ON p.event_id = e.event_id - 1 WHERE p.event_type <> 'error' GROUP BY 1")
def ref_local(spark, d):
    events = table(spark, d, "events")
    nodes = events.where("event_type <> 'error'").select(F.lit("Event").alias("type"), F.col("event_id").cast("string").alias("id"))
    edges = events.select(F.lit("Event").alias("from_type"), "event_type", F.lit(None).cast("string").alias("ref_type"), (F.col("event_id") - 1).cast("string").alias("ref_id"))
    return integrity.resolved(edges, nodes).groupBy("event_type").agg(F.count("*").alias("resolved"))


@query_of(
    "WITH n AS (SELECT 'Customer' AS type, c_custkey AS k FROM customer UNION ALL SELECT 'Supplier', s_suppkey FROM supplier UNION ALL SELECT 'Part', p_partkey FROM part) "
    "SELECT o_orderkey::VARCHAR AS ref_id, count(DISTINCT type)::BIGINT AS types FROM orders LEFT JOIN n ON k = o_orderkey GROUP BY 1"
)
def ref_ambiguous(spark, d):
    nodes = node_ids(spark, d, [t for t in TYPES if t[0] in ("Customer", "Supplier", "Part")]).withColumn("id", F.substring("id", 2, 20))
    return integrity.unqualified(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ref_id")), nodes)


@query_of("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, min(l_partkey) AS first FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def id_collision(spark, d):
    return integrity.collisions(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query_of("SELECT 'c' || c_custkey AS id, count(*)::BIGINT AS references FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1".replace("references", '"references"'))
def in_degree(spark, d):
    edges = _order_edges(spark, d).select(F.col("ref_type").alias("to_type"), F.col("ref_id").alias("to_id"))
    return graph.in_degree(edges).select(F.col("to_id").alias("id"), "references")


# ---- nesting


@query_of(f"SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY {_LINES}) AS children, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def nest_attach(spark, d):
    lines = table(spark, d, "lineitem")
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER))).alias("x"))
    return own.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"], r["l_suppkey"])), ",").alias("children"), F.size("x").cast("bigint").alias("n"))


@query_of(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS nest_order FROM lineitem")
def nest_sibling_order(spark, d):
    return windows.sibling_order(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER, "nest_order").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "nest_order")


@query_of("SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS parent_id FROM events")
def asof_parent(spark, d):
    return windows.last_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id", F.col("event_type") == "signup", "parent_id").select("event_id", "user_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query_of("SELECT c_custkey, count(o_orderkey)::BIGINT AS child_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1")
def child_count_hint(spark, d):
    return integrity.child_counts(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query_of("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def empty_list(spark, d):
    return integrity.childless(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000"), "c_custkey", "o_custkey")


_EDGE_SQL = """SELECT 'Order' AS from_type, 'Customer' AS to_type, 'O_CUSTKEY' AS rel_type FROM orders UNION ALL SELECT 'LineItem', 'Order', 'L_ORDERKEY' FROM lineitem UNION ALL
SELECT 'Customer', 'Nation', 'C_NATIONKEY' FROM customer UNION ALL SELECT 'Nation', 'Region', 'N_REGIONKEY' FROM nation"""


@query_of(f"SELECT rel_type, from_type, to_type, count(*)::BIGINT AS count FROM ({_EDGE_SQL}) GROUP BY 1, 2, 3")
def edges_by_type(spark, d):
    keys = [("orders", "Order", "o_orderkey", "o_custkey", "Customer", "oc"), ("lineitem", "LineItem", "l_orderkey", "l_orderkey", "Order", "lo"), ("customer", "Customer", "c_custkey", "c_nationkey", "Nation", "cn"), ("nation", "Nation", "n_nationkey", "n_regionkey", "Region", "nr")]
    edges = None
    for name, kind, key, column, target, letters in keys:
        part = graph.foreign_key_edges(table(spark, d, name), kind, key, column, target, tuple(letters))
        edges = part if edges is None else edges.union(part)
    return graph.edges_by_type(edges)


@query_of("SELECT c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 100 AS batch, c_custkey FROM customer")
def cypher_batches(spark, d):
    return windows.batches(table(spark, d, "customer"), ["c_mktsegment"], ["c_custkey"], 100).select("c_mktsegment", "batch", "c_custkey")


# ---- ditto


@query_of(
    "SELECT event_id, event_type, coalesce(event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1, false) AS event_type_ditto FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def ditto_compress(spark, d):
    return windows.ditto_compress(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type", "event_type_ditto")


@query_of("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events")
def ditto_fill(spark, d):
    """Compress and fill again: the values are those of the table, explicit nulls included."""
    rows = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    small = windows.ditto_compress(rows, ["user_id"], ["ts", "event_id"], ["event_type"]).withColumn("event_type", F.when(~F.col("event_type_ditto"), F.col("event_type")))
    return windows.ditto_fill(small, ["user_id"], ["ts", "event_id"], {"event_type": "event_type_ditto"}).select("event_id", "event_type")


# ---- inference

_KIND_SQL = """CASE WHEN t = '~' THEN 'null' WHEN t IN ('true', 'false') THEN 'bool' WHEN t = '^' THEN 'ditto' WHEN regexp_full_match(t, '@(?:([A-Z][A-Za-z0-9]*):)?([A-Za-z_][A-Za-z0-9_\\-]*)') THEN 'ref'
WHEN regexp_full_match(t, '-?[0-9]+') AND try_cast(t AS BIGINT) IS NOT NULL THEN 'int' WHEN regexp_full_match(t, '-?[0-9]+\\.[0-9]+([eE][+-]?[0-9]+)?') THEN 'float' ELSE 'string' END"""
_CELLS_SQL = "SELECT unnest([event_id::VARCHAR, printf('%.2f', value), event_type, '@User:u' || user_id, '@e' || event_id, '~', '^', 'true', props, '1e10', '1.5e3', '+1', '99999999999999999999', '-7']) AS t FROM events"


@query_of(f"SELECT {_KIND_SQL} AS kind, count(*)::BIGINT AS count FROM ({_CELLS_SQL}) GROUP BY 1")
def infer_kind(spark, d):
    fixed = [F.lit(x) for x in ("~", "^", "true")]
    more = [F.lit(x) for x in ("1e10", "1.5e3", "+1", "99999999999999999999", "-7")]
    cells = [F.col("event_id").cast("string"), F.format_string("%.2f", "value"), F.col("event_type"), F.concat(F.lit("@User:u"), F.col("user_id").cast("string")), F.concat(F.lit("@e"), F.col("event_id").cast("string")), *fixed, F.col("props"), *more]
    texts = table(spark, d, "events").select(F.explode(F.array(*cells)).alias("t"))
    return texts.groupBy(infer.kind_of(F.col("t")).alias("kind")).agg(F.count("*").alias("count"))


@query_of("SELECT * FROM (VALUES ('c_custkey', 'int'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'float'), ('c_mktsegment', 'string')) v(\"column\", type)")
def csv_column_type(spark, d):
    rows = table(spark, d, "customer")
    return stats.column_types(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]), rows.columns)


@query_of("SELECT p_partkey, CASE WHEN try_cast(t AS BIGINT) IS NULL THEN 'string' ELSE 'int' END AS kind, coalesce(try_cast(t AS BIGINT), -1) AS i, CASE WHEN try_cast(t AS BIGINT) IS NULL THEN t END AS s FROM (SELECT p_partkey, replace(p_brand, 'Brand#', CASE WHEN p_size > 25 THEN '' ELSE 'B' END) AS t FROM part)")
def typed_fallback(spark, d):
    text = F.when(F.col("p_size") > 25, F.replace("p_brand", F.lit("Brand#"), F.lit(""))).otherwise(F.replace("p_brand", F.lit("Brand#"), F.lit("B")))
    return table(spark, d, "part").select("p_partkey", infer.typed_or_string(text, "int").alias("c")).select("p_partkey", F.col("c.k").alias("kind"), F.coalesce("c.i", F.lit(-1)).alias("i"), "c.s")


@query_of("SELECT page_id, CASE WHEN contains(url, '@') AND contains(url, '.') THEN 'email' WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'ftp://') THEN 'uri' END AS format FROM pages")
def format_detect(spark, d):
    return table(spark, d, "pages").select("page_id", X.string_format(F.col("url")).alias("format"))


# ---- statistics


@query_of(
    "SELECT l_returnflag, arg_min(l_extendedprice, (l_quantity, l_extendedprice)) AS lowest, arg_max(l_extendedprice, (l_quantity, l_extendedprice)) AS highest FROM (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem) GROUP BY 1"
)
def top1_fastest_slowest(spark, d):
    return stats.extremes(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_extendedprice")


@query_of(
    "SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1"
)
def statistics(spark, d):
    return stats.statistics(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query_of("SELECT l_returnflag, " + ", ".join(f"list_sort(list(l_extendedprice))[count(*) * {p} // 100 + 1] AS p{p}" for p in (50, 90, 95, 99)) + " FROM lineitem GROUP BY 1")
def percentiles_nearest(spark, d):
    return stats.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [50, 90, 95, 99])


_PERIODS = "SELECT o_orderpriority AS name, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders GROUP BY 1, 2"


@query_of(
    f"""WITH t AS ({_PERIODS}), j AS (SELECT b.name, b.total AS base, c.total AS current FROM t b JOIN t c ON b.name = c.name WHERE b.y = 1996 AND c.y = 1997),
    p AS (SELECT *, least(floor(greatest((current - base) * 100.0 / base, 0)), 255) AS percent FROM j)
    SELECT name, base, current, round((current - base) / base * 100, 6) AS change, CASE WHEN percent < 5 THEN 'none' WHEN percent < 15 THEN 'minor' WHEN percent < 50 THEN 'moderate' ELSE 'severe' END AS status FROM p"""
)
def regression_compare(spark, d):
    totals = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return stats.compare(totals.where("y = 1996"), totals.where("y = 1997"), "name", "total").withColumn("change", F.round("change", 6))


@query_of(
    """WITH e AS (SELECT l_returnflag AS name, l_quantity AS size, max(l_extendedprice) AS time FROM lineitem GROUP BY 1, 2), g AS (SELECT name, min(size) AS least_size, max(size) AS most_size, arg_min(time, size) AS least_time, arg_max(time, size) AS most_time FROM e GROUP BY 1)
    SELECT name, least_size, most_size, least_time, most_time FROM g WHERE most_size / least_size > 1 AND most_time / least_time > 0.001 * (most_size / least_size) * log2(most_size / least_size)"""
)
def scaling_issue(spark, d):
    points = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("size")).agg(F.max("l_extendedprice").alias("time"))
    return stats.scaling_issues(points, "name", "size", "time", 0.001).drop("size_ratio", "time_ratio")


@query_of("SELECT count(*)::BIGINT AS scalars, 0::BIGINT AS objects, 0::BIGINT AS lists, (SELECT count(*)::BIGINT FROM lineitem) AS nodes, 4::INT AS max_depth FROM region")
def document_stats(spark, d):
    items = table(spark, d, "region").select(F.lit("scalar").alias("kind"), F.lit(0).alias("depth")).union(table(spark, d, "lineitem").select(F.lit("node"), F.lit(4)))
    return stats.document_stats(items)


@query_of("SELECT event_type, string_agg(DISTINCT k, ',' ORDER BY k) AS columns FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS k FROM events UNION ALL SELECT event_type, 'id' FROM events) GROUP BY 1".replace("ORDER BY k", "ORDER BY CASE WHEN k = 'id' THEN '' ELSE k END"))
def schema_union(spark, d):
    keys = F.concat(F.json_object_keys("props"), F.array(F.lit("id")))
    return graph.schema_union(table(spark, d, "events"), "event_type", keys).withColumn("columns", F.array_join("columns", ","))


@query_of("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unused_schema(spark, d):
    declared = table(spark, d, "part").select(F.col("p_partkey").alias("type"))
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("type"))
    return integrity.unused_types(declared, used).withColumnRenamed("type", "p_partkey")


@query_of("SELECT count(*) FILTER (octet_length(c_custkey::VARCHAR::BLOB) = 1)::BIGINT AS short, count(*) FILTER (regexp_full_match(c_custkey::VARCHAR, '[0-9_]*') AND regexp_matches(c_custkey::VARCHAR, '[0-9]'))::BIGINT AS numeric FROM customer".replace("numeric FROM", '"numeric" FROM'))
def lint_id_naming(spark, d):
    from ..operators import lint

    nodes = table(spark, d, "customer").select(F.lit("d").alias("doc_id"), F.lit("Customer").alias("type"), F.col("c_custkey").cast("string").alias("id"), F.lit(0).alias("line"))
    found = lint.id_naming({"nodes": nodes})
    return found.agg(F.count_if(F.col("message").endswith("short")).alias("short"), F.count_if(F.col("message").endswith("number")).alias("numeric"))


# ---- sizes


@query_of(r"SELECT doc_id, (octet_length(text::BLOB) + length(regexp_replace(text, '\S', '', 'g')) + length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g'))) // 4 AS tokens FROM documents".replace("octet_length(text::BLOB)", "strlen(text)"))
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query_of(
    """WITH s AS (SELECT r_name AS name, strlen('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS json, strlen(r_regionkey || ',' || r_name) AS csv FROM region) SELECT name, json, csv, CASE WHEN json = 0 THEN 0 ELSE round((json - csv) * 100.0 / json)::BIGINT END AS savings FROM s"""
)
def savings_pct(spark, d):
    rows = table(spark, d, "region").select(F.col("r_name").alias("name"), F.octet_length(F.to_json(F.struct("r_regionkey", "r_name"))).cast("bigint").alias("json"), F.octet_length(F.concat_ws(",", "r_regionkey", "r_name")).cast("bigint").alias("csv"))
    return rows.withColumn("savings", X.savings_percent(F.col("json"), F.col("csv")))


@query_of("SELECT vec_id, len(embedding)::INT AS n, true AS whole_shape, min_of AS low, max_of AS high FROM (SELECT vec_id, embedding, list_min(embedding) AS min_of, list_max(embedding) AS max_of FROM embeddings)")
def tensor_shape_flatten(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.array("embedding").alias("t"))
    flat = X.tensor_flat(F.col("t"), 2)
    return rows.select("vec_id", F.size(flat).alias("n"), (X.tensor_shape(F.col("t"), 2) == F.array(F.lit(1), F.size("embedding"))).alias("whole_shape"), F.array_min(flat).alias("low"), F.array_max(flat).alias("high"))


@query_of("SELECT word, plural, type FROM (VALUES ('box', 'boxes', 'Box'), ('city', 'cities', 'City'), ('day', 'days', 'Day'), ('user_post', 'user_posts', 'UserPost'), ('class', 'classes', 'Clas')) v(word, plural, type)")
def word_forms(spark, d):
    words = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ("box", "city", "day", "user_post", "class")])).alias("word"))
    return words.select("word", X.plural(F.col("word")).alias("plural"), X.type_name(F.col("word")).alias("type"))


# ---- paths


@query_of("SELECT event_id, (props::JSON->>'$.k') AS value FROM events")
def jsonpath_child(spark, d):
    return jsonpath.values(table(spark, d, "events"), F.col("props"), "$.k", ["event_id"])


@query_of("SELECT conv_id, text AS value FROM conversations")
def jsonpath_wildcard(spark, d):
    return jsonpath.values(_talks(spark, d), F.col("doc"), "$.turns[*].text", ["conv_id"])


@query_of("SELECT conv_id, text AS value FROM conversations WHERE role = 'user' AND turn > 1")
def jsonpath_filter(spark, d):
    return jsonpath.values(_talks(spark, d), F.col("doc"), "$.turns[?@.role == 'user' && @.turn > 1].text", ["conv_id"])


@query_of("SELECT conv_id, role AS value FROM conversations")
def jsonpath_descendant(spark, d):
    return jsonpath.values(_talks(spark, d), F.col("doc"), "$..role", ["conv_id"])


@query_of("SELECT conv_id, count(*) FILTER (role = 'assistant')::BIGINT AS n FROM conversations GROUP BY 1")
def jsonpath_count(spark, d):
    return jsonpath.count(_talks(spark, d), F.col("doc"), "$.turns[?@.role == 'assistant']", ["conv_id"], "n")


@query_of("SELECT conv_id, bool_or(turn = 3) AS found FROM conversations GROUP BY 1")
def jsonpath_exists(spark, d):
    return jsonpath.exists(_talks(spark, d), F.col("doc"), "$.turns[?@.turn == 3]", ["conv_id"], "found")


@query_of("SELECT conv_id, role AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn = 1")
def jsonpath_single(spark, d):
    return jsonpath.values(_talks(spark, d), F.col("doc"), "$.turns[-1].role", ["conv_id"])


def _talks(spark, d):
    """Conversations as JSON documents with the turns in order."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.to_json(F.struct("turns")).alias("doc"))


# ---- the question family


@query_of("SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS finished, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')::BIGINT AS both FROM orders")
def question_agg(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("both"))


@query_of("SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
def question_filter(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query_of("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def question_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    last = orders.agg(F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"), F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey", "o_orderstatus")
    return last.union(orders.where("o_orderkey = 7"))


# ---- formats and streams

_NATIONS = "SELECT 'n' || n_nationkey AS id, n_name AS name, n_regionkey::BIGINT AS region, n_nationkey / 4.0 AS share FROM nation"


def _nation_documents(spark, d):
    """One JSON document for each region with its nations as a table."""
    rows = table(spark, d, "nation").select("n_regionkey", F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"), (F.col("n_nationkey") / 4.0).alias("share")).alias("n"))
    docs = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n")).alias("nations"))
    return docs.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("doc_id"), F.to_json(F.struct("nations")).alias("data"))


def _round_trip(fmt: str):
    @query_of(_NATIONS)
    def query_(spark, d):
        from ..sources import tables

        options = {"kind": "Nation"} if fmt == "csv" else {}
        texts = tables.convert(_nation_documents(spark, d), "json", fmt).select("doc_id", F.col("text").alias("data"))
        nodes = tables.parse(texts, "nodes", fmt, **options)
        return tables.typed_view(nodes, "Nation", {"id": "string", "name": "string", "region": "bigint", "share": "double"}).drop("doc_id")

    QUERIES[f"roundtrip_{'canonical' if fmt == 'text' else fmt}"] = QUERIES.pop("query_")
    SQL[f"roundtrip_{'canonical' if fmt == 'text' else fmt}"] = SQL.pop("query_")


for _fmt in ("text", "json", "yaml", "xml", "compact", "csv"):
    _round_trip(_fmt)


def _shared(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "/tmp/tessera-checkpoints"
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"


@query_of("SELECT 'Nation' AS type, 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'Region', 'r' || r_regionkey, r_name FROM region")
def roundtrip_parquet(spark, d):
    """Nodes to a folder for each type, and back."""
    from ..sources import tables

    parts = []
    for kind, name, key, letter in TYPES[:2]:
        column = F.col("n_name" if kind == "Nation" else "r_name")
        parts.append(table(spark, d, name).select(F.lit("d").alias("doc_id"), F.lit(kind).alias("type"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.create_map(F.lit("name"), infer.cell("string", s=column)).alias("cells")))
    path = _shared(spark, "nodes")
    tables.write_parquet(parts[0].union(parts[1]), path)
    return spark.read.parquet(path).select("type", "id", F.col("cells")["name"]["s"].alias("name"))


@query_of("SELECT event_type AS type, count(*)::BIGINT AS count FROM events GROUP BY 1")
def stream_equals_batch(spark, d):
    """The events as a stream of files, written by micro-batches, counted like the batch."""
    path, name = _shared(spark, "events"), f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(name).schema).parquet(f"{name}*")
    stream.select("event_id", F.col("event_type").alias("type")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stats.count_by_type(spark.read.parquet(f"{path}/out"))


@query_of("SELECT 'CREATE CONSTRAINT region_id IF NOT EXISTS FOR (n:Region) REQUIRE n._node_id IS UNIQUE' AS statement UNION ALL SELECT 'UNWIND [' || string_agg('{_node_id: ''r' || r_regionkey || ''', name: ''' || r_name || '''}', ', ' ORDER BY r_regionkey) || '] AS row MERGE (n:Region {_node_id: row._node_id}) SET n += row' FROM region")
def cypher_statements(spark, d):
    nodes = table(spark, d, "region").select(F.lit("d").alias("doc_id"), F.lit("Region").alias("type"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_regionkey").alias("line"), F.create_map(F.lit("name"), infer.cell("string", s=F.col("r_name"))).alias("cells"))
    return graph.constraints(nodes).union(graph.node_statements(nodes).select("statement"))


@query_of("SELECT role, median FROM (SELECT role, list_sort(list(length(text)))[count(*) // 2 + 1]::DOUBLE AS median FROM conversations GROUP BY 1)")
def upper_median(spark, d):
    rows = table(spark, d, "conversations").select("role", F.char_length("text").alias("n"))
    return stats.selected(rows, ["role"], "n", {"median": "n div 2"})


# Queries that parse documents register themselves here.
from . import documents as documents  # noqa: E402
