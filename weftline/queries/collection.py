"""Queries of the collection operators, the catalog's operators and key hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import LETTERS, SECOND, base64_text, letter_key, url_key
from weftline.operators.collection import PairSet, StringSet, to_cells, transpose
from weftline.queries.registry import Registry
from weftline.sources.catalog import key_range, page, upsert_cells, upsert_rows
from weftline.sources.tables import table

registry = Registry()
query = registry.query


def _strings(spark: SparkSession, sf: str, name: str, value: Column) -> StringSet:
    return StringSet.from_rows(table(spark, sf, name), value)


def _pairs(spark: SparkSession, sf: str, name: str, key: str | Column, value: str | Column) -> PairSet:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return PairSet(table(spark, sf, name).select(c(key).cast("string").alias("key"), c(value).cast("string").alias("value")))


@query("SELECT c_name || ',' || c_mktsegment AS value FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL")
def from_table(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "customer", F.concat("c_name", F.lit(","), "c_mktsegment")).df


@query("SELECT c_name || ',' || c_mktsegment AS value FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL")
def from_table_callable(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    join = lambda r: None if None in r.values() else f"{r['c_name']},{r['c_mktsegment']}"
    return StringSet.from_rows(rows, join).df


@query("SELECT * FROM (VALUES ('a'), ('b'), ('b'), ('c')) AS t(value)")
def parallelize(spark: SparkSession, sf: str) -> DataFrame:
    return StringSet.parallelize(spark, ["a", "b", "b", "c"]).df


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def key_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return key_range(table(spark, sf, "orders"), "o_orderkey", 1000, 5000).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_name FROM customer WHERE c_custkey = 42")
def cell_get(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_custkey") == 42).select("c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def visited_anti(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def _supplier_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of even nations under a new name, and one new supplier for each nation of region keys."""
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = supplier.where("s_nationkey % 2 = 0").withColumn("s_name", F.concat("s_name", F.lit("*")))
    added = table(spark, sf, "nation").select((F.col("n_nationkey") + 10_000_000).cast("bigint").alias("s_suppkey"), F.col("n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"))
    return changed.unionByName(added)


_UPDATES = """SELECT s_suppkey, s_name || '*' AS s_name, s_nationkey FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT CAST(n_nationkey + 10000000 AS BIGINT), n_name, n_nationkey FROM nation"""


@query(f"WITH u AS ({_UPDATES}) SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM u) UNION ALL SELECT * FROM u", name="upsert_rows")
def upsert_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return upsert_rows(supplier, _supplier_updates(spark, sf), "s_suppkey")


_CELLS = """SELECT CAST(s_suppkey AS VARCHAR) AS key, 's_name' AS col, s_name AS value FROM {t} WHERE s_name IS NOT NULL
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM {t} WHERE s_nationkey IS NOT NULL"""


@query(
    f"WITH u AS ({_UPDATES}), a AS ({_CELLS.format(t='supplier')}), b AS ({_CELLS.format(t='u')}) SELECT COALESCE(b.key, a.key) AS key, COALESCE(b.col, a.col) AS col, COALESCE(b.value, a.value) AS value FROM a FULL JOIN b ON a.key = b.key AND a.col = b.col",
    name="upsert_cells",
)
def upsert_cells_query(spark: SparkSession, sf: str) -> DataFrame:
    cells = to_cells(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    return upsert_cells(cells, to_cells(_supplier_updates(spark, sf), "s_suppkey"))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "lineitem", F.coalesce(F.col("l_orderkey").cast("string"), F.lit(""))).aggregate(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS keys, count(*) AS pairs FROM lineitem WHERE l_orderkey IS NOT NULL")
def count_keys(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, "lineitem", "l_orderkey", "l_partkey").filter(F.col("key").isNotNull())
    per_key = pairs.aggregate_by_key(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


@query(r"SELECT w AS value FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def flat_map_words(spark: SparkSession, sf: str) -> DataFrame:
    texts = _strings(spark, sf, "documents", F.col("text"))
    return texts.flat_map(F.filter(F.split("value", " "), lambda w: w != "")).df


@query(r"SELECT w AS value FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def flat_map_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "documents", F.col("text")).flat_map(lambda s: [w for w in s.split(" ") if w]).df


@query("SELECT p_brand AS key, p_name AS value FROM part UNION ALL SELECT p_type, p_name FROM part")
def flat_map_to_pair(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    both = F.array(F.struct(F.col("p_brand").alias("k"), F.col("p_name").alias("v")), F.struct(F.col("p_type").alias("k"), F.col("p_name").alias("v")))
    rows = part.select(F.explode(both).alias("x")).select("x.*")
    return PairSet(rows.toDF("key", "value")).df


@query("SELECT r_name AS key, r_name || r_name AS value FROM region UNION ALL SELECT r_name, r_name || r_name || r_name FROM region")
def flat_map_to_pair_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "region", F.col("r_name")).flat_map_to_pair(lambda s: [(s, s + s), (s, s + s + s)]).df


@query("SELECT substr(o_orderpriority, 1, 1) AS key, o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def map_to_pair(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "orders", F.col("o_orderpriority")).map_to_pair(F.struct(F.substring("value", 1, 1).alias("k"), F.col("value").alias("v"))).df


@query("SELECT substr(o_orderpriority, 1, 1) AS key, o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT LIKE '1%'")
def map_to_pair_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "orders", F.col("o_orderpriority")).map_to_pair(lambda s: None if s[0] == "1" else (s[0], s)).df


_LINE_PAIRS = "SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS value FROM lineitem"


@query(f"SELECT key || '-' || value AS value FROM ({_LINE_PAIRS}) UNION ALL SELECT value FROM ({_LINE_PAIRS})")
def pair_flat_map(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    return pairs.flat_map(F.array(F.concat("key", F.lit("-"), "value"), F.col("value"))).df


@query(f"SELECT value AS key, key AS value FROM ({_LINE_PAIRS}) UNION ALL SELECT key, key FROM ({_LINE_PAIRS})")
def pair_flat_map_to_pair(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    swap = F.struct(F.col("value").alias("k"), F.col("key").alias("v"))
    return pairs.flat_map_to_pair(F.array(swap, F.struct(F.col("key").alias("k"), F.col("key").alias("v")))).df


@query(f"SELECT value AS key, key AS value FROM ({_LINE_PAIRS})")
def pair_map_to_pair(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    return pairs.map_to_pair(F.struct(F.col("value").alias("k"), F.col("key").alias("v"))).df


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(lpad(CAST(event_id AS VARCHAR), 12, '0') || ':' || event_type) AS value FROM events GROUP BY user_id")
def map_to_pair_last_by_key(spark: SparkSession, sf: str) -> DataFrame:
    stamped = F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(":"), "event_type")
    return _pairs(spark, sf, "events", "user_id", stamped).last_by_key().df


@query("SELECT event_type AS value FROM events WHERE event_type LIKE '%i%'")
def filter_values(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "events", F.col("event_type")).filter(F.col("value").contains("i")).df


@query("SELECT event_type AS value FROM events WHERE event_type LIKE '%i%'")
def filter_values_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "events", F.col("event_type")).filter(lambda s: "i" in s).df


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value FROM events WHERE event_type = 'click'")
def pair_filter_values(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "events", "user_id", "event_type").filter(F.col("value") == "click").df


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value FROM events WHERE event_type = 'click'")
def pair_filter_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "events", "user_id", "event_type").filter(lambda v: v == "click").df


@query("SELECT upper(event_type) AS value FROM events WHERE event_type IS NOT NULL")
def map_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "events", F.col("event_type")).map_partitions(lambda xs: (x.upper() for x in xs)).df


@query()
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of lineitem; no SQL, as the rows are random."""
    return _strings(spark, sf, "lineitem", F.col("l_orderkey").cast("string")).sample(0.1, 7).df


@query(
    """SELECT 'n_name' AS key, CAST(n_nationkey AS VARCHAR) AS col, n_name AS value FROM nation WHERE n_name IS NOT NULL
    UNION ALL SELECT 'n_regionkey', CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey IS NOT NULL"""
)
def invert_table(spark: SparkSession, sf: str) -> DataFrame:
    return transpose(to_cells(table(spark, sf, "nation"), "n_nationkey"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ',' || o_orderpriority AS value FROM customer JOIN orders ON c_custkey = o_custkey")
def pair_join(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "customer", "c_custkey", "c_name").join(_pairs(spark, sf, "orders", "o_custkey", "o_orderpriority")).df


@query(
    """WITH a AS (SELECT c_nationkey AS k, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer GROUP BY 1),
    b AS (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_name) AS v FROM supplier GROUP BY 1)
    SELECT CAST(COALESCE(a.k, b.k) AS VARCHAR) AS key, '[' || COALESCE(a.v, '') || '],[' || COALESCE(b.v, '') || ']' AS value FROM a FULL JOIN b ON a.k = b.k"""
)
def cogroup(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "customer", "c_nationkey", "c_name").cogroup(_pairs(spark, sf, "supplier", "s_nationkey", "s_name")).df


@query("SELECT CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem")
def fold_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "lineitem", F.col("l_partkey").cast("string")).aggregate(F.sum(F.col("value").cast("bigint")).alias("total"))


@query("SELECT max(l_partkey) AS largest FROM lineitem")
def fold_max(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "lineitem", F.col("l_partkey").cast("string")).aggregate(F.max(F.col("value").cast("bigint")).alias("largest"))


@query("SELECT max(p_name) AS value FROM part")
def fold_callable(spark: SparkSession, sf: str) -> DataFrame:
    largest = _strings(spark, sf, "part", F.col("p_name")).fold("", max)
    return StringSet.parallelize(spark, [largest]).df


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def fold_by_key_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "lineitem", "l_orderkey", "l_partkey").aggregate_by_key(F.sum(F.col("value").cast("bigint")).alias("total"))


@query("SELECT p_brand AS key, 'Z' || string_agg(p_name, '' ORDER BY p_name) AS value FROM part GROUP BY 1")
def fold_by_key_concat(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "part", "p_brand", "p_name").fold_by_key("Z", lambda a, b: a + b).df


@query("SELECT substr(p_name, 1, 2) AS key, string_agg(p_name, ',' ORDER BY p_name) AS value FROM part GROUP BY 1")
def group_by_list(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "part", F.col("p_name")).group_by(F.substring("value", 1, 2)).df


@query("SELECT substr(p_name, 1, 2) AS key, string_agg(p_name, ',' ORDER BY p_name) AS value FROM part GROUP BY 1")
def group_by_callable(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "part", F.col("p_name")).group_by(lambda s: s[:2]).df


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "events", F.col("event_type")).distinct().df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def take_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(20)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100 ORDER BY c_custkey LIMIT 10")
def page_view(spark: SparkSession, sf: str) -> DataFrame:
    return page(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100)[0]


@query("SELECT c_custkey FROM customer WHERE c_custkey >= 100 ORDER BY c_custkey LIMIT 1 OFFSET 10")
def page_next(spark: SparkSession, sf: str) -> DataFrame:
    return page(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100)[1]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation ORDER BY 1, 2")
def ordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, "nation", "n_nationkey", "n_name").ordered()


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value FROM customer INTERSECT SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def intersection(spark: SparkSession, sf: str) -> DataFrame:
    return _strings(spark, sf, "customer", F.col("c_nationkey").cast("string")).intersection(_strings(spark, sf, "supplier", F.col("s_nationkey").cast("string"))).df


@query("SELECT fetch_id, sha1(url) AS url_key FROM crawl")
def sha1_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl").select("fetch_id", url_key("url").alias("url_key"))


@query(
    f"""WITH d AS (SELECT DISTINCT url, sha1(url) AS h FROM crawl WHERE url IS NOT NULL),
    b AS (SELECT url, i, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS b FROM d, range(20) AS r(i)),
    p AS (SELECT url, i, CASE WHEN b = 0 THEN 255 WHEN b > 127 THEN b - 1 ELSE b END AS p FROM b)
    SELECT url, string_agg(substr('{LETTERS}', p % 26 + 1, 1) || substr('{SECOND}', p // 26 + 1, 1), '' ORDER BY i) AS letters FROM p GROUP BY url""",
    name="letter_keys",
)
def letter_keys(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "crawl").where("url is not null").select("url").distinct()
    return urls.select("url", letter_key("url").alias("letters"))


@query("SELECT doc_id, base64(encode(text)) AS packed, CAST(octet_length(encode(text)) AS INTEGER) AS n FROM documents")
def base64_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", base64_text("text").alias("packed"), F.octet_length("text").alias("n"))
