"""Queries of the core's training-data operators: orphan links, packed fields, hot words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.web import canonical_url
from weftline.operators import hotkeys, orphans
from weftline.operators.packed import split_packed
from weftline.operators.postings import word_pages
from weftline.queries.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query

#: Share of all rows of the index from which a word counts as hot.
HOT_SHARE = 0.02
FRACTIONS = [0.5, 0.9, 0.99]


def items_sql(table_: str, row: str, field: str, extra: str = "") -> str:
    """Rows (row_id, pos, item) of a packed field of links, as SQL; quoted links have no delimiter before another link."""
    glue = """[;,|\\n\\r\\t"'' \\[\\]]"""
    bare = f"regexp_replace({field}, '\\\\(.)', '\\1', 'g')"
    marked = f"regexp_replace({bare}, '[\"'' \\[\\]]*[;,|\\n\\r\\t]{glue}*(https?://)', chr(1) || '\\1', 'gi')"
    items = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: regexp_replace(x, '^{glue}+|{glue}+$', '', 'g')), lambda x: x <> '')"
    return f"SELECT row_id{extra}, unnest(range(len(xs))) AS pos, unnest(xs) AS item FROM (SELECT {row} AS row_id{extra}, {items} AS xs FROM {table_} WHERE {field} <> '')"


def postings_sql() -> str:
    """CTEs post(word, url, positions) of distinct postings and pages(word, url, n), as SQL."""
    part = lambda i: f"regexp_extract(item, '^(.*):([^:]*):([^:]*):([^:]*)$', {i})"
    return f"""post AS (SELECT DISTINCT word, {part(1)} AS url, {part(3)} AS positions FROM ({items_sql('pt_index', 'entry_id', 'accumulated_value', ', word')}) WHERE word IS NOT NULL),
    pages AS (SELECT word, url, CAST(sum(len(list_filter(string_split(positions, ' '), lambda p: p <> ''))) AS BIGINT) AS n FROM post GROUP BY word, url)"""


def canonical_sql(url: str) -> str:
    """``canonical_url`` as SQL."""
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    head = f"lower(regexp_extract({bare}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?]*)', 1))"
    return f"regexp_replace(regexp_replace({head}, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') || substr({bare}, length({head}) + 1)"


def _ranks_sql(rows: str, value: str, name: str, total: str) -> str:
    """Count and quantiles of ``value`` per word, as SQL."""
    picked = ", ".join(f"max(CASE WHEN r = greatest(1, CAST(ceil(CAST({f} AS DOUBLE) * n) AS BIGINT)) THEN v END) AS {name}_q{f * 100:g}" for f in FRACTIONS)
    return f"SELECT word, max(n) AS {total}, {picked} FROM (SELECT word, CAST({value} AS BIGINT) AS v, row_number() OVER (PARTITION BY word ORDER BY {value}) AS r, count(*) OVER (PARTITION BY word) AS n FROM {rows}) GROUP BY word"




def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    crawl = table(spark, sf_dir, "crawl").withColumn("month", F.trunc("fetched_at", "month"))
    into = F.lit("crawl").alias("parent_table")
    parents = crawl.where("url is not null and month is not null").select(
        into, canonical_url("url").alias("key"), F.col("month").alias("period"), F.struct("fetched_at", "fetch_id").alias("at"), F.col("response_code").alias("state")
    )
    links = split_packed(crawl.where("month is not null"), {"row_id": "fetch_id", "period": "month"}, "outbound")
    return parents, links.select(into, "row_id", canonical_url("item").alias("key"), "period").distinct()


_STATES_SQL = f"""c AS (SELECT DISTINCT row_id, {canonical_sql('item')} AS key, period FROM ({items_sql("(SELECT *, date_trunc('month', fetched_at) AS period FROM crawl WHERE fetched_at IS NOT NULL)", 'fetch_id', 'outbound', ', period')})),
k AS (SELECT key, period, count(*) AS n FROM c GROUP BY key, period),
p AS (SELECT {canonical_sql('url')} AS key, date_trunc('month', fetched_at) AS month, fetched_at, fetch_id, response_code FROM crawl WHERE url IS NOT NULL AND fetched_at IS NOT NULL),
s AS (SELECT k.key, k.period, k.n, response_code, fetch_id, row_number() OVER (PARTITION BY k.key, k.period ORDER BY fetched_at DESC NULLS LAST, fetch_id DESC) AS r FROM k LEFT JOIN p ON p.key = k.key AND p.month <= k.period),
st AS (SELECT key, period, n, fetch_id IS NULL OR COALESCE(response_code IN (404, 410), false) AS orphan FROM s WHERE r = 1)"""


@query(f"WITH {_STATES_SQL} SELECT row_id AS fetch_id, c.key AS target_url FROM c JOIN st ON st.key = c.key AND st.period = c.period WHERE orphan")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a fetch to a URL that is missing or gone at the end of the fetch's month."""
    parents, children = _links(spark, sf_dir)
    return orphans.orphan_references(parents, children).select(F.col("row_id").alias("fetch_id"), F.col("key").alias("target_url"))


@query(
    f"""WITH {_STATES_SQL} SELECT 'crawl' AS parent_table, strftime(period, '%Y-%m') AS period, CAST(sum(n) AS BIGINT) AS refs,
    CAST(sum(CASE WHEN orphan THEN n ELSE 0 END) AS BIGINT) AS orphan_refs, CAST(count_if(orphan) AS BIGINT) AS orphan_targets FROM st GROUP BY 2"""
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and orphan links per table and month of the fetch."""
    return orphans.orphan_report(*_links(spark, sf_dir)).withColumn("period", F.date_format("period", "yyyy-MM"))


@query(
    f"""SELECT 'outbound' AS src_field, row_id, CAST(pos AS INTEGER) AS pos, item FROM ({items_sql('crawl', 'fetch_id', 'outbound')})
    UNION ALL SELECT 'accumulated_value', row_id, CAST(pos AS INTEGER), regexp_extract(item, '^(.*):([^:]*):([^:]*):([^:]*)$', 1) FROM ({items_sql('pt_index', 'entry_id', 'accumulated_value')})"""
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link of crawl.outbound and per posting of pt_index.accumulated_value."""
    out = split_packed(table(spark, sf_dir, "crawl"), {"row_id": "fetch_id"}, "outbound")
    acc = split_packed(table(spark, sf_dir, "pt_index"), {"row_id": "entry_id"}, "accumulated_value", postings=True)
    tagged = lambda df, name: df.select(F.lit(name).alias("src_field"), "row_id", "pos", "item")
    return tagged(out, "outbound").unionByName(tagged(acc, "accumulated_value"))


_SIZES = _ranks_sql("(SELECT word, COALESCE(octet_length(encode(accumulated_value)), 0) AS z FROM pt_index WHERE word IS NOT NULL)", "z", "size", "n_rows")
_PAGES = _ranks_sql("pages", "n", "occurrences", "n_pages")


@query(
    f"""WITH {postings_sql()}, a AS ({_SIZES}), b AS ({_PAGES}), o AS (SELECT word, CAST(sum(n) AS BIGINT) AS n_occurrences FROM pages GROUP BY word)
    SELECT a.*, COALESCE(n_occurrences, 0) AS n_occurrences, COALESCE(n_pages, 0) AS n_pages, b.* EXCLUDE (word, n_pages) FROM a LEFT JOIN b USING (word) LEFT JOIN o USING (word)"""
)
def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct pages and occurrences of every word, quantiles of a row's bytes and of occurrences per page."""
    index = table(spark, sf_dir, "pt_index").where("word is not null")
    return hotkeys.key_results(index, word_pages(index), "word", F.octet_length("accumulated_value"), "n", FRACTIONS)


@query(f"SELECT word FROM pt_index WHERE word IS NOT NULL GROUP BY word HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM pt_index)")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with at least HOT_SHARE of the rows of pt_index, counted by the histograms of the selection."""
    results = p7_words(spark, sf_dir)
    total = table(spark, sf_dir, "pt_index").count()
    return results.where(F.col("n_rows") >= F.lit(HOT_SHARE) * F.lit(total)).select("word")
