"""Queries of web extraction, URLs, robots and crawl rounds, on the crawl's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import web
from weftline.functions.web import BLANKS, HIDDEN_ELEMENTS, HREF, LANG, NO_PAGES, ROBOTS_META, SPLIT_URL, TITLE
from weftline.plans import crawl as plans
from weftline.queries.registry import Registry, quoted
from weftline.sources.tables import table

registry = Registry()
query = registry.query


def _unescaped(x: str) -> str:
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quoted(name)}, {quoted(by)})"
    return x


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(BLANKS)}, ' ', 'g'))"


VISIBLE_SQL = _squeezed(_unescaped(f"regexp_replace(regexp_replace(page, {quoted(HIDDEN_ELEMENTS)}, ' ', 'g'), '<[^>]*>', ' ', 'g')"))
TITLE_SQL = _squeezed(_unescaped(f"regexp_extract(page, {quoted(TITLE)}, 1)"))


def _part(u: str, part: str) -> str:
    if part == "host":
        return f"lower(regexp_replace(regexp_replace({_part(u, 'authority')}, '^[^@]*@', ''), ':[0-9]*$', ''))"
    if part == "port":
        return f"regexp_extract({_part(u, 'authority')}, ':([0-9]+)$', 1)"
    out = f"regexp_extract({u}, {quoted(SPLIT_URL)}, {('scheme', 'authority', 'path', 'query').index(part) + 1})"
    return f"lower({out})" if part == "scheme" else out


def normal_sql(u: str) -> str:
    """Normal form of an absolute URL without dot segments."""
    scheme, host, port, path = (_part(u, p) for p in ("scheme", "host", "port", "path"))
    own = f"CASE {scheme} WHEN 'http' THEN '80' WHEN 'https' THEN '443' END"
    return (
        f"CASE WHEN {scheme} IN ('http', 'https') AND {host} <> '' THEN {scheme} || '://' || {host} || CASE WHEN {port} IN ('', {own}) THEN '' ELSE ':' || {port} END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {_part(u, 'query')} END"
    )


#: Latest row with a page of every url.
LATEST_SQL = "SELECT url, page, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, fetch_id DESC) AS r FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL) WHERE r = 1"


def latest_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(url, page, title) of the last fetch with a page of every url; the largest fetch wins before the shuffle."""
    rows = table(spark, sf, "crawl").where("page is not null and url is not null")
    when = F.struct(F.coalesce(F.col("fetched_at"), F.lit("0001-01-01").cast("timestamp_ntz")), "fetch_id")
    last = rows.groupBy("url").agg(F.max_by(F.struct("page", "title"), when).alias("x"))
    return last.select("url", "x.page", "x.title")


_HREFS_SQL = f"""CASE WHEN len(list_filter(regexp_extract_all(page, {quoted(ROBOTS_META)}), lambda m: contains(lower(m), 'nofollow'))) > 0 THEN []
ELSE list_transform(regexp_extract_all(page, {quoted(HREF)}, 1), lambda h: trim(translate(h, '"''', ''))) END"""


@query(f"SELECT fetch_id, unnest({_HREFS_SQL}) AS href FROM crawl WHERE page IS NOT NULL")
def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl").where("page is not null").select("fetch_id", F.explode(web.hrefs("page")).alias("href"))


@query(
    f"""WITH a AS (SELECT url AS base, unnest({_HREFS_SQL}) AS ref FROM ({LATEST_SQL})),
    r AS (SELECT base, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN ref WHEN ref LIKE '//%' THEN {_part('base', 'scheme')} || ':' || ref
    WHEN ref LIKE '/%' THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || ref END AS u FROM a)
    SELECT {normal_sql('base')} AS src, {normal_sql('u')} AS dst FROM r WHERE {normal_sql('u')} IS NOT NULL"""
)
def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    return plans.page_links(latest_pages(spark, sf))


@query(
    f"""SELECT fetch_id, {_part('url', 'scheme')} AS scheme, {_part('url', 'host')} AS host, {_part('url', 'port')} AS port,
    {_part('url', 'path')} AS path, {_part('url', 'query')} AS query, {normal_sql('url')} AS normal FROM crawl"""
)
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [web.url_part("url", p).alias(p) for p in ("scheme", "host", "port", "path", "query")]
    return table(spark, sf, "crawl").select("fetch_id", *parts, web.normal_url("url").alias("normal"))


@query(
    f"""SELECT fetch_id, COALESCE({_part('url', 'scheme')} IN ('http', 'https') AND {_part('url', 'host')} <> '' AND regexp_extract({_part('url', 'path')}, '\\.([A-Za-z]+)$', 1) NOT IN ({', '.join(map(quoted, NO_PAGES))}), false) AS page_url,
    regexp_full_match(url, '[\\x20-\\x7E]+') AND NOT contains(url, ',') AND trim(url) <> '' AS plain_url FROM crawl"""
)
def valid_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl").select("fetch_id", web.is_page_url("url").alias("page_url"), web.is_plain_url("url").alias("plain_url"))


@query(f"SELECT fetch_id, {TITLE_SQL} AS page_title FROM crawl WHERE page IS NOT NULL")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl").where("page is not null").select("fetch_id", web.page_title("page").alias("page_title"))


@query(f"SELECT fetch_id, COALESCE(nullif({TITLE_SQL}, ''), nullif({_squeezed(_unescaped(r'''regexp_replace(regexp_extract(page, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g')'''))}, ''), {_part('url', 'host')}) AS display_title FROM crawl WHERE page IS NOT NULL")
def display_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl").where("page is not null").select("fetch_id", web.display_title("page", "url").alias("display_title"))


@query(f"SELECT fetch_id, text, CAST(len(string_split_regex(text, {quoted(BLANKS)})) AS INTEGER) AS n_words FROM (SELECT fetch_id, {VISIBLE_SQL} AS text FROM crawl WHERE page IS NOT NULL)")
def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "crawl").where("page is not null").select("fetch_id", web.visible_text("page").alias("text"))
    return texts.select("fetch_id", "text", web.word_count("text").alias("n_words"))


@query(f"SELECT fetch_id, lower(regexp_extract(page, {quoted(LANG)}, 1)) AS lang FROM crawl WHERE page IS NOT NULL AND (lower(regexp_extract(page, {quoted(LANG)}, 1)) = '' OR lower(regexp_extract(page, {quoted(LANG)}, 1)) LIKE 'en%')")
def lang_gate(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "crawl").where("page is not null").where(web.passes_language("page"))
    return pages.select("fetch_id", web.html_lang("page").alias("lang"))


@query(
    f"""WITH h AS (SELECT fetch_id, url, sha1({VISIBLE_SQL}) AS content_hash FROM crawl WHERE page IS NOT NULL)
    SELECT fetch_id, url, content_hash, first_value(url) OVER (PARTITION BY content_hash ORDER BY fetch_id, url) AS canonical_url FROM h"""
)
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "crawl").where("page is not null").select("fetch_id", "url", web.visible_text("page").alias("text"))
    return plans.canonical_copies(pages, "text", "url", "fetch_id").select("fetch_id", "url", "content_hash", "canonical_url")


@query(f"SELECT {_part('url', 'host')} AS host, min(url) AS url FROM crawl WHERE url IS NOT NULL GROUP BY 1")
def host_politeness(spark: SparkSession, sf: str) -> DataFrame:
    return plans.one_per_host(table(spark, sf, "crawl").where("url is not null").select("url"))


@query(
    f"""WITH u AS (SELECT DISTINCT url, {_part('url', 'host')} AS h, {_part('url', 'path')} || {_part('url', 'query')} AS p FROM crawl WHERE url IS NOT NULL),
    j AS (SELECT url, p, COALESCE(rules, []) AS rules FROM u LEFT JOIN robots ON h = lower(host)),
    f AS (SELECT url, list_filter(rules, lambda r: r.kind IN ('allow', 'disallow') AND COALESCE(starts_with(p, r.prefix), false) AND NOT (r.kind = 'disallow' AND r.prefix = '')) AS fits,
    list_filter(rules, lambda r: r.kind = 'crawl-delay' AND r.delay IS NOT NULL) AS delays FROM j)
    SELECT url, CASE WHEN len(fits) = 0 THEN true ELSE fits[1].kind = 'allow' END AS allowed, COALESCE(delays[-1].delay, 1.0) AS delay FROM f"""
)
def robots_decisions(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "crawl").where("url is not null").select("url").distinct()
    return plans.robots_decisions(urls, table(spark, sf, "robots"))


@query()
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    """robots.txt texts, written out from the stored rules, parsed again; tested against literal files."""
    rules = table(spark, sf, "robots").where("host is not null")
    line = lambda r: F.concat(r["kind"], F.lit(": "), F.coalesce(r["prefix"], r["delay"].cast("string"), F.lit("")))
    text = F.concat(F.lit("User-agent: *\n"), F.array_join(F.transform(F.coalesce("rules", F.array().cast(plans.RULES)), line), "\n"))
    return plans.robots_rules(rules.select("host", text.alias("text")), "weftline")


@query(
    """WITH p AS (SELECT DISTINCT '(?s)' || replace(regexp_replace(pattern, '([^A-Za-z0-9/ _*-])', '\\\\\\1', 'g'), '*', '.*') AS re FROM blacklist WHERE pattern IS NOT NULL)
    SELECT DISTINCT url FROM crawl WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE regexp_full_match(url, re))"""
)
def blacklist_anti(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "crawl").where("url is not null").select("url").distinct()
    return urls.where(~plans.blacklisted(F.col("url"), plans.blacklist_patterns(table(spark, sf, "blacklist"))))


def _crawl(spark: SparkSession, sf: str, **options) -> DataFrame:
    pages = latest_pages(spark, sf).select(web.normal_url("url").alias("url"), "page").where("url is not null").dropDuplicates(["url"])
    hosts = table(spark, sf, "crawl").where("fetch_id is not null").agg(F.min_by(web.normal_url("url"), "fetch_id").alias("url"))
    links_ = plans.page_links(latest_pages(spark, sf))
    return plans.crawl(pages.select("url"), hosts, links_, **options)


@query(
    f"""WITH RECURSIVE latest AS ({LATEST_SQL}), a AS (SELECT url AS base, unnest({_HREFS_SQL}) AS ref FROM latest),
    r AS (SELECT base, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN ref WHEN ref LIKE '//%' THEN {_part('base', 'scheme')} || ':' || ref
    WHEN ref LIKE '/%' THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || ref END AS u FROM a),
    l AS MATERIALIZED (SELECT DISTINCT {normal_sql('base')} AS src, {normal_sql('u')} AS dst FROM r WHERE {normal_sql('u')} IS NOT NULL AND regexp_extract({_part('u', 'path')}, '\\.([A-Za-z]+)$', 1) NOT IN ({', '.join(map(quoted, NO_PAGES))})),
    known AS (SELECT DISTINCT {normal_sql('url')} AS url FROM latest), seed AS (SELECT {normal_sql('url')} AS url FROM crawl ORDER BY fetch_id LIMIT 1),
    reach(url, round) AS (SELECT url, 0 FROM seed UNION SELECT l.dst, reach.round + 1 FROM reach JOIN l ON l.src = reach.url WHERE reach.round < 4)
    SELECT reach.url, CAST(min(round) AS INTEGER) AS round, known.url IS NOT NULL AS found FROM reach LEFT JOIN known ON known.url = reach.url GROUP BY reach.url, known.url"""
)
def crawl_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds from the first fetched url."""
    return _crawl(spark, sf, max_rounds=5)


@query()
def crawl_polite(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds of one url per host, within robots and blacklist; the waiting frontier makes it no SQL query."""
    patterns = plans.blacklist_patterns(table(spark, sf, "blacklist"))
    return _crawl(spark, sf, robots=table(spark, sf, "robots"), patterns=patterns, polite=True, max_rounds=5)
