"""Queries of the index, the ranks and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.hashing import url_key
from weftline.plans import index, rank, search
from weftline.queries.registry import Registry, quoted
from weftline.queries.web import LATEST_SQL, latest_pages
from weftline.sources.tables import cut, table

registry = Registry()
query = registry.query

#: Words of the search queries.
WORDS = ("garden", "river", "market", "the")


def _tokens_sql(docs: str, doc: str, extra: str = "") -> str:
    """CTEs tok(doc, t, n) and occ(doc, n, pos, word) of indexed tokens."""
    clean = f"lower(regexp_replace(regexp_replace(text, {quoted(text.TAG)}, ' ', 'g'), {quoted(text.PUNCTUATION)}, ' ', 'g'))"
    split = f"string_split_regex(regexp_replace({clean}, {quoted(text.SPACE + '$')}, ''), {quoted(text.SPACE)})"
    return f"""tok AS (SELECT {doc}, {split} AS t{extra} FROM {docs} WHERE text IS NOT NULL),
    occ AS (SELECT * FROM (SELECT {doc}, len(t) AS n, unnest(range(len(t))) AS pos, unnest(t) AS word{extra} FROM tok WHERE len(t) > 1) WHERE regexp_full_match(word, '[A-Za-z0-9]{{1,50}}|[\\x21-\\x7F]'))"""


_DOCS = _tokens_sql("documents", "doc_id")
_TF = "CASE WHEN regexp_full_match(word, '[A-Za-z0-9]+') THEN 1.0 ELSE 0.1 END * sum(0.4 / (1 + 20.0 * pos / n))"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query(f"WITH {_DOCS} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens FROM tok")
def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null").select("doc_id", F.size(text.tokens("text")).alias("n_tokens"))


@query(f"WITH {_DOCS} SELECT word, count(*) AS n FROM occ GROUP BY word")
def valid_words(spark: SparkSession, sf: str) -> DataFrame:
    return index.word_positions(_docs(spark, sf)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT doc_id, word, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n_words FROM occ")
def word_positions(spark: SparkSession, sf: str) -> DataFrame:
    return index.word_positions(_docs(spark, sf)).select("doc_id", "word", "pos", "n_words")


@query(f"WITH {_DOCS} SELECT word, doc_id, CAST(n AS INTEGER) AS n_words, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM occ GROUP BY word, doc_id, n")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    packed = F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")
    return index.postings(_docs(spark, sf), "doc_id").select("word", "doc_id", "n_words", packed.alias("positions"))


@query(f"WITH {_DOCS} SELECT word, df, round(ln((SELECT count(*) FROM documents) / df), 6) AS idf FROM (SELECT word, count(DISTINCT doc_id) AS df FROM occ GROUP BY word)")
def doc_freq_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    weights = index.term_weights(docs, "doc_id")
    return index.idf(weights, docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_DOCS} SELECT word, doc_id, round({_TF} + 0.4, 6) AS tf FROM occ GROUP BY word, doc_id")
def tf(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_weights(_docs(spark, sf), "doc_id").withColumn("tf", F.round("tf", 6))


@query(f"WITH {_DOCS} SELECT doc_id AS key, word AS col, round({_TF} + 0.4, 6) AS value FROM occ GROUP BY word, doc_id")
def tf_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return index.transposed(tf(spark, sf), "doc_id")


_PAGES = _tokens_sql("p", "url", ", title")
_BOOST = """(SELECT COALESCE(sum(CASE WHEN regexp_full_match(title, '[A-Za-z0-9]+') THEN 12.0 ELSE 0.4 END / (1 + 20.0 * i / k)), 0.0)
FROM (SELECT CASE WHEN title = '' THEN 1 WHEN trim(title) = '' THEN 0 ELSE len(string_split(rtrim(title), ' ')) END AS k), range(200) AS r(i) WHERE i < k)"""
_PAGE_TEXTS = f"p AS (SELECT url, page AS text, COALESCE(title, '') AS title FROM ({LATEST_SQL}) WHERE NOT contains(url, ','))"


def _page_docs(spark: SparkSession, sf: str) -> DataFrame:
    pages = latest_pages(spark, sf).where(~F.col("url").contains(","))
    return pages.select("url", F.col("page").alias("text"), "title")


@query(f"WITH {_PAGE_TEXTS}, {_PAGES}, b AS (SELECT url, {_BOOST} AS boost FROM p), w AS (SELECT word, url, {_TF} AS w FROM occ GROUP BY word, url) SELECT word, url, round(w + boost, 6) AS tf FROM w JOIN b USING (url)")
def tf_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Term weights of the crawl's pages with their titles."""
    return index.term_weights(_page_docs(spark, sf), "url", title="title").withColumn("tf", F.round("tf", 6))


@query(
    f"""WITH {_DOCS}, o AS (SELECT word, CAST(doc_id AS VARCHAR) AS d, CAST(doc_id AS VARCHAR) || ':' || CAST(n AS VARCHAR) || ':' || string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) || ':' AS p FROM occ GROUP BY word, doc_id, n),
    c AS (SELECT word, CAST(greatest(0, ceil(ln(count(*) / {float(index.PER_ROW)}) / ln(16.0))) AS INTEGER) AS digits FROM o GROUP BY word)
    SELECT word, accumulated_value FROM (SELECT word, substr(sha1(d), 1, digits) AS part, string_agg(p, ',' ORDER BY p) AS accumulated_value FROM o JOIN c USING (word) GROUP BY 1, 2)"""
)
def packed_postings(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    return index.pack(index.postings(docs, "doc_id"), "doc_id")


@query()
def stemmed_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each word and stem; the stemmer is no SQL function and is tested on published pairs."""
    return index.postings(_docs(spark, sf), "doc_id", stemmed=True).groupBy("word").agg(F.count("*").alias("df"))


@query()
def stemmed_terms(spark: SparkSession, sf: str) -> DataFrame:
    return text.stems(index.word_positions(_docs(spark, sf)), "word")


def _ranked_sql(nodes: str, links: str, steps: int) -> str:
    """Unrolled steps of the ranks, as CTEs e, s0 .. s<steps>."""
    out = [
        f"l AS MATERIALIZED ({links}), n AS ({nodes}), d AS (SELECT src, count(*) AS degree FROM l GROUP BY src)",
        "e AS MATERIALIZED (SELECT l.src, l.dst, 1.0 / d.degree AS share FROM l JOIN d ON l.src = d.src)",
        "s0 AS (SELECT DISTINCT id, CAST(1.0 AS DOUBLE) AS rank, CAST(1.0 AS DOUBLE) AS prev FROM n)",
    ]
    for k in range(1, steps + 1):
        v = f"SELECT e.dst AS id, 0.85 * s.rank * e.share AS v FROM e JOIN s{k - 1} s ON s.id = e.src UNION ALL SELECT id, 0.0 FROM s{k - 1} WHERE id IN (SELECT src FROM d)"
        out.append(f"s{k} AS MATERIALIZED (SELECT s.id, 0.15 + sum(t.v) AS rank, any_value(s.rank) AS prev FROM ({v}) t JOIN s{k - 1} s ON s.id = t.id GROUP BY s.id)")
    return ", ".join(out)


_EVENT_NODES = "SELECT DISTINCT 'U' || user_id AS id FROM events UNION SELECT DISTINCT 'T' || event_type FROM events"
_EVENT_LINKS = "SELECT 'U' || user_id AS src, 'T' || event_type AS dst FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL"
_PART_NODES = "SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem UNION SELECT DISTINCT 'S' || l_suppkey FROM lineitem"
_PART_LINKS = "SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem"
STEPS = 3


def _event_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    links = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("src"), F.concat(F.lit("T"), F.col("event_type")).alias("dst"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return ends, links


def _part_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pairs = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst"))
    links = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.select(F.col("src").alias("id")).where("id is not null").distinct(), links


@query(f"WITH {_ranked_sql(_EVENT_NODES, _EVENT_LINKS, STEPS)} SELECT id, round(rank, 6) AS rank, round(prev, 6) AS prev FROM s{STEPS}")
def pagerank_events(spark: SparkSession, sf: str) -> DataFrame:
    return rank.fixed_steps(*_event_graph(spark, sf), STEPS).select("id", F.round("rank", 6).alias("rank"), F.round("prev", 6).alias("prev"))


@query(f"WITH {_ranked_sql(_PART_NODES, _PART_LINKS, STEPS)} SELECT id, round(rank, 6) AS rank, round(prev, 6) AS prev FROM s{STEPS}")
def pagerank_k3(spark: SparkSession, sf: str) -> DataFrame:
    return rank.fixed_steps(*_part_graph(spark, sf), STEPS).select("id", F.round("rank", 6).alias("rank"), F.round("prev", 6).alias("prev"))


@query(f"WITH {_ranked_sql(_PART_NODES, _PART_LINKS, STEPS)} SELECT count(*) AS pages, CAST(count_if(abs(rank - prev) < 0.0001) AS BIGINT) AS settled, round(max(abs(rank - prev)), 6) AS largest FROM s{STEPS}")
def pagerank_residual(spark: SparkSession, sf: str) -> DataFrame:
    return rank.residual(rank.fixed_steps(*_part_graph(spark, sf), STEPS)).withColumn("largest", F.round("largest", 6))


@query("SELECT count(*) AS pages, CAST(count_if(abs(rank_now - rank_prev) < 0.0001) AS BIGINT) AS settled, round(max(abs(rank_now - rank_prev)), 6) AS largest FROM page_rank")
def rank_settled(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "page_rank").select(F.col("rank_now").alias("rank"), F.col("rank_prev").alias("prev"))
    return rank.residual(stored).withColumn("largest", F.round("largest", 6))


@query()
def pagerank_converged(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the events graph when all pages changed by less than 0.0001; the number of steps is not known to SQL."""
    return rank.page_rank(*_event_graph(spark, sf)).ranks


def _terms_sql() -> str:
    return "(" + ", ".join(map(quoted, WORDS)) + ")"


_HITS = f"tf AS (SELECT doc_id, word, {_TF} + 0.4 AS tf FROM occ WHERE word IN {_terms_sql()} GROUP BY word, doc_id), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)"


@query(f"WITH {_DOCS}, {_HITS} SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM tf JOIN df USING (word) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def search_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the words of WORDS, without ranks."""
    found = search.search(_docs(spark, sf), "doc_id", " ".join(WORDS))
    return found.select("doc_id", F.round("score", 6).alias("score"))


_PAGE_HITS = f"""tf AS (SELECT url, word, {_TF} AS w FROM occ WHERE word IN {_terms_sql()} GROUP BY word, url), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
b AS (SELECT url, {_BOOST} AS boost FROM p), k AS (SELECT url_id, max(rank_now) AS rank FROM page_rank GROUP BY url_id)"""


@query(
    f"""WITH {_PAGE_TEXTS}, {_PAGES}, {_PAGE_HITS}, s AS (SELECT url, sum((w + boost) * ln((SELECT count(DISTINCT url) FROM crawl WHERE NOT contains(url, ',')) / df)) AS s FROM tf JOIN df USING (word) JOIN b USING (url) GROUP BY url)
    SELECT url, round(s * COALESCE(rank, 0.0), 6) AS score, COALESCE(rank, 0.0) AS rank FROM s LEFT JOIN k ON k.url_id = sha1(url) ORDER BY s * COALESCE(rank, 0.0) DESC, url LIMIT 10"""
)
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best pages of the crawl by relevance times stored rank; N counts every url, also those without a page."""
    ranks = table(spark, sf, "page_rank").groupBy("url_id").agg(F.max("rank_now").alias("rank"))
    n = table(spark, sf, "crawl").where(~F.col("url").contains(",")).select("url").distinct().count()
    docs = _page_docs(spark, sf)
    # Ranks are keyed by the url's hash: carried beside the url through the scores.
    hits = search.query_weights(docs, "url", text.query_terms(" ".join(WORDS), stemmed=False), title="title")
    hits = cut(hits)
    wanted = hits.select("url").distinct().withColumn("url_id", url_key("url")).join(ranks, "url_id").select("url", "rank")
    return search.top_documents(hits, "url", n, wanted).select("url", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DOCS}, {_HITS} SELECT DISTINCT doc_id FROM tf")
def search_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have any of the words."""
    return search.query_weights(_docs(spark, sf), "doc_id", list(WORDS)).select("doc_id").distinct()


@query(
    f"""WITH {_DOCS}, {_HITS}, i AS (SELECT word, ln((SELECT count(*) FROM documents) / df) AS idf FROM df)
    SELECT doc_id, round(sum(tf * idf) / (sqrt(sum(tf * tf)) * sqrt(sum(idf * idf))), 6) AS similarity FROM tf JOIN i USING (word) GROUP BY doc_id"""
)
def search_cosine(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    hits = cut(search.query_weights(docs, "doc_id", list(WORDS)))
    return search.cosine(hits, "doc_id", index.idf(hits, docs.count())).withColumn("similarity", F.round("similarity", 6))
