"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, distinctive, langid, packing, pages, quality
from weftline.llm.words import LANGS
from weftline.operators.postings import word_pages
from weftline.queries.data import postings_sql
from weftline.queries.registry import Registry
from weftline.sources.tables import cut, table

registry = Registry()
query = registry.query


def _part(seen: str, row: str, column: str) -> str:
    return f"CASE WHEN {seen} > 0 THEN {seen} * ln({seen} * n_all / ({row} * {column})) ELSE 0.0 END"


def _scores_sql(weights: str = "") -> str:
    """CTE s(word, url, n, df, score) of the log-likelihood ratios; ``weights``: expression of (word, weight)."""
    parts = " + ".join((_part("k", "n", "k_all"), _part("(n - k)", "n", "(n_all - k_all)"), _part("(k_all - k)", "(n_all - n)", "k_all"), _part("((n_all - n) - (k_all - k))", "(n_all - n)", "(n_all - k_all)")))
    joined = f"LEFT JOIN ({weights}) w USING (word)" if weights else ""
    weight = "COALESCE(weight, 1.0)" if weights else "1.0"
    return f"""{postings_sql()}, t AS (SELECT word, CAST(sum(n) AS BIGINT) AS k_all, count(*) AS df FROM pages WHERE n > 0 AND url IS NOT NULL GROUP BY word),
    x AS (SELECT word, url, CAST(n AS DOUBLE) AS k, CAST(k_all AS DOUBLE) AS k_all, df, CAST(sum(n) OVER (PARTITION BY url) AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS n_all, {weight} AS weight FROM pages JOIN t USING (word) {joined} WHERE pages.n > 0),
    s AS (SELECT word, url, CAST(k AS BIGINT) AS n, df, weight * CASE WHEN n <= 0 OR n_all - n <= 0 THEN 0.0 WHEN k * (n_all - n) >= (k_all - k) * n THEN 2 * ({parts}) ELSE -2 * ({parts}) END AS score FROM x)"""


_IDF_SQL = "SELECT word, arg_max(idf, (flushed_at, entry_id)) AS weight FROM pt_index WHERE word IS NOT NULL AND idf IS NOT NULL GROUP BY word"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.term_scores(word_pages(table(spark, sf_dir, "pt_index")))


@query(f"WITH {_scores_sql()} SELECT word, url, n, df, round(score, 6) + 0.0 AS score FROM s")
def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood ratio of every word of every indexed page."""
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(f"WITH {_scores_sql(_IDF_SQL)} SELECT word, url, n, df, round(score, 6) + 0.0 AS score FROM s")
def p1_scores_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, weighed with the last stored idf of the word."""
    index = table(spark, sf_dir, "pt_index")
    last = index.where("word is not null and idf is not null").groupBy("word").agg(F.max_by("idf", F.struct("flushed_at", "entry_id")).alias("idf"))
    return distinctive.term_scores(word_pages(index), last).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(f"WITH {_scores_sql()} SELECT word, url FROM (SELECT word, url, row_number() OVER (PARTITION BY url ORDER BY round(score, 9) DESC, df, word) AS r FROM s WHERE df >= 2 AND score > 0) WHERE r = 1")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic word of every page, of words that two pages have."""
    return distinctive.most_distinctive(_scores(spark, sf_dir))


#: Share of a body's words in keywords, links or tags from which a page is stuffed.
STUFFED = 0.5
#: Sentences that make a language one of a page.
LEAST_SENTENCES = 3


def _bodies(spark: SparkSession, sf_dir: str, languages: bool = False, stretches: bool = False) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents")) if languages else None
    n_out = F.regexp_count("outbound", F.lit("(?i)https?:")).alias("n_out")
    return pages.bodies(table(spark, sf_dir, "crawl").select("fetch_id", "host", "url", n_out, "page"), model, stretches)


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches whose own content is mostly keywords, links or tags."""
    return _bodies(spark, sf_dir).where(F.col("stuffed") > STUFFED).select("fetch_id")


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the text blocks of every page's main body."""
    kept = _bodies(spark, sf_dir).where(F.col("stuffed") <= STUFFED)
    return kept.select("fetch_id", F.explode(F.transform("own", lambda x: x["no"])).alias("block_no"))


def _languages(bodies: DataFrame) -> DataFrame:
    total = lambda i: F.aggregate("own", F.lit(0), lambda a, x: a + F.coalesce(F.get(x["s"], F.lit(i)), F.lit(0)))
    sums = [total(i) for i in range(len(LANGS))]
    named = F.array(*[F.struct(F.lit(name).alias("lang"), n.alias("n")) for name, n in zip(LANGS, sums)])
    return bodies.withColumn("langs", F.filter(named, lambda x: x["n"] >= LEAST_SENTENCES))


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages without a label, with a wrong one, or with two languages."""
    kept = _languages(_bodies(spark, sf_dir, True).where(F.col("stuffed") <= STUFFED))
    known = F.exists("langs", lambda x: x["lang"] == F.col("label"))
    return kept.where(~known | (F.size("langs") > 1)).select("fetch_id", F.explode("langs").alias("x")).select("fetch_id", "x.lang")


def _named(lang: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LANGS)), F.nullif(lang, F.lit(-1))), F.lit("und"))


@query()
def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every stretch of one language in every block of every main body.

    The confidence is the mean probability of the stretch's language; 'und',
    with that of the likeliest language, where no piece of it is sure.
    """
    blocks = _bodies(spark, sf_dir, True, True).select("fetch_id", F.explode("own").alias("x"))
    rows = blocks.select("fetch_id", F.col("x.no").alias("block_no"), F.posexplode("x.runs").alias("segment", "r"))
    sure = F.when(F.col("r.lang") >= 0, F.get("r.p", F.col("r.lang"))).otherwise(F.array_max("r.p"))
    return rows.select("fetch_id", "block_no", "segment", _named(F.col("r.lang")).alias("lang"), sure.cast("double").alias("confidence"))


@query()
def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every page: the likeliest of its main body, by mean probability over the words.

    'und' where no stretch is sure, with confidence 0 where the body has no words.
    """
    rows = _bodies(spark, sf_dir, True, True).select("fetch_id", F.flatten(F.transform("own", lambda x: x["runs"])).alias("r"))
    words = F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    mean = F.array(*[F.aggregate("r", F.lit(0.0), lambda a, x: a + x["n"] * F.get(x["p"], F.lit(i))) / F.greatest(words, F.lit(1)) for i in range(len(LANGS))])
    most = rows.withColumn("p", mean).withColumn("confidence", F.array_max("p"))
    sure = F.exists("r", lambda x: x["lang"] >= 0)
    lang = F.when(sure, F.array_position("p", F.col("confidence")).cast("int") - 1).otherwise(-1)
    return most.select("fetch_id", _named(lang).alias("lang"), "confidence")


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k; empty and null texts have the empty list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.Encoder(spark).encode(docs, "text").select("doc_id", "ids")


@query("SELECT doc_id, COALESCE(text, '') AS text FROM documents")
def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text decoded from its ids; null texts come out as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = bpe.Encoder(spark)
    return encoder.encode(docs, "text").select("doc_id", encoder.decode(F.col("ids")).alias("text"))


@query()
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in containers; tokens after the first line bear loss, all in one-line texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Prompt = first line (with its end of line), answer = the rest.
    prompt = F.regexp_extract("text", r"^[^\n]*\n", 0)
    encoder = bpe.Encoder(spark)
    ids = encoder.encode(docs, "text").select("doc_id", "ids", F.coalesce(F.octet_length(prompt), F.lit(0)).alias("head"))
    n_loss = F.size("ids") - encoder.tokens_within(F.col("ids"), F.col("head"))
    # Written, as a filter on the sizes would encode every text once more.
    return packing.fill_containers(cut(ids.select("doc_id", F.size("ids").alias("n_tokens"), n_loss.alias("n_loss"))))


@query()
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of every container."""
    return packing.container_report(p9_containers(spark, sf_dir))


@query("SELECT doc_id, count(*) AS texts FROM documents WHERE text <> '' GROUP BY doc_id")
def p9_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document that has tokens is placed: its first pieces are counted."""
    return p9_containers(spark, sf_dir).where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("texts"))


#: Share of characters outside prose from which a document is no prose.
JUNK = 0.5


@query()
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and outlier score of every document."""
    return quality.outlier_scores(quality.measure(table(spark, sf_dir, "documents")))


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with most characters outside prose, whatever their rank: where most of a language is junk, junk is no outlier."""
    return quality.measure(table(spark, sf_dir, "documents")).where(F.col("junk_share") > JUNK).select("doc_id")


def queries() -> dict:
    return dict(registry.queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.sql)
