"""Ranked keyword search over a collection of texts, with the figures behind each score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import ALNUM, is_valid, query_terms, tokens
from weftline.plans.index import BASE, DAMPING, DERANK, title_boost
from weftline.sources.tables import cut

#: Results of a search.
TOP = 10


def query_weights(docs: DataFrame, doc: str, terms: list[str], text: str = "text", title: str | None = None) -> DataFrame:
    """(doc, word, tf) of the query's terms only: each text is split once, no other word leaves its row."""
    named = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    split = docs.select(doc, named.alias("title"), tokens(text).alias("t")).withColumn("n", F.size("t")).where("n > 1")
    wanted = F.array(*map(F.lit, terms))
    placed = F.filter(F.transform("t", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(wanted, x["w"]))
    hits = split.select(doc, "n", title_boost("title").alias("boost"), placed.alias("hits")).where(F.size("hits") > 0)
    # One value per term, summed within the row: no shuffle.

    def occurrences(term: str) -> Column:
        placed_ = F.filter("hits", lambda x: x["w"] == term)
        return F.aggregate(placed_, F.lit(0.0), lambda a, x: a + BASE / (1 + DAMPING * x["i"] / F.col("n")))

    by_term = [F.struct(F.lit(t).alias("word"), occurrences(t).alias("w")) for t in terms]
    rows = hits.select(doc, "boost", F.explode(F.filter(F.array(*by_term), lambda x: x["w"] > 0)).alias("x"))
    kept = rows.where(is_valid("x.word"))
    weight = F.when(F.col("x.word").rlike(ALNUM), F.col("x.w")).otherwise(F.col("x.w") / DERANK)
    return kept.select(doc, F.col("x.word").alias("word"), (weight + F.col("boost")).alias("tf"))


def top_documents(weights: DataFrame, doc: str, n_docs: int, ranks: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """The ``top`` documents by sum of tf * idf over the terms, times rank if given (0 where there is none).

    ``weights``: (doc, word, tf) of the query's terms; ``ranks``: (doc, rank),
    unique.  Gives doc, score, rank and a map of term weights; ties go to the
    lower document.
    """
    weights = cut(weights)
    known = {r["word"]: r["df"] for r in weights.groupBy("word").agg(F.count("*").alias("df")).collect()}
    if not known:
        idf = F.lit(0.0)
    else:
        idf = F.coalesce(*[F.when(F.col("word") == w, F.log(F.lit(n_docs) / F.lit(df))) for w, df in known.items()])
    scored = weights.groupBy(doc).agg(F.sum(F.col("tf") * idf).alias("relevance"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "tf")))).alias("tfs"))
    if ranks is not None:
        scored = scored.join(ranks.select(doc, "rank"), doc, "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    else:
        scored = scored.withColumn("rank", F.lit(1.0))
    result = scored.select(doc, (F.col("relevance") * F.col("rank")).alias("score"), "rank", "tfs")
    return result.orderBy(F.desc("score"), doc).limit(top)


def search(docs: DataFrame, doc: str, query: str, text: str = "text", title: str | None = None, ranks: DataFrame | None = None, n_docs: int | None = None, top: int = TOP) -> DataFrame:
    """Ranked search of ``query`` over the texts of ``docs``; a query without terms finds nothing.

    ``n_docs``: documents of the collection, by default the rows of ``docs``.
    """
    terms = query_terms(query, stemmed=False)
    if not terms:
        return top_documents(docs.select(doc, F.lit("").alias("word"), F.lit(0.0).alias("tf")).limit(0), doc, 1, ranks, top)
    n = docs.count() if n_docs is None else n_docs
    return top_documents(query_weights(docs, doc, terms, text, title), doc, n, ranks, top)


def cosine(weights: DataFrame, doc: str, idfs: DataFrame) -> DataFrame:
    """(doc, similarity): the cosine of each document's term weights and the query's idf values."""
    joined = weights.join(idfs.select("word", "idf"), "word")
    return joined.groupBy(doc).agg((F.sum(F.col("tf") * F.col("idf")) / (F.sqrt(F.sum(F.col("tf") * F.col("tf"))) * F.sqrt(F.sum(F.col("idf") * F.col("idf"))))).alias("similarity"))
