"""Positional inverted index: postings, document frequencies, term weights, transpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import base64_text
from weftline.functions.text import ALNUM, is_valid, stems, title_words, tokens
from weftline.operators.skew import salted_join
from weftline.sources.tables import cut

#: Fixed values of the weighting: base, damping by position, scale of one-word titles, divisor of words with other characters.
BASE, DAMPING, TITLE_SCALE, DERANK = 0.4, 20, 12, 10
#: Postings of a packed row, about.
PER_ROW = 256


def word_positions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row per indexed token: word, pos (from 0) and n_words (tokens of the text).

    Texts of one token or none, and null texts, have no rows.  Tokens that are
    not valid are left out but count as positions.
    """
    split = docs.withColumn("__t", tokens(text)).withColumn("n_words", F.size("__t")).where("n_words > 1")
    rows = split.select(*docs.columns, "n_words", F.posexplode("__t").alias("pos", "word"))
    return rows.where(is_valid("word"))


def postings(docs: DataFrame, doc: str, text: str = "text", title: str | None = None, stemmed: bool = False) -> DataFrame:
    """(word, doc, n_words, positions, title): one row per word and document, positions in order.

    ``doc`` is unique per row of ``docs``.  ``stemmed`` also indexes each word's
    stem, at the same positions; words are stemmed once per vocabulary.  Null
    titles count as empty.
    """
    named = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    rows = word_positions(docs.select(doc, F.col(text).alias("text"), named.alias("title")))
    one = rows.groupBy("word", doc).agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("title").alias("title"))
    if not stemmed:
        return one
    one = cut(one)
    known = stems(one, "word").where("stem <> word")
    also = one.join(known, "word").select(F.col("stem").alias("word"), doc, "n_words", "positions", "title")
    both = one.unionByName(also).groupBy("word", doc)
    merged = F.array_sort(F.flatten(F.collect_list("positions")))
    return both.agg(F.first("n_words").alias("n_words"), merged.alias("positions"), F.first("title").alias("title"))


def idf(posted: DataFrame, n_docs: Column | int) -> DataFrame:
    """(word, df, idf): documents of each word and ln(n_docs / df)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return posted.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", F.log(n / F.col("df")))


def title_boost(title: str | Column) -> Column:
    """What a title adds to every word of its document: the sum over its parts, 12-fold if the title is one word."""
    t = F.col(title) if isinstance(title, str) else title
    scale = F.when(t.rlike(ALNUM), float(TITLE_SCALE)).otherwise(BASE)
    n = title_words(t)
    parts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(parts, F.lit(0.0), lambda a, i: a + scale / (1 + DAMPING * i / n))


def positional(pos: Column, n_words: Column) -> Column:
    """Weight of one occurrence."""
    return F.lit(BASE) / (1 + DAMPING * pos / n_words)


def tf(posted: DataFrame, doc: str) -> DataFrame:
    """(word, doc, tf): positional weight, a tenth of it for words with other characters than ASCII letters and digits, plus the title's boost."""
    by_place = F.aggregate("positions", F.lit(0.0), lambda a, p: a + positional(p, F.col("n_words")))
    ranked = F.when(F.col("word").rlike(ALNUM), by_place).otherwise(by_place / DERANK)
    return posted.select("word", doc, (ranked + title_boost("title")).alias("tf"))


def term_weights(docs: DataFrame, doc: str, text: str = "text", title: str | None = None) -> DataFrame:
    """(word, doc, tf), as ``tf`` of ``postings`` but without gathering positions: sums are combined before the shuffle."""
    named = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    rows = word_positions(docs.select(doc, F.col(text).alias("text"), title_boost(named).alias("boost")))
    summed = rows.groupBy("word", doc, "boost").agg(F.sum(positional(F.col("pos"), F.col("n_words"))).alias("w"))
    return summed.select("word", doc, (F.when(F.col("word").rlike(ALNUM), F.col("w")).otherwise(F.col("w") / DERANK) + F.col("boost")).alias("tf"))


def transposed(weights: DataFrame, doc: str) -> DataFrame:
    """Weights by document: cells (key = document, col = word, value = tf)."""
    return weights.select(F.col(doc).alias("key"), F.col("word").alias("col"), F.col("tf").alias("value"))


def pack(posted: DataFrame, url: str) -> DataFrame:
    """(word, accumulated_value): postings packed as url:n_words:positions:base64(title), joined by commas in order.

    A word has one row, or, with more than PER_ROW documents, one for each
    prefix of the documents' SHA-1 of as many hex digits as keep rows near
    PER_ROW: no row and no task gets all postings of a frequent word.
    """
    one = F.concat_ws(":", F.col(url), F.col("n_words").cast("string"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " "), base64_text("title"))
    rows = cut(posted.select("word", F.col(url).cast("string").alias("__url"), one.alias("p")))
    counts = cut(rows.groupBy("word").agg(F.count("*").alias("df")))
    total = counts.agg(F.sum("df")).first()[0] or 0
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("df") / PER_ROW) / F.log(F.lit(16.0)))).cast("int")
    spread = salted_join(rows, counts, ["word"], "df", int(total), F.col("__url"))
    part = F.substring(F.sha1(F.col("__url").cast("binary")), F.lit(1), digits)
    return spread.select("word", part.alias("part"), "p").groupBy("word", "part").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("accumulated_value")).drop("part")
