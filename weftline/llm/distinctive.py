"""How characteristic a term is of a record, by a log-likelihood ratio test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.skew import salted_join
from weftline.sources.tables import cut


def llr(k: Column, n: Column, k_all: Column, n_all: Column) -> Column:
    """Signed log-likelihood ratio of the table [k, n-k; K-k, (N-n)-(K-k)].

    k of the record's n terms are the term, K of the collection's N.  Positive
    where the record has more of it than the rest, negative where less; 0 if
    record or rest is empty.
    """
    d = lambda c: c.cast("double")
    k, n, k_all, n_all = d(k), d(n), d(k_all), d(n_all)
    rest_k, rest_n = k_all - k, n_all - n

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n_all / (row * column))).otherwise(F.lit(0.0))

    total = part(k, n, k_all) + part(n - k, n, n_all - k_all) + part(rest_k, rest_n, k_all) + part(rest_n - rest_k, rest_n, n_all - k_all)
    more = k * rest_n >= rest_k * n
    return F.when((n <= 0) | (rest_n <= 0), 0.0).otherwise(F.when(more, 2 * total).otherwise(-2 * total))


def term_scores(counts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(word, url, n, df, score) for every term of every record.

    ``counts``: (word, url, n), one row per term and record.  A term's totals
    are summed before the shuffle and joined back with salts on hot terms, a
    record's total is a window over its own terms.  ``weights`` (word, idf):
    the score is multiplied by the stored weight, 1.0 where there is none.
    Null words, urls or counts are left out; an empty table gives no rows.
    """
    counts = cut(counts.where("word is not null and url is not null and n > 0").select("word", "url", F.col("n").cast("bigint").alias("n")))
    terms = counts.groupBy("word").agg(F.sum("n").alias("k_all"), F.count("*").alias("df"))
    if weights is not None:
        terms = terms.join(weights.select("word", F.col("idf").alias("weight")), "word", "left")
    terms = cut(terms)
    total, rows = terms.agg(F.coalesce(F.sum("k_all"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    joined = salted_join(counts, terms, ["word"], "df", int(rows), F.col("url"))
    in_record = F.sum("n").over(Window.partitionBy("url"))
    score = llr(F.col("n"), F.col("n_url"), F.col("k_all"), F.lit(int(total)))
    if weights is not None:
        score = score * F.coalesce("weight", F.lit(1.0))
    return joined.withColumn("n_url", in_record).select("word", "url", "n", "df", score.alias("score"))


def most_distinctive(scores: DataFrame, least_df: int = 2) -> DataFrame:
    """The term with the highest positive score of each record, of terms that ``least_df`` records have.

    Ties go to the term in fewer records, then to the first in binary order.
    """
    # A longer word sorts after its prefixes: the mark "G" closes the inverted digits.
    late = F.concat(F.translate(F.hex("word"), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    kept = scores.where((F.col("df") >= least_df) & (F.col("score") > 0))
    return kept.groupBy("url").agg(F.max_by("word", F.struct("score", -F.col("df"), late)).alias("word")).select("word", "url")
