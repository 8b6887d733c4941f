"""Per-document text statistics and outlier scores from exact per-language ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.prose import STATISTICS, statistics
from weftline.llm.words import LANGS
from weftline.operators.skew import salted_join
from weftline.sources.tables import cut

#: Statistics that are ranked, with the tail that is unlike prose: 1 upper, -1 lower, 0 both.
TAILS = {"junk_share": 1, "n_words": -1, "mean_word_length": 0, "symbol_ratio": 1, "punct_line_share": -1, "common_word_share": -1}
#: Group of texts without a language: ranked against all documents.
ALL = "*"
_FIELDS = ["junk_share", *STATISTICS]
_SCHEMA = "doc_id bigint, lang string, junk_share double, n_words double, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x) for x in batch.column(1).to_pylist()]
        langs = [None if r is None or r[0] < 0 else LANGS[r[0]] for r in rows]
        columns = [pa.array([None if r is None else r[k] for r in rows], pa.float64()) for k in range(1, 7)]
        yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), *columns], names=["doc_id", "lang", *_FIELDS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang (by function words), junk_share and the statistics of every document.

    One row per row of ``docs``; null, empty and blank texts have null
    statistics.  Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _SCHEMA)


def exact_ecdf(values: DataFrame) -> DataFrame:
    """(stat, grp, value, n, upto, total) from (stat, grp, value): for each distinct value how many are <= it.

    Equal values are counted before the shuffle, so a value that most rows have
    is one row.  The distinct values are range-partitioned and sorted; each
    partition sums its own counts and an offset per partition (the counts of
    the partitions before it) makes the sums ranks of the whole.  No group is
    gathered in one task.
    """
    counts = values.groupBy("stat", "grp", "value").agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("stat", "grp", "value").sortWithinPartitions("stat", "grp", "value").withColumn("part", F.spark_partition_id()))
    group = ["stat", "grp"]
    inside = ranged.withColumn("here", F.sum("n").over(Window.partitionBy("part", *group).orderBy("value")))
    # One row per partition and group: as many as partitions plus groups.
    sums = ranged.groupBy("part", *group).agg(F.sum("n").alias("s"))
    before = F.sum("s").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", *group, F.coalesce(before, F.lit(0)).alias("offset"), F.sum("s").over(Window.partitionBy(*group)).alias("total"))
    return inside.join(offsets, ["part", *group]).select(*group, "value", "n", (F.col("here") + F.col("offset")).alias("upto"), "total")


def outlier_scores(measured: DataFrame) -> DataFrame:
    """``measured`` with ``score``: the sum over TAILS of -ln of the tail probability within the document's language.

    The upper tail is the share of values >= the document's, the lower that of
    values <= it, for both twice the smaller one, 1 at most.  Documents without
    a language are ranked against all; documents without statistics have score
    null.  Repeated rows and ids are separate documents.
    """
    rows = cut(measured.withColumn("__row", F.monotonically_increasing_id()))
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in TAILS])
    long = rows.where("junk_share is not null").select("__row", F.coalesce("lang", F.lit(ALL)).alias("grp"), F.explode(stats).alias("x")).select("__row", "grp", "x.*")
    ranked = long.select("stat", "grp", "value").where(F.col("grp") != ALL).unionByName(long.select("stat", F.lit(ALL).alias("grp"), "value"))
    ecdf = cut(exact_ecdf(ranked))
    total = rows.count() * len(TAILS)

    def tail(side: Column) -> Column:
        low = F.col("upto") / F.col("total")
        high = (F.col("total") - F.col("upto") + F.col("n")) / F.col("total")
        return F.when(side > 0, high).when(side < 0, low).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))

    side = F.coalesce(*[F.when(F.col("stat") == s, F.lit(t)) for s, t in TAILS.items()])
    joined = salted_join(long, ecdf, ["stat", "grp", "value"], "n", total, F.col("__row"))
    scores = joined.groupBy("__row").agg(F.sum(-F.log(tail(side))).alias("score"))
    return rows.join(scores, "__row", "left").drop("__row")
