"""Joins on keys of which a few may own a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with fewer rows are never split: a task takes so many in any case.
MIN_HOT_ROWS = 50_000


def hot_limit(df: DataFrame, total: int) -> int:
    """Rows from which a key is hot: the mean rows of a shuffle partition, so at most as many keys are hot as there are partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_HOT_ROWS, -(-total // max(1, partitions)))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right`` (unique on ``on``; ``weight`` = rows of ``left`` with that key).

    A key with more than ``hot_limit`` rows on the left is hot: its rows get a
    salt from the hash of ``spread``, its row on the right one copy per salt.
    At most one key per shuffle partition can be hot, so the broadcast list of
    them and the added copies are bounded; no rows are dropped.  Null keys join
    nothing (they are kept by how="left").
    """
    limit = hot_limit(left, total)
    salts = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    hot = right.where(F.col(weight) > limit).select(*on, salts.alias("__salts"))
    spread_left = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = F.when(F.col(weight) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    spread_right = right.withColumn("__salt", F.explode(copies))
    return spread_left.join(spread_right, [*on, "__salt"], how).drop("__salt")
