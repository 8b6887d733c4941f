"""Per-key results where a handful of keys hold most records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.skew import salted_join
from weftline.sources.tables import cut, release

#: Values of one refinement step: 2^STEP_BITS buckets for every searched interval.
STEP_BITS = 8


def exact_quantiles(df: DataFrame, key: str, value: str, fractions: list[float], names: list[str] | None = None, total: str = "n") -> DataFrame:
    """Number of values and exact quantiles of integer values per key, by distributed selection.

    Gives ``key``, ``total`` (its values) and one column per fraction (q<percent>
    unless named): the value of rank ceil(fraction * n), at least 1, among the
    key's n values in ascending order.  Null values are left out, a key with
    none has no row; a null key is a key.

    Each step counts the values of every key by bucket of the intervals that
    hold a searched rank, a mergeable histogram combined before the shuffle.
    Only the values of those buckets are searched on, in buckets 2^STEP_BITS
    times finer, until a bucket is a single value.  No more than the histogram
    of a key ever comes together in one task, however many values it has; the
    join that finds the open buckets is salted on hot keys.
    """
    names = names or [f"q{fraction * 100:g}".replace(".", "_") for fraction in fractions]
    # A struct is never null and joins null keys like others.
    rows = df.select(F.struct(F.col(key).alias("k")).alias("__key"), F.col(value).cast("bigint").alias("__v")).where("__v is not null")
    low, high = rows.agg(F.min("__v"), F.max("__v")).first()
    if low is None:
        nothing = [F.lit(None).cast("bigint").alias(x) for x in (total, *names)]
        return df.select(F.col(key), *nothing).limit(0)
    rows = rows.withColumn("__v", F.col("__v") - F.lit(low))
    shift = max(0, int(high - low).bit_length() - STEP_BITS)

    def rank(i: int) -> Column:
        return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(fractions[i]) * F.col("__all")).cast("bigint"))

    def found(searched: list[Column]) -> Column:
        """(i, rank within the bucket) of the searched ranks that a bucket holds."""
        before = F.col("__upto") - F.col("__c")
        hits = [F.when((F.col("__upto") >= r) & (before < r), F.struct(F.lit(i).alias("i"), (r - before).alias("rank"))) for i, r in enumerate(searched)]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    by_key = Window.partitionBy("__key")
    counted = rows.groupBy("__key", F.shiftrightunsigned("__v", shift).alias("__b")).agg(F.count("*").alias("__c"))
    ranked = counted.withColumn("__upto", F.sum("__c").over(by_key.orderBy("__b"))).withColumn("__all", F.sum("__c").over(by_key))
    # One row per key and open bucket, with the ranks searched in it.
    state = ranked.withColumn("__find", found([rank(i) for i in range(len(fractions))])).where(F.size("__find") > 0).select("__key", "__b", "__all", "__c", "__find")

    def searched(i: int) -> Column:
        return F.get(F.filter("__searched", lambda x: x["i"] == i), F.lit(0))["rank"]

    while shift:
        state = cut(state)
        n_rows = state.agg(F.sum("__c")).first()[0]
        bucketed = rows.withColumn("__b", F.shiftrightunsigned("__v", shift))
        inside = salted_join(bucketed, state, ["__key", "__b"], "__c", int(n_rows), F.col("__v")).select("__key", "__v")
        # What is left gets less with every step.
        before, rows = rows, cut(inside)
        release(before)
        fine = max(0, shift - STEP_BITS)
        counted = rows.groupBy("__key", F.shiftrightunsigned("__v", shift).alias("__b"), F.shiftrightunsigned("__v", fine).alias("__child")).agg(F.count("*").alias("__c"))
        upto = counted.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__key", "__b").orderBy("__child")))
        open_ = upto.join(state.select("__key", "__b", "__all", F.col("__find").alias("__searched")), ["__key", "__b"])
        hits = found([searched(i) for i in range(len(fractions))])
        state = open_.withColumn("__find", hits).where(F.size("__find") > 0).select("__key", F.col("__child").alias("__b"), "__all", "__c", "__find")
        shift = fine
    at = F.explode("__find").alias("f")
    values = state.select("__key", "__b", "__all", at)
    picked = [F.max(F.when(F.col("f.i") == i, F.col("__b") + F.lit(low))).alias(x) for i, x in enumerate(names)]
    return values.groupBy("__key").agg(F.max("__all").alias(total), *picked).select(F.col("__key.k").alias(key), total, *names)


def key_results(index: DataFrame, pages: DataFrame, key: str, size: str | Column, count: str, fractions: list[float]) -> DataFrame:
    """Per key: rows, quantiles of a row's size, distinct pages, occurrences and quantiles of occurrences per page.

    ``index`` has key and what ``size`` is an expression of (null counts as 0),
    one row per record; ``pages`` has key and count, one row per key and page.
    Rows and pages of a key are counted by the histograms of its quantiles, so
    a key with a third of all records costs a task no more than others.
    """
    sized = index.select(key, F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)).cast("bigint").alias("__size"))
    name = lambda what: [f"{what}_q{f * 100:g}".replace(".", "_") for f in fractions]
    rows = exact_quantiles(sized, key, "__size", fractions, name("size"), "n_rows")
    pages = cut(pages.select(key, F.col(count).cast("bigint").alias("__n")))
    per_page = exact_quantiles(pages, key, "__n", fractions, name("occurrences"), "n_pages")
    sums = pages.groupBy(key).agg(F.sum("__n").alias("n_occurrences"))
    out = reduce(lambda a, b: _null_safe_left(a, b, key), [sums, per_page], rows)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_pages", "n_occurrences")})


def _null_safe_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    b = b.withColumnRenamed(key, "__k")
    return a.join(b, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
