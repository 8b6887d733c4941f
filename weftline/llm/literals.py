"""Bounded lookup tables as literals of a query plan.

A table is laid out as an array of ``BUCKETS`` small maps, the bucket being the
CRC-32 of the key, so a lookup is one array access and a scan of one or two
entries.  As a literal it travels once per executor with the stage's code and
can be used inside higher-order functions, where subqueries are not allowed.
Only for tables of a proven size: callers bound the number of entries.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BUCKETS = 65_536


def array_literal(spark: SparkSession, values: pa.Array) -> Column:
    """An Arrow array as one literal of an array type."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    df = spark.createDataFrame(pa.table({"v": one}))
    row = df._jdf.queryExecution().executedPlan().executeCollect()[0]
    jvm = spark._jvm
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal.create(row.getArray(0), df._jdf.schema().apply(0).dataType())
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def map_literal(spark: SparkSession, keys: list[bytes], values: pa.Array) -> Column:
    """Keys and values as an array of hashed maps, for ``lookup``."""
    bucket = np.fromiter((zlib.crc32(k) % BUCKETS for k in keys), np.int64, len(keys))
    order = np.argsort(bucket, kind="stable")
    offsets = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)
    take = pa.array(order)
    maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.binary()).take(take), values.take(take))
    return array_literal(spark, maps)


def lookup(table: Column, key: Column) -> Column:
    """The value of a binary key, null where there is none."""
    return F.try_element_at(F.get(table, F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")), key)
