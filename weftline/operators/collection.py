"""String sets and key-value pair sets: multisets of strings as lazy DataFrame plans.

Every method takes either a ``Column`` over ``value`` (and ``key`` for pairs),
which stays in the JVM, or a plain Python function, which runs over Arrow
batches.  Nulls that a function gives are dropped, as are null iterables.  A
handle that was destroyed raises on further use.  Where the order of elements
matters (folds, lists), it is the binary order of the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "key string, value string"


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


def _strings(rows: list, width: int) -> pa.RecordBatch:
    """Rows of ``width`` strings as a batch; single strings for a width of 1."""
    if width == 1:
        return pa.record_batch([pa.array(rows, pa.string())], names=["value"])
    keys, values = ([x[i] for x in rows] for i in (0, 1))
    return pa.record_batch([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])


def _flat(f: Callable, width: int):
    """Arrow function that emits what ``f`` gives for each row; null iterables and elements are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _columns(batch)
            out = [y for xs in zip(*columns) for y in (f(xs[0] if len(xs) == 1 else xs) or ()) if y is not None]
            if out:
                yield _strings(out, width)

    return run


def _one(f: Callable) -> Callable:
    return lambda x: (f(x),)


def _keep(f: Callable):
    """Arrow function that keeps the rows whose last column satisfies ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(f(x)) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.bool_()))

    return run


class _Handle:
    columns: tuple[str, ...]

    def __init__(self, df: DataFrame):
        self._df: DataFrame | None = df.select(*self.columns)

    @property
    def df(self) -> DataFrame:
        """The rows; raises once the handle was destroyed."""
        if self._df is None:
            raise RuntimeError("this set was destroyed")
        return self._df

    def destroy(self) -> None:
        """Release the handle; later use raises."""
        self.df.unpersist()
        self._df = None

    def save_as_table(self, name: str) -> None:
        """Write as a table of the catalog; raises if the table exists."""
        self.df.write.mode("errorifexists").saveAsTable(name)

    def _emit(self, f: Column | Callable, width: int) -> DataFrame:
        if not isinstance(f, Column):
            return self.df.mapInArrow(_flat(f, width), "value string" if width == 1 else PAIR)
        rows = self.df.select(F.explode(f).alias("x")).where("x is not null")
        if width == 1:
            return rows.select(F.col("x").cast("string").alias("value"))
        return _pair_columns(rows, F.col("x"))

    def _emit_pair(self, f: Column | Callable) -> DataFrame:
        if not isinstance(f, Column):
            return self._emit(_one(f), 2)
        return _pair_columns(self.df.select(f.alias("x")).where("x is not null"), F.col("x"))


def _pair_columns(rows: DataFrame, x: Column) -> DataFrame:
    """The first two fields of a struct column as key and value."""
    a, b = rows.select(x.alias("x")).schema["x"].dataType.names[:2]
    return rows.select(x[a].cast("string").alias("key"), x[b].cast("string").alias("value"))


class StringSet(_Handle):
    """A multiset of strings: the rows of a DataFrame (value string)."""

    columns = ("value",)

    @classmethod
    def parallelize(cls, spark: SparkSession, values: Iterable[str]) -> StringSet:
        """A set of the given strings; repeated ones stay."""
        table = pa.table({"value": pa.array(list(values), pa.string())})
        return cls(spark.createDataFrame(table))

    @classmethod
    def from_rows(cls, df: DataFrame, f: Column | Callable[[dict], str | None]) -> StringSet:
        """One string per row of a table, by an expression or a function of the row as a dict; nulls are dropped."""
        if isinstance(f, Column):
            return cls(df.select(f.cast("string").alias("value")).where("value is not null"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _strings([y for row in batch.to_pylist() if (y := f(row)) is not None], 1)

        return cls(df.mapInArrow(run, "value string"))

    def flat_map(self, f: Column | Callable[[str], Iterable[str] | None]) -> StringSet:
        """All strings that ``f`` (an array expression or a function) gives for each element."""
        return StringSet(self._emit(f, 1))

    def flat_map_to_pair(self, f: Column | Callable[[str], Iterable[tuple[str, str]] | None]) -> PairSet:
        """All pairs that ``f`` (an array of structs or a function) gives; equal pairs stay."""
        return PairSet(self._emit(f, 2))

    def map_to_pair(self, f: Column | Callable[[str], tuple[str, str] | None]) -> PairSet:
        """The pair that ``f`` (a struct or a function) gives for each element."""
        return PairSet(self._emit_pair(f))

    def filter(self, f: Column | Callable[[str], bool]) -> StringSet:
        """The elements that satisfy ``f``; a null result drops."""
        return StringSet(self.df.where(f) if isinstance(f, Column) else self.df.mapInArrow(_keep(f), "value string"))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterator[str]]) -> StringSet:
        """What ``f`` makes of the iterator of each partition's elements; results are passed on in batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[str] = []
            for x in f(y for batch in batches for y in batch.column(0).to_pylist()):
                out.append(x)
                if len(out) == 4096:
                    yield _strings(out, 1)
                    out = []
            yield _strings(out, 1)

        return StringSet(self.df.mapInArrow(run, "value string"))

    def sample(self, fraction: float, seed: int | None = None) -> StringSet:
        """Each element with probability ``fraction``, repeated ones independently."""
        return StringSet(self.df.sample(False, min(1.0, max(0.0, fraction)), seed))

    def distinct(self) -> StringSet:
        return StringSet(self.df.distinct())

    def intersection(self, other: StringSet) -> StringSet:
        """Values that both sets have, each once."""
        return StringSet(self.df.intersect(other.df))

    def group_by(self, f: Column | Callable[[str], str]) -> PairSet:
        """(key, elements joined by commas in order), one row per key of ``f``."""
        if isinstance(f, Column):
            rows = self.df.select(f.cast("string").alias("key"), "value")
        else:
            rows = self.df.mapInArrow(_flat(lambda x: ((f(x), x),), 2), PAIR)
        return PairSet(rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value")))

    def fold(self, zero: str, f: Callable[[str, str], str]) -> str:
        """Fold of all elements; ``zero`` is applied once per non-empty partition and once on the driver.

        ``f`` must be associative and commutative.  One partial result per
        partition comes to the driver.  For sums and the like use ``aggregate``.
        """
        part = self.df.select(F.spark_partition_id().cast("string").alias("key"), "value")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, acc = None, zero
            for batch in batches:
                for key, x in zip(*_columns(batch)):
                    acc = f(acc, x)
            if key is not None:
                yield _strings([(key, acc)], 2)

        parts = sorted(part.mapInArrow(run, PAIR).collect(), key=lambda r: int(r["key"]))
        return reduce(f, (r["value"] for r in parts), zero)

    def aggregate(self, *columns: Column) -> DataFrame:
        """Built-in aggregates of ``value``: partial sums per partition, combined at the end."""
        return self.df.agg(*columns)

    def take(self, n: int) -> list[str]:
        """Any ``n`` elements; reads no further partitions than needed."""
        return [r["value"] for r in self.df.take(n)]

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[str]:
        """All elements on the driver; for small results."""
        return [r["value"] for r in self.df.collect()]


class PairSet(_Handle):
    """A multiset of (key, value) pairs of strings."""

    columns = ("key", "value")

    @classmethod
    def parallelize(cls, spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> PairSet:
        rows = list(pairs)
        arrays = [pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)]
        return cls(spark.createDataFrame(pa.table(arrays, names=["key", "value"])))

    def flat_map(self, f: Column | Callable[[tuple[str, str]], Iterable[str] | None]) -> StringSet:
        return StringSet(self._emit(f, 1))

    def flat_map_to_pair(self, f: Column | Callable[[tuple[str, str]], Iterable[tuple[str, str]] | None]) -> PairSet:
        return PairSet(self._emit(f, 2))

    def map_to_pair(self, f: Column | Callable[[tuple[str, str]], tuple[str, str] | None]) -> PairSet:
        """One pair per pair; pairs of equal key stay (see ``last_by_key``)."""
        return PairSet(self._emit_pair(f))

    def filter(self, f: Column | Callable[[str], bool]) -> PairSet:
        """The pairs whose value satisfies ``f``; a function sees the value only."""
        return PairSet(self.df.where(f) if isinstance(f, Column) else self.df.mapInArrow(_keep(f), PAIR))

    def last_by_key(self) -> PairSet:
        """One pair per key: the one of highest value."""
        return PairSet(self.df.groupBy("key").agg(F.max("value").alias("value")))

    def join(self, other: PairSet) -> PairSet:
        """For every key of both sets all pairs of their values, joined by a comma; null keys join nothing.

        The join strategy, and the split of hot keys, are left to adaptive execution.
        """
        b = other.df.withColumnRenamed("value", "other")
        return PairSet(self.df.join(b, "key").select("key", F.concat("value", F.lit(","), "other").alias("value")))

    def cogroup(self, other: PairSet) -> PairSet:
        """(key, "[a,b],[c]"): the values of both sides in order, one row per key of either side.

        The sides are united with a tag, so one shuffle serves both.
        """
        tagged = self.df.select("key", "value", F.lit(0).alias("side")).unionByName(other.df.select("key", "value", F.lit(1).alias("side")))

        def side(i: int) -> Column:
            values = F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("value"))))
            return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))

        return PairSet(tagged.groupBy("key").agg(F.concat(side(0), F.lit(","), side(1)).alias("value")))

    def fold_by_key(self, zero: str, f: Callable[[str, str], str], associative: bool = True) -> PairSet:
        """(key, fold of its values in order), ``zero`` applied once per key.

        The pairs are range-partitioned by key and value, so a hot key is
        spread over several tasks; each folds its share as a stream, and the
        shares (at most one per task and key) are folded in order.  A function
        that is not associative takes a key's values in one task, as a stream.
        For sums and the like use ``aggregate_by_key``.
        """
        if not associative:
            rows = self.df.repartition("key").sortWithinPartitions("key", "value").select("key", F.lit("0").alias("part"), "value")
            return PairSet(rows.mapInArrow(_fold_runs(f, zero), "key string, part string, value string"))
        tie = F.xxhash64(F.monotonically_increasing_id())
        ranged = self.df.withColumn("tie", tie).repartitionByRange("key", "value", "tie").sortWithinPartitions("key", "value")
        kind = "key string, part string, value string"
        shares = ranged.select("key", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("part"), "value").mapInArrow(_fold_runs(f, None), kind)
        ordered = shares.repartition("key").sortWithinPartitions("key", "part")
        return PairSet(ordered.mapInArrow(_fold_runs(f, zero), kind))

    def aggregate_by_key(self, *columns: Column) -> DataFrame:
        """Built-in aggregates of ``value`` by key, combined before the shuffle."""
        return self.df.groupBy("key").agg(*columns)

    def ordered(self) -> DataFrame:
        """The pairs in order of key, then value."""
        return self.df.orderBy("key", "value")

    def count_keys(self) -> int:
        """Distinct keys; a null key is one."""
        return self.df.select("key").distinct().count()

    def count_pairs(self) -> int:
        return self.df.count()

    def collect(self) -> list[tuple[str, str]]:
        """All pairs on the driver; for small results."""
        return [(r["key"], r["value"]) for r in self.df.collect()]


def _fold_runs(f: Callable[[str, str], str], zero: str | None):
    """Arrow function that folds the values of each run of equal keys; without ``zero`` from its first value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        acc = None
        names = ["key", "part", "value"]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in rows], pa.string()) for i in range(3)], names=names)

        for batch in batches:
            done = []
            for key, part, x in zip(*_columns(batch)):
                if last is None or key != last[0]:
                    if last is not None:
                        done.append((*last, acc))
                    acc = x if zero is None else f(zero, x)
                    last = (key, part)
                else:
                    acc = f(acc, x)
            if done:
                yield emit(done)
        if last is not None:
            yield emit([(*last, acc)])

    return run


def transpose(cells: DataFrame) -> DataFrame:
    """A table of cells (key, col, value) with rows and columns exchanged."""
    return cells.select(F.col("col").alias("key"), F.col("key").alias("col"), "value")


def to_cells(df: DataFrame, key: str) -> DataFrame:
    """The columns of a wide table besides ``key`` as cells (key, col, value string); null cells are absent."""
    rest = [c for c in df.columns if c != key]
    wide = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("string").alias(c) for c in rest])
    return wide.unpivot("key", rest, "col", "value").where("value is not null")
