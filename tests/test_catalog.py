"""Tables by name."""

import uuid

import pytest
from pyspark.errors import AnalysisException

from weftline.operators.collection import PairSet
from weftline.sources.catalog import Catalog, key_range, page, upsert_cells, upsert_rows


@pytest.fixture
def name(spark):
    n = "t" + uuid.uuid4().hex
    yield n
    for suffix in ("", "2"):
        spark.sql(f"DROP TABLE IF EXISTS {n}{suffix}")


def test_life_of_a_table(spark, rows, name):
    c = Catalog(spark)
    assert c.count(name) == 0 and not c.exists(name)
    c.put(name, spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    with pytest.raises(AnalysisException):
        c.put(name, spark.createDataFrame([("a", "1")], "key string, value string"))
    c.put(name, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"), "merge")
    assert rows(c.scan(name)) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert rows(c.scan(name, "b", "c")) == [("b", "3")]
    assert (c.get(name, "b", "value"), c.get(name, "x", "value"), c.has_row(name, "a"), c.has_row(name, "x")) == ("3", None, True, False)
    first, cursor = c.page(name, size=2)
    assert (rows(first), rows(cursor)) == ([("a", "1"), ("b", "3")], [("c",)])
    c.rename(name, name + "2")
    assert name + "2" in c.tables() and name not in c.tables()
    c.drop(name + "2")
    assert not c.exists(name + "2")


def test_pairs_are_saved(spark, rows, name):
    PairSet.parallelize(spark, [("k", "1"), ("k", "1")]).save_as_table(name)
    assert rows(spark.table(name)) == [("k", "1")] * 2


def test_cells(spark, rows, name):
    c = Catalog(spark)
    c.put_cells(name, spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "key string, col string, value string"))
    c.put_cells(name, spark.createDataFrame([("a", "y", "3"), ("b", "x", "4")], "key string, col string, value string"))
    assert rows(c.scan(name)) == [("a", "x", "1"), ("a", "y", "3"), ("b", "x", "4")]


def test_upserts_of_empty_tables(spark, rows):
    t = spark.createDataFrame([("a", 1)], "key string, value int")
    assert rows(upsert_rows(t, t.limit(0), "key")) == rows(upsert_rows(t.limit(0), t, "key")) == [("a", 1)]
    cells = spark.createDataFrame([("a", "x", "1")], "key string, col string, value string")
    assert rows(upsert_cells(cells.limit(0), cells)) == [("a", "x", "1")]


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS key").write.parquet(str(tmp_path / "t"))
    plan = key_range(spark.read.parquet(str(tmp_path / "t")), "key", 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,10)" in plan and "LessThan(key,20)" in plan
    assert [r.key for r in page(spark.read.parquet(str(tmp_path / "t")), "key", 95, 10)[0].collect()] == [95, 96, 97, 98, 99]
