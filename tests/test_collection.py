"""Contracts of string and pair sets."""

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators.collection import PairSet, StringSet, to_cells, transpose

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=8)


def test_pair_expansion(spark, rows):
    out = StringSet.parallelize(spark, "abcde").flat_map_to_pair(lambda s: [(s, s + s), (s, s * 3)])
    assert rows(out.df) == sorted([(s, s * k) for s in "abcde" for k in (2, 3)])


def test_digits_of_numbers(spark):
    numbers = StringSet.parallelize(spark, map(str, range(10_000)))
    first = F.substring("value", 1, 1)
    assert numbers.flat_map(F.array_repeat(first, first.cast("int"))).count() == 49_995
    assert numbers.flat_map(lambda s: [s[0]] * int(s[0])).count() == 49_995


def test_nulls_are_dropped(spark):
    s = StringSet.parallelize(spark, ["a", "b", "b"])
    assert s.flat_map(lambda x: None if x == "a" else [x, None]).collect() == ["b", "b"]
    assert s.map_to_pair(lambda x: None if x == "b" else (x, x)).collect() == [("a", "a")]
    assert s.map_to_pair(F.when(F.col("value") == "b", F.struct(F.col("value").alias("k"), F.lit("1").alias("v")))).collect() == [("b", "1")] * 2


def test_fold_applies_zero_per_partition(spark):
    two = StringSet(spark.createDataFrame([("a",), ("b",)], "value string").repartitionByRange(2, "value"))
    assert two.fold("Z", lambda a, b: a + b) == "ZZaZb"
    assert StringSet.parallelize(spark, []).fold("Z", lambda a, b: a + b) == "Z"


def test_fold_by_key_applies_zero_once(spark):
    pairs = PairSet.parallelize(spark, [("k", "b"), ("k", "a"), ("z", "c")])
    for associative in (True, False):
        assert sorted(pairs.fold_by_key("Z", lambda a, b: a + b, associative).collect()) == [("k", "Zab"), ("z", "Zc")]


@few
@given(PAIRS)
def test_fold_by_key_of_a_hot_key(spark, pairs):
    many = pairs * 40 + [("a", "x")] * 500
    expected = defaultdict(str)
    for k, v in sorted(many):
        expected[k] += v
    assert dict(PairSet.parallelize(spark, many).fold_by_key("", lambda a, b: a + b).collect()) == expected


@few
@given(PAIRS, PAIRS)
def test_join_and_cogroup(spark, a, b):
    left, right = PairSet.parallelize(spark, a), PairSet.parallelize(spark, b)
    assert sorted(left.join(right).collect()) == sorted((k, f"{v},{w}") for k, v in a for q, w in b if k == q)
    lists = lambda side, k: "[" + ",".join(sorted(v for q, v in side if q == k)) + "]"
    assert sorted(left.cogroup(right).collect()) == sorted((k, f"{lists(a, k)},{lists(b, k)}") for k in {x[0] for x in a + b})


def test_cogroup_contract(spark):
    left = PairSet.parallelize(spark, [("fruit", "apple"), ("fruit", "banana")])
    right = PairSet.parallelize(spark, [("fruit", x) for x in ("cherry", "date", "fig")])
    assert left.cogroup(right).collect() == [("fruit", "[apple,banana],[cherry,date,fig]")]


def test_counts(spark):
    p = PairSet.parallelize(spark, [("k", "1"), ("k", "2"), ("z", "9")])
    assert (p.count_keys(), p.count_pairs()) == (2, 3)
    assert p.last_by_key().count_pairs() == 2


def test_sets(spark):
    a, b = StringSet.parallelize(spark, "aabbc"), StringSet.parallelize(spark, "bccd")
    assert sorted(a.intersection(b).collect()) == ["b", "c"]
    assert Counter(a.distinct().collect()) == Counter("abc")
    assert sorted(a.group_by(lambda s: "vowel" if s in "aeiou" else "other").collect()) == [("other", "b,b,c"), ("vowel", "a,a")]
    assert sorted(a.map_partitions(lambda xs: (x.upper() for x in xs)).collect()) == list("AABBC")
    assert a.sample(1.0).count() == 5 and a.sample(0.0).count() == 0
    assert len(a.take(2)) == 2


def test_destroyed_handles_raise(spark):
    s = StringSet.parallelize(spark, ["a"])
    s.destroy()
    with pytest.raises(RuntimeError):
        s.count()


def test_transpose(spark, rows):
    cells = to_cells(spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id int, x string, y int"), "id")
    assert rows(transpose(cells)) == [("x", "1", "a"), ("x", "2", "b"), ("y", "2", "3")]
