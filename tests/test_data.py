"""Packed fields, orphan references, hot keys, salted joins and written tables, against brute force."""

import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.packed import LINKS, Packing, posting, split_items, split_values
from weftline.operators import skew
from weftline.operators.hotkeys import exact_quantiles, key_results
from weftline.operators.orphans import orphan_references, orphan_report
from weftline.operators.packed import split_packed
from weftline.operators.postings import word_pages
from weftline.sources.tables import cut, cuts, release

CASES = [
    (None, []),
    ("", []),
    (" ;, ", []),
    ("alpha;beta;gamma", ["alpha", "beta", "gamma"]),
    ("'x;y';z", ["x;y", "z"]),
    (r"a\;b;c", ["a;b", "c"]),
    ("it's;fine", ["it's", "fine"]),
    ('["a;b", c]', ["a;b", "c"]),
    ("[[a,b],[c]]", ["[a,b]", "[c]"]),
    ("[http://a/x;http://b/y],[http://c/z]", ["[http://a/x;http://b/y]", "[http://c/z]"]),
    ('"open;x', ["open", "x"]),
    ("a;a;a", ["a", "a", "a"]),
]
LINK_CASES = [
    ("http://a/x,y;http://b/", ["http://a/x,y", "http://b/"]),
    ('"http://a/x;v=1", HTTPS://b', ["http://a/x;v=1", "HTTPS://b"]),
    (r'["http:\/\/a\/x", "http:\/\/b"]', ["http://a/x", "http://b"]),
    ("http://a/x[1];http://b", ["http://a/x[1]", "http://b"]),
    ("[http://a/x;http://b/y],[http://c/z]", ["http://a/x", "http://b/y", "http://c/z"]),
    ('"http://a;"http://b"', ["http://a", "http://b"]),
    ("'http://a,b','http://c", ["http://a,b", "http://c"]),
    ("http://a|1;;\t;http://b;", ["http://a|1", "http://b"]),
    ("no link", []),
]


@pytest.mark.parametrize("field,expected", CASES)
def test_values(field, expected):
    assert split_values(field) == expected


@pytest.mark.parametrize("field,expected", LINK_CASES)
def test_links(field, expected):
    assert split_items(field) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab;,' \"[]\\", min_size=1, max_size=6), max_size=6))
def test_quoted_values_come_back(values):
    values = [v for v in (x.strip() for x in values) if v]
    packed = ";".join('"' + "".join("\\" + c if c in '"\\' else c for c in v) + '"' for v in values)
    # Without other quotes, every escaped and quoted value is given back as it was.
    p = Packing(quotes='"', nested=False, opening="", closing="")
    assert split_values(packed, p) == values


@pytest.mark.parametrize("field", [";'" * 50_000, "'a;" * 50_000, "[" * 50_000, "\\" * 50_001, "http://a;" * 50_000])
def test_long_fields(field):
    split_values(field)
    assert len(split_values(field, LINKS)) in (0, 50_000)


def test_posting():
    assert posting("http://a:80/x:3:1 2:QQ==") == ("http://a:80/x", "3", "1 2", "QQ==") and posting("http://a") == ("http://a", "", "", "")


def test_split_packed(spark, rows):
    df = spark.createDataFrame([(1, "http://a;http://b", "x"), (1, "http://a;http://b", "x"), (None, "http://c", "y"), (3, None, "z"), (4, "", "z")], "id long, f string, pos string")
    assert rows(split_packed(df, {"row_id": "id"}, "f")) == sorted([(1, 0, "http://a"), (1, 1, "http://b")] * 2 + [(None, 0, "http://c")], key=repr)
    assert rows(split_packed(df.limit(0), {"row_id": "id", "why": "pos"}, "f")) == []
    assert rows(split_packed(df.where("id is null"), {"row_id": "id", "why": "pos"}, "f")) == [(None, "y", 0, "http://c")]


def test_orphans_of_two_tables(spark, rows):
    rng = random.Random(3)
    parents = [(t, f"k{rng.randrange(8)}", rng.randrange(5), i, rng.choice([200, 404, 410, None])) for t in "ab" for i in range(12)]
    children = [(t, rng.choice([f"k{rng.randrange(12)}", "hot", None]), rng.choice([0, 1, 2, 3, 4, None]), i) for t in "abc" for i in range(60)]
    pdf = spark.createDataFrame(parents, "parent_table string, key string, period int, at int, state int").withColumn("row_id", F.lit(0))
    cdf = spark.createDataFrame(children, "parent_table string, key string, period int, row_id int")

    def orphan(t, key, period):
        seen = [(p, at, s) for pt, k, p, at, s in parents if pt == t and k == key and p <= period]
        by = max(((p, at, -1 if s is None else s) for p, at, s in seen), default=None)
        return by is None or by[2] in (404, 410)

    lost = [(t, i, k, p) for t, k, p, i in children if k is not None and p is not None and orphan(t, k, p)]
    assert rows(orphan_references(pdf, cdf)) == sorted(lost, key=repr)
    report = {(r.parent_table, r.period): (r.refs, r.orphan_refs) for r in orphan_report(pdf, cdf).collect()}
    for t in "abc":
        for p in range(5):
            assert report[t, p] == (sum(c[0] == t and c[2] == p and c[1] is not None for c in children), sum(x[0] == t and x[3] == p for x in lost))
    assert rows(orphan_references(pdf, cdf.limit(0))) == [] and orphan_references(pdf.limit(0), cdf).count() == sum(c[1] is not None and c[2] is not None for c in children)


def test_quantiles_of_wide_values_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 200)
    rng = random.Random(5)
    data = [("hot", rng.choice([7, rng.getrandbits(30)])) for _ in range(4000)] + [(rng.choice(["a", "b", None]), rng.getrandbits(34) - (1 << 33)) for _ in range(300)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(data, "k string, v long")
    fractions = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: tuple(r)[1:] for r in exact_quantiles(df, "k", "v", fractions).collect()}
    for key in ("hot", "a", "b", None, "one"):
        values = sorted(v for k, v in data if k == key and v is not None)
        assert got[key] == (len(values), *(values[max(1, math.ceil(f * len(values))) - 1] for f in fractions))
    assert "none" not in got
    assert exact_quantiles(df.limit(0), "k", "v", [0.5]).collect() == [] == exact_quantiles(df.where("v is null"), "k", "v", [0.5]).collect()


def test_rows_are_counted_by_the_selection(spark, monkeypatch):
    from weftline.operators import hotkeys

    index = spark.createDataFrame([("a", "xx"), ("a", None), ("b", "x" * 5000), (None, "")], "word string, f string")
    pages = spark.createDataFrame([("a", 3), ("a", 1)], "word string, n int")
    run = lambda: {r.word: (r.n_rows, r.n_pages, r.n_occurrences, r.size_q50, r.occurrences_q50) for r in key_results(index, pages, "word", F.length("f"), "n", [0.5]).collect()}
    assert run() == {"a": (2, 2, 4, 0, 1), "b": (1, 0, 0, 5000, None), None: (1, 0, 0, 0, None)}
    # Without the histograms there is no count.
    monkeypatch.setattr(hotkeys, "exact_quantiles", lambda df, key, *a: exact_quantiles(df.limit(0), key, *a))
    assert run() == {}


def test_word_pages(spark, rows):
    one = "http://a:5:1 2:QQ=="
    index = spark.createDataFrame([("w", f"{one},{one}"), ("w", f"{one},http://a:5:4:QQ=="), ("v", None), (None, one), ("u", "")], "word string, accumulated_value string")
    assert rows(word_pages(index)) == [("w", "http://a", 3)]


def test_salted_join(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 10)
    left = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1), (None, 2)], "k string, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is not null")
    joined = skew.salted_join(left, right, ["k"], "n", 102, F.col("v"), "left")
    assert rows(joined) == sorted([("hot", i, 100) for i in range(100)] + [("cold", 1, 1), (None, 2, None)], key=repr)


def test_written_tables_are_released(spark):
    with cuts():
        df = cut(spark.range(3))
        assert os.path.exists(df._cut_path) and df.count() == 3
    assert not os.path.exists(df._cut_path)
    df = cut(spark.range(3))
    release(df, spark.range(1))
    assert not os.path.exists(df._cut_path)
