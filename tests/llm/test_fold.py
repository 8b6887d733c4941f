"""The folds over bytes and ids have flat states, and give the ids of the ranked merges and the exact numbers of ids."""

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()


@pytest.fixture(scope="module")
def encoder(spark):
    return bpe.Encoder(spark)


def test_a_merge_copies_no_slices(spark, encoder):
    # Copying slices and arrays of bytes made up more than half of the fold's time on rare words.
    plan = spark.createDataFrame([("x",)], "w string").select(encoder._word(F.col("w")))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "slice(" not in plan


def test_rare_words_have_the_ids_of_the_merges(spark, encoder):
    draw = random.Random(3)
    kinds = ["aeinrst", "abcdefXYZ", "0123456789", "=-", "éüñçß", "東京都川小町", "\u0000𝄞é", " \t\n"]
    words = ["".join(draw.choices(kind, k=draw.randint(1, 128 // len(max(kind, key=lambda c: len(c.encode())).encode())))) for kind in kinds for _ in range(40)]
    words += ["a" * bpe.LONG_BYTES, "ab" * (bpe.LONG_BYTES // 2), "qj", "zqx"]
    words = [w for w in words if len(w.encode()) <= bpe.LONG_BYTES]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", encoder._word(F.col("w")).alias("ids")).collect()
    assert len(got) == len(words) > 200
    assert {r.w: r.ids for r in got} == {w: bpe.merge_bytes(w.encode(), encoder.ranks) for w in words}


def test_ids_within_bytes_are_counted_with_a_flat_state(spark, encoder):
    size = {v: len(k) for k, v in encoder.ranks.items()}
    ids = bpe.merge_bytes("the quick東京都 zqxv Äß\n\n b".encode(), encoder.ranks)
    rows = [(ids, n) for n in range(40)] + [([], 0), ([], 5), (ids, None), (None, 3)]
    df = spark.createDataFrame(rows, "ids array<int>, n int").select("ids", "n", encoder.tokens_within(F.col("ids"), F.col("n")).alias("k"))
    within = lambda x, n: None if x is None or n is None else sum(sum(size[i] for i in x[: j + 1]) <= n for j in range(len(x)))
    assert [r.k for r in df.collect()] == [within(*r) for r in rows]
    # A struct for every id, also behind the last that fits, was a good part of p9's time.
    assert "struct(" not in df._jdf.queryExecution().analyzed().toString()
