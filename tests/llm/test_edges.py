"""All queries of the subpackage on empty tables, nulls, repeated rows, clashing columns and long texts; other languages."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from weftline.llm import bpe, distinctive, packing, pages, queries
from weftline.llm.prose import statistics

PL = "W małym mieście nad rzeką stał stary dom z czerwonym dachem. Każdego ranka dzieci szły przez most do szkoły, a ich matki kupowały chleb na targu."
PL2 = "Wieczorem wszyscy siedzieli przy ogniu i opowiadali sobie historie o dawnych czasach. Nikt się nie śpieszył, bo zima była długa i śnieg leżał wysoko."
JA = "川のそばの小さな町に、赤い屋根の古い家がありました。毎朝、子供たちは橋を渡って学校へ行きました。"
JA2 = "夜になると、みんなは火のそばに座って昔の話をしました。冬は長く、雪は深かったので、だれも急ぎませんでした。"
EN = "The dog is in the old house and sleeps. The cat will not play with the mouse today. We have gone to the river after the work."

CRAWL = pa.schema([("fetch_id", pa.int64()), ("host", pa.string()), ("url", pa.string()), ("page", pa.string()), ("outbound", pa.string()), ("n", pa.string()), ("own", pa.string()), ("__salt", pa.int32())])
INDEX = pa.schema([("entry_id", pa.int64()), ("word", pa.string()), ("accumulated_value", pa.string()), ("idf", pa.float64()), ("flushed_at", pa.timestamp("us")), ("url", pa.string()), ("df", pa.int32())])
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("ids", pa.string()), ("grp", pa.string()), ("__words", pa.string())])


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", 4).config("spark.ui.enabled", False).getOrCreate()


def write(out, crawl=(), index=(), docs=()):
    for name, schema, rows in (("crawl", CRAWL, crawl), ("pt_index", INDEX, index), ("documents", DOCS, docs)):
        columns = [[(r[i] if i < len(r) else None) for r in rows] for i in range(len(schema))]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), out / f"{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, write(tmp_path)).collect() == []


POST = "http://a.test/:5:1 2:QQ=="
LONG = "the end of the " * 20_000


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    body = f"<html lang='en'><body><main><p>{EN}</p><p>{EN[:70]}</p></main></body></html>"
    crawl = [(1, "a.test", "http://a.test/", body), (1, "a.test", "http://a.test/", body), (None, None, None, body), (2, "b", "http://b", None), (3, "b", "http://b/", ""), (4, "b", "http://b/", "<p>" + LONG), (5, "c", None, "<<<>&#x0;")]
    index = [(1, "w", POST), (2, "w", POST), (None, None, POST), (3, "v", None), (4, "u", ""), (5, "v", POST.replace("1 2", "3")), (6, "w", POST.replace("/a", "/b"), 2.0), (7, "x", "http://c:1::")]
    docs = [(1, EN, "en"), (1, EN, "en"), (None, EN, None), (2, None, "en"), (3, "", "fr"), (4, " \n\t ", None), (5, LONG, "en"), (6, "x" * 3000 + "ab" * 500 + "é" * 400, "xx"), (7, "\u0000퟿𝄞 é", "de")]
    return write(tmp_path_factory.mktemp("sf"), crawl, index, docs)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_dirty_tables(spark, dirty, name):
    rows = [r.asDict() for r in queries.queries()[name](spark, dirty).collect()]
    if name in ("p8_ids", "p8_round_trip", "p10_statistics"):
        assert len(rows) == 9
    if name == "p8_ids":
        assert [r["ids"] for r in rows if r["doc_id"] in (2, 3)] == [[], []] and all(r["ids"] for r in rows if r["doc_id"] not in (2, 3))
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("pt_index", "documents"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{dirty}/{t}.parquet'")
        rel = con.sql(queries.oracle_sql()[name])
        expected = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        by = lambda r: repr(sorted((k, v) for k, v in r.items() if not isinstance(v, float)))
        assert [by(r) for r in sorted(rows, key=by)] == [by(r) for r in sorted(expected, key=by)]


def test_long_words_and_all_bytes(spark):
    encoder = bpe.Encoder(spark)
    texts = ["=" * 127, "=" * 128, "=" * 129, "=" * 5000, "東京都" * 20, "東京都" * 100, "".join(map(chr, range(0x20, 0x250)))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in encoder.encode(df, "text").collect():
        expected = [i for w in spark.createDataFrame([(r.text,)], "t string").select(bpe.words(bpe.F.col("t")).alias("w")).first().w for i in bpe.merge_bytes(w.encode(), encoder.ranks)]
        assert r.ids == expected


def test_ids_equal_another_implementation(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    encoder = bpe.Encoder(spark)
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    texts = [EN, PL, JA, "don't  stop\n\n\tI'll 123abc  ", "x" * 300, "   a　b", "<|endoftext|>"]
    got = encoder.encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r.text: r.ids for r in got} == {t: other.encode_ordinary(t) for t in texts}


def test_pages_and_texts_of_other_languages_are_kept(spark, tmp_path):
    page = lambda *ps: "<html><body><ul class='nav'><li><a href='/1'>Home</a></li></ul><div class='text'>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></body></html>"
    crawl = [(1, "pl.test", "http://pl.test/1", page(PL, PL2)), (2, "ja.test", "http://ja.test/1", page(JA, JA2)), (3, "en.test", "http://en.test/", page(EN, EN[40:]))]
    crawl.append((4, "en.test", "http://en.test/x", page("cheap shoes cheap boots cheap bags cheap shoes cheap hats cheap shoes cheap belts cheap shoes cheap shoes cheap ties")))
    sf = write(tmp_path, crawl, docs=[(i, EN, "en") for i in range(50)])
    assert [r.fetch_id for r in queries.p2_found(spark, sf).collect()] == [4]
    assert {r.fetch_id for r in queries.p5_found(spark, sf).collect()} == {1, 2, 3}
    assert statistics(PL)[1] == statistics(JA)[1] == 0.0


def test_stuffing_spread_over_short_lines(spark):
    line = lambda w: (1, "p", 1, 6, 3, 0, 0, 0, 0, 0, 0, 1, None, None, w, None, None)
    rows = [([line([7, i, i + 100]) for i in range(8)],), ([line([i, i + 100]) for i in range(8)],)]
    df = spark.createDataFrame(rows, f"own array<{pages.BLOCK}>")
    assert [r.s for r in df.select(pages.stuffed_share(bpe.F.col("own"), bpe.F.lit(0), [pages.DEFAULTS] * 6).alias("s")).collect()] == [0.0, 0.0]
    rows = [([line([7, 7, i]) for i in range(8)],)]
    df = spark.createDataFrame(rows, f"own array<{pages.BLOCK}>")
    assert df.select(pages.stuffed_share(bpe.F.col("own"), bpe.F.lit(0), [pages.DEFAULTS] * 6).alias("s")).first().s == 1.0


def test_out_links_tell_link_lists(spark):
    block = (1, "p", 1, 10, 5, 0, 0, 55, 0, 0, 0, 1, None, None, None, None, None)
    df = spark.createDataFrame([([block] * 3, 0), ([block] * 3, 30), ([], 30)], f"own array<{pages.BLOCK}>, n_out int")
    assert [r.s for r in df.select(pages.stuffed_share(bpe.F.col("own"), bpe.F.col("n_out"), [pages.DEFAULTS] * 6).alias("s")).collect()] == [0.0, 1.0, 0.0]


def test_thresholds_differ_by_language(spark, tmp_path):
    block = lambda lang, f, tw: (1, "p", 1, 20, f, lang, 0, 0, tw, 1, 0, 1, None, None, None, None, None)
    rows = [([block(0, 10, 1), block(1, 6, 2)],)] * 60
    found = pages.calibrate(spark.createDataFrame(rows, f"own array<{pages.BLOCK}>"))
    assert found[0][:2] == pytest.approx((0.2, 0.125)) and found[1][:2] == pytest.approx((0.12, 0.25)) and found[2] == pages.DEFAULTS


def test_llr_against_brute_force(spark):
    import math
    from collections import Counter

    counts = [("a", "u", 3), ("b", "u", 1), ("a", "v", 1), ("c", "v", 9), ("d", "w", 2), ("a", "w", None), (None, "w", 1)]
    kept = [c for c in counts if None not in c]
    total, by_word, by_url = sum(c[2] for c in kept), Counter(), Counter()
    for w, u, n in kept:
        by_word[w] += n
        by_url[u] += n

    def llr(k, n, big_k):
        cells = [(k, n, big_k), (n - k, n, total - big_k), (big_k - k, total - n, big_k), (total - n - big_k + k, total - n, total - big_k)]
        g = 2 * sum(x * math.log(x * total / (r * c)) for x, r, c in cells if x)
        return g if k * (total - n) >= (big_k - k) * n else -g

    got = {(r.word, r.url): r.score for r in distinctive.term_scores(spark.createDataFrame(counts, "word string, url string, n int")).collect()}
    assert got == pytest.approx({(w, u): llr(n, by_url[u], by_word[w]) for w, u, n in kept})


def test_ties_take_the_rarer_then_the_first_word(spark):
    scores = spark.createDataFrame([("b", "u", 1, 3, 5.0), ("ab", "u", 1, 3, 5.0), ("a", "u", 1, 3, 5.0), ("z", "u", 1, 9, 5.0), ("only", "u", 1, 1, 99.0), ("neg", "v", 1, 2, -1.0)], "word string, url string, n int, df long, score double")
    assert [tuple(r) for r in distinctive.most_distinctive(scores).collect()] == [("a", "u")]


def test_segment_limit_is_reached(spark):
    sized = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, n_tokens long, n_loss long")
    report = packing.container_report(packing.fill_containers(sized)).collect()
    assert max(r.n_segments for r in report) == packing.SEGMENTS and sum(r.n_segments for r in report) == 200
