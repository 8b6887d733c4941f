"""Golden cases of the index, the ranks and the search."""

import pytest

from weftline.plans import index, rank, search


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("u1", "Cats chase mice.", "Cats"), ("u2", " dogs, cats", ""), ("u3", None, None), ("u4", "single", "x")]
    return spark.createDataFrame(rows, "url string, text string, title string")


def test_weights(docs):
    for weights in (index.tf(index.postings(docs, "url", title="title"), "url"), index.term_weights(docs, "url", title="title")):
        got = {(r.word, r.url): round(r.tf, 6) for r in weights.collect()}
        # u2 has a leading blank, so its words stand at 1 and 2 of 3.
        assert got == {("cats", "u1"): 12.4, ("chase", "u1"): 12.052174, ("mice", "u1"): 12.027907, ("dogs", "u2"): 0.452174, ("cats", "u2"): 0.427907}
        assert {r.word: round(r.idf, 6) for r in index.idf(weights, 3).collect()} == {"cats": 0.405465, "chase": 1.098612, "mice": 1.098612, "dogs": 1.098612}


def test_title_boost(spark):
    titles = spark.createDataFrame([("Big Red",), ("",), (" ",), ("One",), ("One ",)], "t string")
    assert [round(r.b, 6) for r in titles.select(index.title_boost("t").alias("b")).collect()] == [0.436364, 0.4, 0.0, 12.0, 0.4]


def test_stemmed_postings(docs):
    got = {(r.word, r.url): list(r.positions) for r in index.postings(docs, "url", stemmed=True).collect()}
    assert got[("cat", "u1")] == [0] and got[("cats", "u1")] == [0] and got[("chase", "u1")] == [1] and got[("chase", "u1")] == got[("chase", "u1")]


def test_packed(docs):
    packed = {r.word: r.accumulated_value for r in index.pack(index.postings(docs, "url", title="title"), "url").collect()}
    assert packed["cats"] == "u1:3:0:Q2F0cw==,u2:3:2:"


def test_search(spark, docs):
    found = search.search(docs, "url", "Cats", title="title", n_docs=3).collect()
    assert [(r.url, round(r.score, 6)) for r in found] == [("u1", 5.027767), ("u2", 0.173501)]
    ranks = spark.createDataFrame([("u2", 2.0)], "url string, rank double")
    ranked = search.search(docs, "url", "cats", title="title", n_docs=3, ranks=ranks).collect()
    assert [(r.url, round(r.score, 6), r.tfs) for r in ranked][0][:2] == ("u2", 0.347003) and ranked[1].score == 0
    assert search.search(docs, "url", "unknown", title="title").collect() == [] == search.search(docs, "url", "  ").collect()


LINKS = [("A", "B"), ("A", "B"), ("A", "X"), ("B", "C")]


def test_ranks(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDAA"] + [(None,)], "id string")
    links = spark.createDataFrame([*LINKS, (None, "A"), ("A", None)], "src string, dst string")
    golden = {1: {"A": 0.15, "B": 0.716667, "C": 1.0}, 2: {"A": 0.15, "B": 0.235, "C": 0.759167}, 3: {"A": 0.15, "B": 0.235, "C": 0.34975}}
    for steps, expected in golden.items():
        assert {r.id: round(r.rank, 6) for r in rank.fixed_steps(nodes, links, steps).collect()} == expected
    done = rank.page_rank(nodes, links)
    assert (done.steps, done.settled, done.converged) == (4, 100.0, True)
    short = rank.page_rank(nodes, links, max_steps=3)
    assert (short.steps, round(short.settled, 2), short.converged) == (3, 66.67, False)


def test_ranks_of_an_empty_graph(spark):
    none = rank.page_rank(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string"))
    assert none.ranks.collect() == [] and none.converged


def test_rank_is_kept_on_a_ring(spark):
    n = 50
    nodes = spark.range(n).selectExpr("CAST(id AS STRING) AS id")
    links = spark.range(n).selectExpr("CAST(id AS STRING) AS src", f"CAST((id + 1) % {n} AS STRING) AS dst")
    ranks = rank.fixed_steps(nodes, links, 3)
    assert round(ranks.groupBy().sum("rank").first()[0], 6) == n
