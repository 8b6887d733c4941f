"""Jobs by name, and fetching with a given fetcher."""

import pytest

from weftline import jobs
from weftline.plans.crawl import robots_rules
from weftline.sources.fetch import fetch, redirects, robots_texts


def site(url):
    """A fetcher without a network."""
    if url.endswith("/slow"):
        raise TimeoutError
    if url.endswith("/down"):
        raise ConnectionRefusedError
    replies = {"/": (200, "text/html; charset=utf-8", None, "<p>é".encode()), "/old": (301, None, "/", b""), "/pdf": (200, "application/pdf", None, b"%"), "/robots.txt": (200, "text/plain", None, b"User-agent: *\nDisallow: /x")}
    return replies.get("/" + url.split("/", 3)[3], (404, "text/html", None, b""))


def test_outcomes(spark, rows):
    urls = ["http://a.test/", "http://a.test/old", "http://a.test/pdf", "http://a.test/none", "http://a.test/slow", "http://a.test/down", "ftp://a", None]
    out = fetch(spark.createDataFrame([(u,) for u in urls], "url string"), site)
    assert rows(out.select("url", "outcome", "response_code", "page")) == sorted(
        [
            ("http://a.test/", "page", 200, "<p>é"),
            ("http://a.test/old", "redirect", 301, None),
            ("http://a.test/pdf", "other", 200, None),
            ("http://a.test/none", "other", 404, None),
            ("http://a.test/slow", "timeout", None, None),
            ("http://a.test/down", "error", None, None),
            ("ftp://a", "malformed", None, None),
            (None, "malformed", None, None),
        ],
        key=repr,
    )
    assert rows(redirects(out)) == [("http://a.test/old", "http://a.test/")]


def test_robots_of_hosts(spark):
    texts = robots_texts(spark.createDataFrame([("a.test",)], "host string"), site)
    assert [(r.host, [tuple(x) for x in r.rules]) for r in robots_rules(texts, "x").collect()] == [("a.test", [("disallow", "/x", None)])]


def test_jobs(spark, tmp_path):
    spark.createDataFrame([("A",), ("B",)], "id string").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([("A", "B"), ("B", "A")], "src string, dst string").write.parquet(str(tmp_path / "l"))
    assert jobs.run(spark, "page_rank", [str(tmp_path / x) for x in "nlo"]) == "1 steps, 100.00 % settled\n"
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    spark.createDataFrame([(1, "red house"), (2, "blue house")], "id int, t string").write.parquet(str(tmp_path / "d"))
    assert jobs.run(spark, "query", [str(tmp_path / "d"), "id", "t", "red"]).startswith("1\t")
    with pytest.raises(KeyError):
        jobs.run(spark, "unknown")


def test_sets_of_a_context(spark):
    context = jobs.Context(spark)
    context.output("a")
    context.output("b")
    assert context.report == "ab" and context.parallelize(["x"]).collect() == ["x"]
