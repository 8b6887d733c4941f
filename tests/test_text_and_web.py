"""Tokens, stems, URLs, pages and robots."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text, web
from weftline.functions.hashing import letter_key
from weftline.functions.robots import allowed, delay, parse_robots
from weftline.functions.stem import stem
from weftline.plans.crawl import blacklisted, canonical_copies, check_seed, crawl, one_per_host, page_links

#: Pairs of the published examples.
STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat rational ration
digitizer digit vietnamization vietnam operator oper decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formalize formal
electrical electr goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt communism commun
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("word,expected", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, expected):
    assert stem(word) == expected


def test_tokens(spark):
    def of(t):
        words = spark.createDataFrame([(t,)], "t string").select(text.tokens("t").alias("w"))
        return [r.w for r in words.collect()][0]

    assert of("o'clock") == ["o", "clock"] and of("<b>x</b> y") == ["", "x", "y"]
    assert of(" dogs, cats") == ["", "dogs", "cats"] and of("") == [""] and of(None) is None
    words = ["a" * 50, "a" * 51, "é", "&", "ab-c", ""]
    valid = spark.createDataFrame([(w,) for w in words], "w string").where(text.is_valid("w"))
    assert [r.w for r in valid.collect()] == ["a" * 50, "&"]


def test_query_terms():
    assert text.query_terms("  The Cats and cats ", stemmed=True) == ["the", "cat"]
    assert text.query_terms("and") == ["and"] and text.query_terms(" ") == []


def column(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*names).alias("x")).first().x


@pytest.mark.parametrize(
    "base,ref,expected",
    [
        ("http://A.test/x/y.html", "z?q=1#f", "http://a.test/x/z?q=1"),
        ("http://a.test/x/y", "../z/./w/..", "http://a.test/z/"),
        ("http://a.test/x/y", "../../../z", "http://a.test/z"),
        ("https://a.test:443/x", "//B.test", "https://b.test/"),
        ("https://a.test:8443/x", "/p", "https://a.test:8443/p"),
        ("http://a.test/x?q", "?r", "http://a.test/x?r"),
        ("http://a.test/x#f", "#g", "http://a.test/x"),
        ("http://a.test/x", "mailto:x@y", None),
        ("http://a.test", "p", "http://a.test/p"),
        (None, "p", None),
        ("http://a.test/", None, None),
    ],
)
def test_resolve(spark, base, ref, expected):
    assert column(spark, web.resolve, base, ref) == expected


def test_normal_urls(spark):
    assert column(spark, lambda u: web.normal_url(u, True), "HTTP://A.test") == "http://a.test:80/"
    assert column(spark, web.canonical_url, "HTTPS://A.test:443/B#c") == "https://a.test/B"
    assert column(spark, web.is_page_url, "http://a.test/x.jpg") is False and column(spark, web.is_page_url, "http://a.test/x") is True
    assert column(spark, web.is_page_url, None) is False


@pytest.mark.parametrize("seed,expected", [("HTTP://a.test/x/../y", ("http://a.test:80/y", "")), ("ftp://a", (None, "scheme")), ("http://", (None, "host")), ("http://a/x.pdf", (None, "ending")), ("http://a:x", (None, "malformed"))])
def test_seeds(seed, expected):
    assert check_seed(seed) == expected


PAGE = """<html lang="en-GB"><head><title> A &amp; B </title><script>var x = "<a href='/no'>";</script></head>
<body><p>One <b>two</b></p><A HREF='/x'>three</A><a class=q href=y>four</a><noscript>off</noscript><!-- gone --></body></html>"""


def test_pages(spark):
    assert column(spark, web.visible_text, PAGE) == "A & B One two three four"
    assert column(spark, web.page_title, PAGE) == "A & B" and column(spark, web.html_lang, PAGE) == "en-gb"
    assert column(spark, web.hrefs, PAGE.replace("<script>", "<style>")) == ["/no", "/x", "y"]
    assert column(spark, web.hrefs, "<meta name='robots' content='noindex,NOFOLLOW'>" + PAGE) == [] == column(spark, web.hrefs, None)
    assert column(spark, lambda p, u: web.display_title(p, u), "<h2>T <i>x</i></h2>", "http://a.test/") == "T x"
    assert column(spark, lambda p, u: web.display_title(p, u), "", "http://A.test/") == "a.test"
    assert column(spark, web.passes_language, PAGE) is True and column(spark, web.passes_language, "<html lang=fr>") is False
    assert column(spark, web.word_count, "") == 1


def test_letter_key(spark):
    key = column(spark, letter_key, "http://a.test/")
    assert len(key) == 40 and key.isalpha() and key.islower()


ROBOTS = """# a file
User-agent: *
Disallow: /
User-agent: other
User-agent: Loom
Allow: /a
Disallow: /
Crawl-delay: x
Crawl-delay: 2
Crawl-delay: 3 # last wins
"""


def test_robots(spark):
    rules = parse_robots(ROBOTS, "loom")
    assert [r[0] for r in rules] == ["allow", "disallow", "crawl-delay", "crawl-delay"]
    assert parse_robots(ROBOTS, "unknown") == [("disallow", "/", None)] and parse_robots(None, "x") == []
    cases = [(rules, "/ab"), (rules, "/b"), (None, "/b"), ([("disallow", "", None)], "/b")]
    df = spark.createDataFrame(cases, "rules array<struct<kind:string,prefix:string,delay:double>>, path string")
    out = df.select(allowed(F.col("rules"), F.col("path")).alias("a"), delay(F.col("rules")).alias("d")).collect()
    assert [tuple(r) for r in out] == [(True, 3.0), (False, 3.0), (True, 1.0), (True, 1.0)]


def test_blacklist(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a/cart/x", "http://a.b/", "http://aXb/")], "u string")
    kept = urls.where(~blacklisted(F.col("u"), ["*/cart/*", "http://a.b/", "*/cart/*", None]))
    assert [r.u for r in kept.collect()] == ["http://aXb/"]
    assert urls.where(~blacklisted(F.col("u"), [])).count() == 3


def test_copies(spark, rows):
    pages = spark.createDataFrame([(2, "b", "same"), (1, "c", "same"), (1, "a", "same"), (3, "d", None), (4, "e", "")], "seq int, url string, text string")
    out = canonical_copies(pages, "text", "url", "seq").select("url", "canonical_url")
    assert rows(out) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", None), ("e", "e")]


def test_crawl_rounds(spark, rows):
    html = {"http://a.test/": "<a href='/1'>1</a><a href='/2'>2</a>", "http://a.test/1": "<a href='/'>0</a><a href='http://b.test/x'>x</a>", "http://a.test/2": "<a href='/3.pdf'>f</a>"}
    pages = spark.createDataFrame(list(html.items()), "url string, page string")
    seeds = spark.createDataFrame([("http://a.test/",)], "url string")
    got = rows(crawl(pages.select("url"), seeds, page_links(pages)))
    assert got == [("http://a.test/", 0, True), ("http://a.test/1", 1, True), ("http://a.test/2", 1, True), ("http://b.test/x", 2, False)]
    slow = {r.url: r.round for r in crawl(pages.select("url"), seeds, page_links(pages), polite=True).collect()}
    assert slow == {"http://a.test/": 0, "http://a.test/1": 1, "http://a.test/2": 2, "http://b.test/x": 2}
    rules = spark.createDataFrame([("a.test", [("disallow", "/2", None)])], "host string, rules array<struct<kind:string,prefix:string,delay:double>>")
    assert {r.url for r in crawl(pages.select("url"), seeds, page_links(pages), rules, ["http://b.*"]).collect()} == {"http://a.test/", "http://a.test/1"}
    assert rows(crawl(pages.select("url"), seeds.limit(0), page_links(pages))) == []
    assert rows(one_per_host(pages.select("url"))) == [("a.test", "http://a.test/")]
