"""Fetching urls with a pluggable fetcher; the one given uses the network, others read from elsewhere."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.web import resolve

#: Codes of redirects, and the outcomes of a fetch.
REDIRECTS = (301, 302, 303, 307, 308)
OUTCOMES = ("page", "redirect", "other", "malformed", "timeout", "error")
#: Seconds to wait, and the name that the fetcher gives.
TIMEOUT, AGENT = 3.0, "weftline"

#: A fetcher: url -> (code, content type, location, body); it raises ValueError, TimeoutError or OSError.
Fetcher = Callable[[str], tuple[int, str | None, str | None, bytes]]

SCHEMA = "url string, outcome string, response_code int, content_type string, location string, page string"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def over_network(url: str) -> tuple[int, str | None, str | None, bytes]:
    """GET without following redirects."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        reply = urllib.request.build_opener(_Stay).open(request, timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        reply = e
    with reply:
        return reply.status, reply.headers.get("Content-Type"), reply.headers.get("Location"), reply.read()


def outcome(url: str | None, fetcher: Fetcher) -> tuple[str, int | None, str | None, str | None, str | None]:
    """(one of OUTCOMES, code, content type, location, page) of a url; only HTML of code 200 is a page."""
    try:
        if not url or urlsplit(url).scheme.lower() not in ("http", "https") or not urlsplit(url).hostname:
            return "malformed", None, None, None, None
        code, kind, location, body = fetcher(url)
    except TimeoutError:
        return "timeout", None, None, None, None
    except ValueError:
        return "malformed", None, None, None, None
    except OSError as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return "timeout" if late else "error", None, None, None, None
    if code == 200 and (kind or "").lower().startswith("text/html"):
        return "page", code, kind, None, body.decode("utf-8", "replace")
    if code in REDIRECTS:
        return "redirect", code, kind, location, None
    return "other", code, kind, None, None


def fetch(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """One row (SCHEMA) per row of ``urls`` (url), fetched by the partitions in parallel.

    No fetcher is used unless one is given: pass ``over_network`` to use the network.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [outcome(u, fetcher) for u in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return urls.select(F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


def redirects(fetched: DataFrame) -> DataFrame:
    """(src, dst): where redirects lead, in normal form; those that lead to no http(s) URL are left out."""
    rows = fetched.where("outcome = 'redirect'")
    return rows.select(F.col("url").alias("src"), resolve("url", "location").alias("dst")).where("dst is not null")


def robots_texts(hosts: DataFrame, fetcher: Fetcher, scheme: str = "https") -> DataFrame:
    """(host, text) of every host's robots.txt, '' where there is none."""

    def any_type(url: str) -> tuple[int, str | None, str | None, bytes]:
        code, _, location, body = fetcher(url)
        return code, "text/html", location, body

    address = F.concat(F.lit(f"{scheme}://"), "host", F.lit("/robots.txt"))
    got = fetch(hosts.select(address.alias("url")), any_type)
    return got.select(F.regexp_extract("url", r"^[a-z]+://(.*)/robots\.txt$", 1).alias("host"), F.coalesce("page", F.lit("")).alias("text"))
