"""Crawling over a table of pages: seeds, rounds, politeness, robots, blacklist and content copies.

There is no network here: a fetch is a join with a table of pages.  The rules
of a live crawl are applied per round as joins and expressions.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import url_key
from weftline.functions.robots import RULES, allowed, delay, parse_robots
from weftline.functions.web import NO_PAGES, PORTS, hrefs, is_page_url, normal_url, resolve, url_part
from weftline.operators.skew import salted_join
from weftline.sources.tables import cut, release

#: Patterns of a blacklist joined into one expression.
PATTERNS_AT_ONCE = 500
#: A blacklist is configuration: more patterns than these raise.
MOST_PATTERNS = 50_000


def check_seed(url: str) -> tuple[str | None, str]:
    """(the URL in normal form with its port, "") or (None, why it cannot be crawled)."""
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None, "malformed"
    scheme = parts.scheme.lower()
    if scheme not in PORTS:
        return None, "scheme"
    if not parts.hostname or port == 0:
        return None, "host"
    segments: list[str] = []
    for x in (parts.path or "/").split("/"):
        if x == "..":
            del segments[max(1, len(segments) - 1) :]
        elif x != ".":
            segments.append(x)
    path = "/".join(segments) or "/"
    if parts.path.endswith(("/.", "/..")) and not path.endswith("/"):
        path += "/"
    if path.rpartition(".")[2] in NO_PAGES and "." in path:
        return None, "ending"
    query = f"?{parts.query}" if parts.query else ""
    return f"{scheme}://{parts.hostname}:{port or PORTS[scheme]}{path}{query}", ""


def blacklisted(url: Column, patterns: list[str]) -> Column:
    """Whether a URL matches one of the patterns as a whole, * standing for anything.

    The patterns are joined into few expressions, so there is no join at all.
    """
    unique = sorted({p for p in patterns if p is not None})
    if len(unique) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns: {len(unique)}")
    if not unique:
        return F.lit(False)
    quoted = [".*".join(re.sub(r"([^A-Za-z0-9/ _-])", r"\\\1", part) for part in p.split("*")) for p in unique]
    parts = [url.rlike(r"(?s)\A(?:" + "|".join(quoted[i : i + PATTERNS_AT_ONCE]) + r")\z") for i in range(0, len(quoted), PATTERNS_AT_ONCE)]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def blacklist_patterns(blacklist: DataFrame) -> list[str]:
    """Distinct patterns of a blacklist table, one more than MOST_PATTERNS at most."""
    return [r["pattern"] for r in blacklist.where("pattern is not null").select("pattern").distinct().limit(MOST_PATTERNS + 1).collect()]


def robots_rules(texts: DataFrame, agent: str) -> DataFrame:
    """(host, rules) from (host, text) of robots.txt files."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("prefix", pa.string()), ("delay", pa.float64())]))
        for batch in batches:
            rules = [[dict(zip(("kind", "prefix", "delay"), r)) for r in parse_robots(t, agent)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rules, kind)], names=["host", "rules"])

    return texts.select("host", "text").mapInArrow(run, f"host string, rules {RULES}")


def robots_decisions(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """``urls`` (url) with ``allowed`` and ``delay`` by the rules of their host; hosts without rules allow all.

    ``robots``: host, rules, one row per host.  The join's side and the split of hot hosts are left to adaptive execution.
    """
    rules = robots.select(F.lower("host").alias("__host"), F.col("rules").alias("__rules"))
    joined = urls.withColumn("__host", url_part("url", "host")).join(rules, "__host", "left")
    path = F.concat(url_part("url", "path"), url_part("url", "query"))
    return joined.withColumn("allowed", allowed(F.col("__rules"), path)).withColumn("delay", delay(F.col("__rules"))).drop("__host", "__rules")


def canonical_copies(pages: DataFrame, content: str, url: str, order: str) -> DataFrame:
    """``pages`` with content_hash and canonical_url: of rows of equal content the url of the first by (order, url).

    The first rows and counts are combined before the shuffle, and joined back
    with salts on contents that many rows have.  Null contents have neither.
    """
    hashed = pages.withColumn("content_hash", url_key(content))
    first = hashed.where("content_hash is not null").groupBy("content_hash").agg(F.min_by(F.col(url), F.struct(F.col(order), F.col(url))).alias("canonical_url"), F.count("*").alias("__n"))
    first = cut(first)
    total = first.agg(F.sum("__n")).first()[0] or 0
    return salted_join(hashed, first, ["content_hash"], "__n", int(total), F.xxhash64(F.col(url), F.col(order)), "left").drop("__n")


def one_per_host(frontier: DataFrame) -> DataFrame:
    """(host, url): the first url of every host, the one that may be fetched in a round; combined before the shuffle."""
    return frontier.groupBy(url_part("url", "host").alias("host")).agg(F.min("url").alias("url"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the links of every page (url, page), resolved and in normal form; repeated links stay."""
    refs = pages.select(F.col("url").alias("base"), F.explode(hrefs("page")).alias("ref"))
    return refs.select(normal_url("base").alias("src"), resolve("base", "ref").alias("dst")).where("dst is not null")


def crawl(pages: DataFrame, seeds: DataFrame, links: DataFrame, robots: DataFrame | None = None, patterns: list[str] | None = None, polite: bool = False, max_rounds: int = 50) -> DataFrame:
    """(url, round, found): the pages reached from the seeds by breadth-first rounds.

    ``pages``: url (normal form, unique); ``seeds``: url; ``links``: src, dst.
    A round fetches the frontier (``polite``: one url per host, the rest waits),
    without what was fetched before, the blacklist or robots forbid.  ``found``
    tells whether ``pages`` has the url.  Each round's state is a written table.
    """

    def open_(urls: DataFrame) -> DataFrame:
        kept = urls.where(is_page_url("url"))
        if patterns:
            kept = kept.where(~blacklisted(F.col("url"), patterns))
        return robots_decisions(kept, robots).where("allowed").select("url") if robots is not None else kept.select("url")

    known = cut(pages.select("url").withColumn("found", F.lit(True)))
    edges = cut(links.select("src", "dst").distinct())
    frontier = cut(open_(seeds.select("url").distinct()))
    rounds: list[DataFrame] = []
    visited: DataFrame | None = None
    for n in range(max_rounds):
        if frontier.isEmpty():
            break
        now = one_per_host(frontier).select("url") if polite else frontier
        fetched = cut(now.join(known, "url", "left").select("url", F.lit(n).alias("round"), F.coalesce("found", F.lit(False)).alias("found")))
        rounds.append(fetched)
        visited = fetched.select("url") if visited is None else visited.unionByName(fetched.select("url"))
        found = fetched.where("found").join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        new = open_(found)
        if polite:
            new = new.unionByName(frontier).distinct()
        old, frontier = frontier, cut(new.join(visited, "url", "left_anti"))
        release(old)
    release(known, edges)
    if not rounds:
        return seeds.select("url", F.lit(0).alias("round"), F.lit(False).alias("found")).limit(0)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out
