"""Main body of web pages by consensus of their hosts; stuffed pages; languages.

One Arrow pass parses each page into blocks with their features (``digest``).
Per host, the pages vote for the generalised tag-class path of the container
that holds their prose; texts that recur over the whole crawl are furniture.
The winning paths are then joined back to the digest of every page.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import blocks
from weftline.llm.langid import LanguageModel, pieces_of, runs, sentences_of
from weftline.llm.words import LANGS, OTHER_SHARE, WORD, function_words, other_letters
from weftline.operators.skew import salted_join
from weftline.sources.tables import cut, release

#: Share of pages (by distinct url) from which a recurring short text is furniture, and the least number.
FURNITURE_SHARE, FURNITURE_LEAST = 0.0025, 3
#: Share of a host's pages from which a text that recurs there is furniture of that site.
SITE_SHARE = 0.25
#: Share of a host's votes that a path needs to win; at most 1 / share paths win.
WIN_SHARE = 0.1
#: Share of a host's pages from which a named area is part of the site's frame.
FRAME_SHARE = 0.3
#: Up to so many bytes the hosts' paths and keys are broadcast; beyond, they are joined with salts.
BROADCAST_BYTES = 32 << 20
#: A container holds a page's prose if it has this share of it.
PROSE_SHARE = 0.8
#: Pieces of texts up to this length are kept, as most recur within a site.
SHORT_CHARS = 80

#: Of a block: words, function words and their language, letters of no known language; per cent of link text, count of
#: its top word, top pair of words and separators, times its text stands in the page; hashes of a short line's words.
_FIELDS = "no:int,path:string,top:int,n:int,f:int,l:int,o:int,lk:int,tw:int,bg:int,sp:int,rp:int,key:bigint,prefix:bigint,w:array<int>,s:array<int>"
#: ``runs``: words, language (-1 for none) and mean probabilities of each run of pieces of one language.
BLOCK = f"struct<{_FIELDS},runs:array<struct<n:int,lang:int,p:array<float>>>>"
SCHEMA = f"fetch_id bigint, host string, url string, n_out int, label string, best string, prose bigint, b array<{BLOCK}>"

#: Columns with the distinct keys and prefixes of a page.
_LISTS = {"key": "keys", "prefix": "prefixes"}

#: Words of a block from which its top word, its top pair and its separators are judged, and lines that count as repeated.
TOP_LEAST, PAIR_LEAST, SEPARATOR_LEAST, REPEATS = 12, 20, 6, 3
#: Thresholds of a language with too few blocks, also those of the votes: share of function words, top word, top pair, separators, link text.
DEFAULTS = (0.14, 0.2, 0.15, 0.6, 0.85)
#: How a language's thresholds come from the shares in its sentences: quantile, factor and bounds of each.
CALIBRATION = ((0.5, 0.4, 0.05, 0.3), (0.9, 2.5, 0.12, 0.3), (0.9, 2.5, 0.1, 0.25), (0.95, 4.0, 0.4, 0.6), (0.95, 4.0, 0.6, 0.85))
#: A page with fewer words of its own than so many per packed out-link is dense with links: there, a block of
#: half link text counts as bare links.
DENSE_WORDS, DENSE_SHARE = 5, 50
#: Blocks of a language from which its own thresholds hold.
CALIBRATION_LEAST = 50
_DIGITS = re.compile(r"\d+")
_ORDINAL = re.compile(r"([-_])\d+(?=\.|>|$)")
_ENDED = re.compile(r"[.!?…。！？][\"'»”’)\]」]*$")
_SEPARATOR = re.compile(r"[|/#;,•·»]|\s[-–]\s")
_PREFIX = re.compile(r"(\S+(?: \S+){1,3}?) ?:(?!//)\s")
_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Three-letter codes of the languages.
_CODES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it"}


@lru_cache(4096)
def _site(host: str) -> re.Pattern[str] | None:
    """Matches the site's name as its host spells it, with blanks or hyphens between any letters."""
    labels = host.lower().split(":")[0].split(".")[:-1]
    name = re.sub(r"[^a-z0-9]", "", labels[-1]) if labels else ""
    name = name.rstrip("0123456789") or name
    return re.compile(r"[\s\-]?".join(map(re.escape, name)), re.I) if len(name) > 3 else None


def label(page: str) -> str:
    """Language of the lang attribute of <html>: its first part in lower case as two letters if known; '' if none."""
    m = _LANG.search(page[:5000]) or _LANG.search(page)
    if not m:
        return ""
    value = re.split(r"[-_]", (m.group(1) or m.group(2) or m.group(3) or "").strip().lower())[0]
    return _CODES.get(value, value)


def _body_path(path: str) -> str:
    """The path from below <body>, ordinals of class names generalised."""
    at = path.find(">body")
    if at >= 0:
        end = path.find(">", at + 1)
        path = path[end:] if end >= 0 else ""
    return _ORDINAL.sub(r"\1#", path)


_short_pieces = lru_cache(1 << 14)(pieces_of)


def _hash(text: str) -> int:
    """64 bits of a text, as a signed number."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _keys(text: str, host: str, linked: bool) -> tuple[int | None, int | None]:
    """Keys of a text and of its prefix, the site's name and numbers masked; none for texts of one or two words."""
    site = _site(host)
    short = site.sub("§", text) if site else text
    key = prefix = None
    if short.count(" ") >= 2:
        # Link text has keys of its own: lists of links repeat the headings of other pages.
        key = _hash(("\0" if linked else "") + _DIGITS.sub("0", short))
    if m := _PREFIX.match(short):
        prefix = _hash(m.group(1).lower())
    return key, prefix


_short_keys = lru_cache(1 << 15)(_keys)


def _counts(text: str) -> tuple[int, int, int, int, int, int, int, int, list[int] | None]:
    """Of a block's text: n, f, l, o, tw, bg, sp as in _FIELDS, visible characters, and w."""
    lower = text.lower()
    words = WORD.findall(lower)
    n = len(words)
    f, lang = function_words(words)
    other = other_letters(lower)
    top = pair = 0
    line = None
    if n >= TOP_LEAST:
        content = Counter(w for w in words if len(w) > 3)
        top = max(content.values()) if content else 0
        if n >= PAIR_LEAST:
            pair = max(Counter(zip(words, words[1:])).values())
    elif n:
        line = [zlib.crc32(w.encode()) - (1 << 31) for w in words if len(w) > 3]
    separators = len(_SEPARATOR.findall(text)) if n >= SEPARATOR_LEAST else 0
    return n, f, lang, other, top, pair, separators, len(text.replace(" ", "")), line


_short_counts = lru_cache(1 << 15)(_counts)


def features(page: str, host: str | None, stretches: bool = False, languages: bool = True) -> tuple[list[tuple], str | None, int, list[list[list[str]]]]:
    """Blocks as tuples in the order of BLOCK (without s, runs), voted path, prose size, sentences (or all pieces) by block if ``languages``."""
    found = blocks(page)
    times = Counter(b.text for b in found)
    times_path = Counter(b.path for b in found)
    direct = Counter(path for path, _ in {(b.path, b.node) for b in found})
    host = host or ""
    rows, sentences = [], []
    prose: dict[str, int] = defaultdict(int)
    paths: dict[str, str] = {}
    total = top = 0
    last_area = None
    least_f, top_share, pair_share, separator_share, link_share = DEFAULTS
    for no, b in enumerate(found):
        text = b.text
        path = paths.get(b.path)
        if path is None:
            path = paths[b.path] = _body_path(b.path)
        # Blocks of one top-level container follow each other; a class-less one ends where its path's first part or run ends.
        area = path.split(">", 2)[1] if path else ""
        if area != last_area or (b.node != b_node and path.count(">") <= 1):
            top += 1
            last_area = area
        b_node = b.node
        n, f, lang, other, tw, bg, sp, chars, line = (_short_counts if len(text) <= SHORT_CHARS else _counts)(text)
        share = 100 * b.linked // max(1, chars) if b.links else 0
        linked = share >= 100 * link_share
        separated = n >= SEPARATOR_LEAST and sp >= separator_share * n
        key, prefix = (_short_keys if len(text) <= SHORT_CHARS else _keys)(text, host, linked)
        natural = n >= 8 and f >= 0.12 * n or other >= OTHER_SHARE * chars and chars >= 40 and _ENDED.search(text) is not None
        if natural and not (linked or separated or times[text] >= REPEATS or tw > 2 and tw >= top_share * n or n >= PAIR_LEAST and bg >= pair_share * n):
            total += chars
            # An element that holds one block, or of which there are several, is a paragraph and no container.
            at = path if direct[b.path] == 1 and times_path[b.path] > 1 else path[: path.rfind(">")]
            while at:
                prose[at] += chars
                at = at[: at.rfind(">")]
        rows.append((no, path, top, n, f, lang, other, share, tw, bg, sp, times[text], key, prefix, line))
        if not languages:
            continue
        if stretches:
            sentences.append(_short_pieces(text) if len(text) <= SHORT_CHARS else pieces_of(text))
            continue
        sentences.append([] if linked or separated or n < 3 else sentences_of(text))
    best = max((p for p, c in prose.items() if c >= PROSE_SHARE * total), key=lambda p: (p.count(">"), prose[p]), default=None)
    return rows, best, total, sentences


def _run_lists(model: LanguageModel, pieces: list[list[str]], counts: list[int]) -> pa.ListArray:
    """Runs of every block; ``counts``: pieces of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    of, n, lang, p = runs(model.probabilities(pieces), owner, sizes, model.least)
    k = len(LANGS)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * k, pa.int32()), pa.array(p.astype(np.float32).ravel()))
    items = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(lang, pa.int32()), lists], ["n", "lang", "p"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(counts) + 1)), pa.int32()), items)


def _digest(model: LanguageModel | None, stretches: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(":")[0] for x in _FIELDS.split(",")] + ["runs"]
        types = [pa.int32(), pa.string(), *[pa.int32()] * 10, pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, hosts, urls = part.column(0), part.column(1), part.column(2)
                labels, bests, sizes, proses, flat = [], [], [0], [], []
                sentences: list[list[str]] = []
                counts: list[int] = []
                for page, host in zip(part.column(4).to_pylist(), hosts.to_pylist()):
                    rows, best, prose, found = features(page, host, stretches, model is not None)
                    labels.append(label(page))
                    bests.append(best)
                    proses.append(prose)
                    flat += rows
                    sizes.append(sizes[-1] + len(rows))
                    if model:
                        for xs in found:
                            counts.append(len(xs))
                            sentences += xs
                k = len(LANGS)
                if model and not stretches:
                    p = model.probabilities(sentences)
                    most, sure = (p.argmax(1), p.max(1)) if len(p) else (np.zeros(0, int), np.zeros(0))
                    owner = np.repeat(np.arange(len(flat)), counts) if flat else np.zeros(0, int)
                    kept = sure >= model.least
                    per = np.zeros((len(flat), k), np.int32)
                    np.add.at(per, (owner[kept], most[kept]), 1)
                    s = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * k, pa.int32()), pa.array(per.ravel()))
                else:
                    s = pa.nulls(len(flat), pa.list_(pa.int32()))
                run_type = pa.list_(pa.struct([("n", pa.int32()), ("lang", pa.int32()), ("p", pa.list_(pa.float32()))]))
                of_blocks = _run_lists(model, sentences, counts) if model and stretches else pa.nulls(len(flat), run_type)
                columns = list(zip(*flat)) if flat else [()] * len(types)
                arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [s, of_blocks]
                b = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(arrays, names))
                yield pa.record_batch(
                    [ids, hosts, urls, part.column(3), pa.array(labels, pa.string()), pa.array(bests, pa.string()), pa.array(proses, pa.int64()), b],
                    names=["fetch_id", "host", "url", "n_out", "label", "best", "prose", "b"],
                )

    return run


def digest(crawl: DataFrame, model: LanguageModel | None = None, stretches: bool = False) -> DataFrame:
    """Blocks and features of every row with a page, written once to the shared folder."""
    pages = crawl.where("page is not null").select("fetch_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("n_out", F.lit(0)).cast("int").alias("n_out"), "page")
    parsed = pages.mapInArrow(_digest(model, stretches), SCHEMA)
    # Columns of their own, as a scan cannot read one field of the blocks alone.
    distinct = lambda field: F.array_distinct(F.filter(F.transform("b", lambda x: x[field]), lambda k: k.isNotNull())).alias(_LISTS[field])
    areas = F.array_distinct(F.transform("b", lambda x: F.get(F.split(x["path"], ">"), F.lit(1)))).alias("areas")
    return cut(parsed.select("*", distinct("key"), distinct("prefix"), areas))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, n_pages, winners, frame): winning paths in order of votes, and areas of the site's frame.

    Votes are weighted by the prose they hold and summed before the shuffle;
    only paths with WIN_SHARE of a host's votes are gathered, at most ten.
    """
    votes = cut(pages.where("prose > 0").groupBy("host", "best").agg(F.sum("prose").alias("votes")))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"), F.count("*").alias("__n"))
    won = salted_join(votes, totals, ["host"], "__n", votes.count(), F.col("best")).where(F.col("votes") >= WIN_SHARE * F.col("all_votes"))
    # Negated votes sort the most voted first, equal votes by path.
    winners = won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "best"))), lambda x: x["best"]).alias("winners"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    named = pages.select("host", F.explode(F.filter("areas", lambda a: a.contains(".") | a.isin("nav", "footer", "header", "aside"))).alias("area"))
    areas_ = cut(named.groupBy("host", "area").agg(F.count("*").alias("c")))
    per_host = areas_.groupBy("host").agg(F.count("*").alias("__n")).join(sizes, "host")
    # On hosts of one or two pages any class recurs, so only the elements that name themselves count there.
    often = salted_join(areas_, per_host, ["host"], "__n", areas_.count(), F.col("area")).where((F.col("c") >= FRAME_SHARE * F.col("n_pages")) & ((F.col("n_pages") > 2) | ~F.col("area").contains(".")))
    frame = often.groupBy("host").agg(F.collect_set("area").alias("frame"))
    return sizes.join(winners, "host", "left").join(frame, "host", "left")


def furniture(pages: DataFrame, field: str, n_pages: int) -> list[int]:
    """Keys of texts that recur on FURNITURE_SHARE of all pages: at most (keys a page) / share of them."""
    least = max(FURNITURE_LEAST, FURNITURE_SHARE * n_pages)
    keys = pages.select("url", F.explode(_LISTS[field]).alias("key"))
    return [r["key"] for r in keys.distinct().groupBy("key").count().where(F.col("count") >= least).select("key").collect()]


def site_furniture(pages: DataFrame) -> DataFrame:
    """(host, site_keys): keys of texts on SITE_SHARE of the host's pages, at most (keys a page) / share of them.

    Occurrences are counted by distinct page text and by distinct url, the lower
    count holds: copies of a page and new fetches of it are no recurrence.
    """
    keyed = pages.select("host", "url", "keys").withColumn("text", F.xxhash64("keys"))
    sizes = keyed.groupBy("host").agg(F.countDistinct("url").alias("urls"))
    rows = keyed.select("host", F.explode("keys").alias("key"), "url", "text")
    by = [rows.select("host", "key", x).distinct().groupBy("host", "key").agg(F.count("*").alias(f"n_{x}")) for x in ("url", "text")]
    often = by[0].where(F.col("n_url") >= FURNITURE_LEAST).join(by[1].where(F.col("n_text") >= FURNITURE_LEAST), ["host", "key"]).join(sizes, "host")
    often = often.where(F.least("n_url", "n_text") >= SITE_SHARE * F.col("urls"))
    return often.groupBy("host").agg(F.collect_set("key").alias("site_keys"))


def own_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` with ``own``: the blocks of each page's body, found by its host's winning paths, without furniture.

    A page that has none of its host's winning paths keeps its top-level
    container with most words that is not part of the site's frame.
    """
    n_pages = pages.count()
    keys, prefixes = furniture(pages, "key", n_pages), furniture(pages, "prefix", n_pages)
    hosts = cut(host_paths(pages).join(site_furniture(pages), "host", "left"))
    texts = F.coalesce(F.length(F.array_join(F.concat(F.coalesce("winners", F.array().cast("array<string>")), F.coalesce("frame", F.array().cast("array<string>"))), " ")), F.lit(0))
    n_bytes = hosts.agg(F.sum(F.length("host") + 4 * texts + 8 * F.coalesce(F.size("site_keys"), F.lit(0)) + 64)).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:
        joined = pages.drop("keys", "prefixes", "areas").join(F.broadcast(hosts), "host", "left")
    else:
        joined = salted_join(pages.drop("keys", "prefixes", "areas"), hosts, ["host"], "n_pages", n_pages, F.col("fetch_id"), "left")

    def under(path: Column, winner: Column) -> Column:
        return (path == winner) | path.startswith(F.concat(winner, F.lit(">")))

    def first(paths: Column) -> Column:
        return F.get(F.filter(paths, lambda w: F.exists("b", lambda x: under(x["path"], w))), F.lit(0))

    frame = F.coalesce("frame", F.array().cast("array<string>"))
    loose = F.filter("b", lambda x: ~F.array_contains(F.col("__frame"), F.coalesce(F.get(F.split(x["path"], ">"), F.lit(1)), F.lit(""))))
    sizes = F.transform(
        F.array_distinct(F.transform("__loose", lambda x: x["top"])),
        lambda t: F.struct(F.aggregate(F.filter("__loose", lambda x: x["top"] == t), F.lit(0), lambda a, x: a + x["n"]).alias("n"), (-t).alias("t")),
    )

    def site_text(x: Column) -> Column:
        here = F.coalesce(F.array_contains(F.col("site_keys"), x["key"]), F.lit(False))
        return here | F.coalesce(x["key"].isin(*keys) if keys else F.lit(False), F.lit(False)) | F.coalesce(x["prefix"].isin(*prefixes) if prefixes else F.lit(False), F.lit(False))

    body = F.when(F.col("__win").isNotNull(), F.filter("b", lambda x: under(x["path"], F.col("__win")))).otherwise(F.filter("__loose", lambda x: x["top"] == -F.col("__top")))
    return (
        joined.withColumn("__win", first(F.col("winners")))
        .withColumn("__frame", frame)
        .withColumn("__loose", F.when(F.col("__win").isNull(), loose))
        .withColumn("__top", F.array_max(sizes)["t"])
        .withColumn("own", F.filter(F.coalesce(body, F.array().cast(f"array<{BLOCK}>")), lambda x: ~site_text(x)))
        .select("fetch_id", "url", "n_out", "label", "own")
    )


def calibrate(own: DataFrame) -> list[tuple[float, ...]]:
    """Per language, then for no language, the thresholds in the order of DEFAULTS.

    Each comes from a quantile of the share in the language's blocks of
    sentences (8 words or more, a tenth of them function words), as CALIBRATION
    says; five rows of quantiles come to the driver.
    """
    blocks_ = own.select(F.explode(F.filter("own", lambda x: (x["n"] >= 8) & (x["f"] >= 0.1 * x["n"]))).alias("x")).select("x.*")
    judged = [F.col("f"), F.when(F.col("n") >= TOP_LEAST, F.col("tw")), F.when(F.col("n") >= PAIR_LEAST, F.col("bg")), F.col("sp"), F.col("lk") * F.col("n") / 100]
    quantiles = [F.percentile_approx(c / F.col("n"), q, 1000).alias(f"q{i}") for i, (c, (q, *_)) in enumerate(zip(judged, CALIBRATION))]
    found = {r["l"]: r for r in blocks_.groupBy("l").agg(F.count("*").alias("n"), *quantiles).collect()}
    out = []
    for i in range(len(LANGS)):
        r = found.get(i)
        if r is None or r["n"] < CALIBRATION_LEAST:
            out.append(DEFAULTS)
            continue
        values = [r[f"q{k}"] for k in range(len(DEFAULTS))]
        out.append(tuple(d if v is None else min(high, max(low, factor * v)) for d, v, (_, factor, low, high) in zip(DEFAULTS, values, CALIBRATION)))
    return [*out, DEFAULTS]


def stuffed_share(own: Column, n_out: Column, thresholds: list[tuple[float, ...]]) -> Column:
    """Share of the words of a body that stand in blocks of keywords, bare links or tags; 0 for an empty body.

    ``n_out``: packed out-links of the page.  A text in none of the known languages is not judged by its function words.
    Lines under TOP_LEAST words are also judged together, by their top word.
    """
    total = lambda xs, c: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    words = total(own, "n")
    dense = words < DENSE_WORDS * n_out
    other = total(own, "o") >= OTHER_SHARE * 4 * words

    def least(i: int, x: Column) -> Column:
        return F.get(F.array(*[F.lit(float(t[i])) for t in thresholds]), F.when(x["l"] < 0, len(LANGS)).otherwise(x["l"]))

    def bad(x: Column) -> Column:
        n = x["n"]
        return (
            (~other & ((x["l"] < 0) | (x["f"] < least(0, x) * n)))
            | ((n >= TOP_LEAST) & (x["tw"] > 2) & (x["tw"] >= least(1, x) * n))
            | ((n >= PAIR_LEAST) & (x["bg"] >= least(2, x) * n))
            | ((n >= SEPARATOR_LEAST) & (x["sp"] >= least(3, x) * n))
            | (x["lk"] >= F.when(dense, DENSE_SHARE).otherwise(least(4, x) * 100))
            | (x["rp"] >= REPEATS)
        )

    lines = F.filter(own, lambda x: (x["n"] < TOP_LEAST) & ~bad(x))
    n_lines = total(lines, "n")
    # The longest run of equal hashes in order.
    hashes = F.array_sort(F.flatten(F.transform(lines, lambda x: F.coalesce(x["w"], F.array().cast("array<int>")))))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, h: Column) -> Column:
        run = F.when(acc["last"] == h, acc["run"] + 1).otherwise(1)
        return F.struct(h.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate(hashes, start, step, lambda acc: acc["most"])
    # The strictest of the languages: short lines have none of their own.
    together = F.when((n_lines >= PAIR_LEAST) & (most > REPEATS) & (most >= max(t[1] for t in thresholds) * n_lines), n_lines).otherwise(F.lit(0))
    stuffed = total(F.filter(own, bad), "n") + together
    return F.when(words > 0, stuffed / words).otherwise(F.lit(0.0))


def bodies(crawl: DataFrame, model: LanguageModel | None = None, stretches: bool = False) -> DataFrame:
    """(fetch_id, url, n_out, label, own, stuffed) of every row of ``crawl`` that has a page.

    ``crawl``: fetch_id, host, url, n_out (out-links), page.  Null hosts and urls count as empty,
    a page without text has an empty body; repeated rows stay.  With a model
    blocks have counts of sentences, or with ``stretches`` runs in their place.
    """
    parsed = digest(crawl, model, stretches)
    own = cut(own_blocks(parsed))
    release(parsed)
    return own.withColumn("stuffed", stuffed_share(F.col("own"), F.col("n_out"), calibrate(own)))
