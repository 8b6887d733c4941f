"""URL and HTML column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: str | Column) -> Column:
    """A URL without fragment and default port, scheme and host in lower case; null stays null."""
    u = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(u, r"(?s)#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    port = F.regexp_replace(head, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.when(head == "", bare).otherwise(F.concat(port, rest))


#: Elements that are no visible text, path endings that are no pages, schemes with their ports.
HIDDEN = ("script", "style", "noscript", "iframe", "form", "button", "svg")
NO_PAGES = ("jpg", "jpeg", "gif", "png", "txt", "pdf", "epub", "chm", "css", "js", "svg")
PORTS = {"http": "80", "https": "443"}

HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
ROBOTS_META = r"""(?i)<meta\s[^>]*\bname\s*=\s*["']?robots\b[^>]*>"""
SPLIT_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
HIDDEN_ELEMENTS = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in HIDDEN) + "|<!--.*?-->"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANG = r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z0-9_\-]*)"""
BLANKS = r"[ \t\n\x0B\f\r]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hrefs(page: str | Column) -> Column:
    """The first href of every anchor, as written, in page order; none for null pages and pages that say nofollow."""
    p = F.coalesce(_col(page), F.lit(""))
    found = F.transform(F.regexp_extract_all(p, F.lit(HREF), F.lit(1)), lambda h: F.trim(F.translate(h, "\"'", "")))
    nofollow = F.exists(F.regexp_extract_all(p, F.lit(ROBOTS_META), F.lit(0)), lambda m: F.lower(m).contains("nofollow"))
    return F.when(nofollow, F.array().cast("array<string>")).otherwise(found)


def url_part(url: str | Column, part: str) -> Column:
    """scheme (lower case), authority, host (lower case), port, path or query (with its ?) of an absolute URL; '' where absent."""
    u = _col(url)
    if part in ("scheme", "authority", "path", "query"):
        out = F.regexp_extract(u, SPLIT_URL, ("scheme", "authority", "path", "query").index(part) + 1)
        return F.lower(out) if part == "scheme" else out
    authority = F.regexp_replace(url_part(u, "authority"), r"^[^@]*@", "")
    if part == "host":
        return F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    return F.regexp_extract(authority, r":([0-9]+)$", 1)


def without_dots(path: Column) -> Column:
    """A path without . and .. segments, by one fold over its segments."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(out: Column, s: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
        return F.when(s == "..", up).when(s == ".", out).otherwise(F.concat(out, F.array(s)))

    folded = F.array_join(F.aggregate(segments, none, step), "/")
    # A path that ends in a dot segment names a folder.
    folder = F.element_at(segments, -1).isin(".", "..") & ~folded.endswith("/")
    return F.when(~path.rlike(r"(^|/)\.\.?(/|$)"), path).when(folder, F.concat(folded, F.lit("/"))).otherwise(folded)


def normal_url(url: str | Column, with_port: bool = False) -> Column:
    """An absolute http(s) URL without fragment and dot segments, scheme and host in lower case, an empty path as /.

    The scheme's own port is left out, or always written ``with_port``.  Other
    schemes, relative references and null give null.
    """
    u = _col(url)
    scheme, port, path = url_part(u, "scheme"), url_part(u, "port"), url_part(u, "path")
    own = F.when(scheme == "http", PORTS["http"]).when(scheme == "https", PORTS["https"])
    shown = F.when(port == "", own if with_port else F.lit("")).when((port == own) & F.lit(not with_port), "").otherwise(port)
    host = url_part(u, "host")
    out = F.concat(scheme, F.lit("://"), host, F.when(shown == "", "").otherwise(F.concat(F.lit(":"), shown)), F.when(path == "", "/").otherwise(without_dots(path)), url_part(u, "query"))
    return F.when(own.isNotNull() & (host != ""), out)


def resolve(base: str | Column, ref: str | Column, with_port: bool = False) -> Column:
    """``ref`` as an absolute URL as seen from the page at ``base``; null where that is no http(s) URL."""
    b, r = _col(base), F.trim(_col(ref))
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = url_part(b, "path")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    full = (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
        .when(r.startswith("//"), F.concat(url_part(b, "scheme"), F.lit(":"), r))
        .when(r.startswith("/"), F.concat(origin, r))
        .when((r == "") | r.startswith("#"), b)
        .when(r.startswith("?"), F.concat(origin, path, r))
        .otherwise(F.concat(origin, folder, r))
    )
    return normal_url(full, with_port)


def is_page_url(url: str | Column) -> Column:
    """Whether a URL may be crawled: http or https, a host, and a path without one of the endings NO_PAGES."""
    u = _col(url)
    ending = F.regexp_extract(url_part(u, "path"), r"\.([A-Za-z]+)$", 1)
    return F.coalesce(url_part(u, "scheme").isin(*PORTS) & (url_part(u, "host") != "") & ~ending.isin(*NO_PAGES), F.lit(False))


def is_plain_url(url: str | Column) -> Column:
    """Whether a URL is of visible ASCII characters and blanks, not blank and without a comma."""
    return _col(url).rlike(r"\A[\x20-\x7E]+\z") & ~_col(url).contains(",") & (F.trim(_col(url)) != "")


def unescape(text: Column) -> Column:
    """The five predefined character references and &nbsp; decoded."""
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(by))
    return text


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def visible_text(page: str | Column) -> Column:
    """Text outside HIDDEN elements, comments and tags, white space collapsed; null for null pages."""
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(_col(page), HIDDEN_ELEMENTS, " "), r"<[^>]*>", " ")))


def page_title(page: str | Column) -> Column:
    """Text of the first <title>, '' without one."""
    return squeeze(unescape(F.regexp_extract(_col(page), TITLE, 1)))


def word_count(text: str | Column) -> Column:
    """Parts of a text between white space; 1 for an empty text."""
    return F.size(F.split(_col(text), BLANKS))


def html_lang(page: str | Column) -> Column:
    """The lang attribute of <html> in lower case, '' without one."""
    return F.lower(F.regexp_extract(_col(page), LANG, 1))


def passes_language(page: str | Column, lang: str = "en") -> Column:
    """Whether a page's lang attribute is absent or of the language ``lang``."""
    found = html_lang(page)
    return (found == "") | found.startswith(lang)


def display_title(page: str | Column, url: str | Column) -> Column:
    """The first that is not empty of <title>, the DC.title and og:title metas, <h1>, <h2> and the host."""
    p = _col(page)
    meta = lambda name: F.regexp_extract(p, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    heading = lambda tag: F.regexp_replace(F.regexp_extract(p, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]*>", " ")
    found = [page_title(p), *(squeeze(unescape(x)) for x in (meta(r"DC\.title"), meta("og:title"), heading("h1"), heading("h2")))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], url_part(url, "host"))
