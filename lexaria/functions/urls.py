"""Addresses: normalization, domain, depth, dynamic pages, links of a page."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Substrings that tell a dynamic page (fixed values).
DYNAMIC = ("?", "&", "=", ".php", ".asp", ".aspx", ".jsp", ".py", "/search", "/query", "/api/", "/ajax", "cgi-bin", "action=", "id=", "page=")


def normalized(href: str | None, base: str | None, keep_query: bool = False) -> str | None:
    """``href`` as an absolute http(s) address without fragment, and without parameters and query unless ``keep_query``; else NULL."""
    if href is None:
        return None
    try:
        p = urlsplit(urljoin(base or "", href))
    except ValueError:
        return None
    if p.scheme not in ("http", "https") or not p.netloc:
        return None
    path = p.path
    if not keep_query:
        head, slash, last = path.rpartition("/")
        path = head + slash + last.split(";", 1)[0]
    return urlunsplit((p.scheme, p.netloc, path, p.query if keep_query else "", ""))


def normalize_url(href: Column, base: Column, keep_query: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([normalized(x, y, keep_query) for x, y in zip(h, b)], dtype=object)

    return run(href, base)


def domain(url: Column) -> Column:
    """Network location with port and user."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def dir_depth(url: Column) -> Column:
    """Slashes in the path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_dynamic(url: Column) -> Column:
    low = F.lower(url)
    found = F.lit(False)
    for x in DYNAMIC:
        found = found | F.contains(low, F.lit(x))
    return found


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v is not None]

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def read_html(text: str | None) -> tuple[str | None, list[str]]:
    """Text of a page, its pieces joined by a blank, and the targets of its links in order."""
    if text is None:
        return None, []
    r = _Reader()
    r.feed(text)
    r.close()
    return " ".join(r.parts), r.links


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return pd.Series([read_html(x)[0] for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_links(s: pd.Series) -> pd.Series:
    return pd.Series([read_html(x)[1] for x in s], dtype=object)
