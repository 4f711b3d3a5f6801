"""Text of HTML pages within the engine, by patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def html_text_sql(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, each replaced by a blank; character references stay. For full parsing see ``urls.html_text``."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^<>]*>", " ")
