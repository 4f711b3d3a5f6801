"""Queries on near-duplicate texts and addresses (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.near import BallScheme, all_links, connected_classes, near_duplicates, same_pages, short_members
from lexaria.session import table

#: The data's description asks for runs of three words and 0.6.
SCHEME, THRESHOLD = BallScheme(shingle=3), 0.6


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of near-duplicate texts and of addresses of one page."""
    texts = all_links(*near_duplicates(table(spark, d, "documento"), "doc_id", "texto", threshold=THRESHOLD, scheme=SCHEME))
    # a page's addresses are few; an id may have several keys, so a pair may meet more than once
    keys = same_pages(table(spark, d, "pagetask"), "id", "url").withColumn("key", F.md5("key"))
    urls = keys.alias("p").join(keys.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b")).distinct()
    return texts.select(F.lit("texto").alias("campo"), "id_a", "id_b").unionAll(urls.select(F.lit("url").alias("campo"), "id_a", "id_b"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every document; texts too short for a link are in a class with their copies."""
    docs = table(spark, d, "documento")
    members, pairs = near_duplicates(docs, "doc_id", "texto", threshold=THRESHOLD, scheme=SCHEME)
    return connected_classes(members.unionAll(short_members(docs, "doc_id", "texto", members, SCHEME.shingle)), pairs)


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    """The smallest id of the same page for every crawled address."""
    keys = same_pages(table(spark, d, "pagetask"), "id", "url")
    return keys.join(keys.groupBy("key").agg(F.min("id").alias("page_id")), "key").groupBy("id").agg(F.min("page_id").alias("page_id"))


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes, "p7_pages": p7_pages}

_SHINGLES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(texto), '[\p{L}\p{N}]+') AS w FROM documento WHERE texto IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
"""
_TEXT_LINKS = r"""
, t AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(na.n) + any_value(nb.n) - count(*)))
"""
_ADDRESSES = r"""
u0 AS (SELECT DISTINCT id, replace(replace(regexp_replace(url, '#.*$', ''), '%7E', '~'), '%7e', '~') AS url FROM pagetask WHERE url IS NOT NULL),
u1 AS (SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^\w+://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(url, '^\w+://[^/?]*([^?]*)', 1), '/((index|default)\.(html?|php|aspx))?$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(sid|PHPSESSID|ref|utm_[a-z]+)='))) AS q FROM u0)
"""
SQL = {
    "p7_found": _SHINGLES + _TEXT_LINKS + "," + _ADDRESSES + """
SELECT 'texto' AS campo, id_a, id_b FROM t
UNION ALL SELECT DISTINCT 'url', a.id, b.id FROM u1 a JOIN u1 b ON a.host = b.host AND a.path = b.path AND a.q = b.q AND a.id < b.id""",
    "p7_classes": _SHINGLES.replace("WITH", "WITH RECURSIVE") + _TEXT_LINKS + r"""
, ids AS (SELECT DISTINCT doc_id FROM documento WHERE doc_id IS NOT NULL),
short AS (SELECT doc_id, min(array_to_string(w, ' ')) AS k FROM w WHERE doc_id NOT IN (SELECT doc_id FROM n) GROUP BY doc_id),
e0 AS (SELECT id_a, id_b FROM t UNION SELECT a.doc_id, b.doc_id FROM short a JOIN short b ON a.k = b.k AND a.doc_id < b.doc_id),
e AS (SELECT id_a AS a, id_b AS b FROM e0 UNION SELECT id_b, id_a FROM e0),
reach AS (SELECT doc_id AS a, doc_id AS b FROM ids UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
links AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT a AS id, min(b) AS class_id, coalesce(any_value(l.links), 0) AS links FROM reach LEFT JOIN links l USING (a) GROUP BY a""",
    "p7_pages": "WITH" + _ADDRESSES + """
, keyed AS (SELECT host, path, q, min(id) AS page_id FROM u1 GROUP BY host, path, q)
SELECT id, min(page_id) AS page_id FROM u1 JOIN keyed USING (host, path, q) GROUP BY id""",
}
