"""Queries on the crawl: addresses, links, levels, PageRank and HITS; and the same on a graph of trade between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.functions.urls import DYNAMIC, html_links, normalize_url
from lexaria.operators import graph
from lexaria.operators.crawl import Crawl, Limits, crawl
from lexaria.operators.evaluate import overlap_at
from lexaria.operators.order import ordered
from lexaria.session import checkpoint, stored, table


#: Far below the sixth digit, by which the pages are ordered.
SETTLED = 1e-10


def pages(spark: SparkSession, d: str) -> DataFrame:
    return graph.crawled(table(spark, d, "pagetask").select("id", "url", "outlinks", "depth", "visto_en"))


def _graph(spark, d):
    nodes, edges = graph.link_graph(pages(spark, d))
    return checkpoint(nodes), checkpoint(edges)


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and an edge from supplier's to customer's nation where the revenue is above the mean of all pairs."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    orders = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("revenue").alias("revenue"))
    j = orders.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = checkpoint(j.groupBy("src", "dst").agg(F.sum("revenue").alias("revenue")))
    mean = pairs.agg(F.avg("revenue").alias("mean"))
    edges = pairs.crossJoin(F.broadcast(mean)).where("revenue > mean").select("src", "dst")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), checkpoint(edges)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("id", *[F.round(c, 9).alias(c) for c in cols])


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of HTML texts as absolute addresses, duplicates kept, numbered in order."""
    docs = table(spark, d, "documento").where(F.col("texto").rlike(r"(?i)<a\s")).groupBy("doc_id").agg(F.max("texto").alias("texto"))
    rows = docs.select("doc_id", F.posexplode(html_links("texto")).alias("no", "href"))
    base = F.lit("https://base.example/dir/page.html")
    return rows.select("doc_id", "no", normalize_url(F.col("href"), base).alias("url")).where("url IS NOT NULL")


def frontier_levels(spark: SparkSession, d: str) -> DataFrame:
    """Distance over links from the pages of depth 0, up to 6."""
    p = pages(spark, d)
    _, edges = _graph(spark, d)
    return graph.levels(p.where("depth = 0").select("id"), edges, 6).select("id", F.col("level").cast("int").alias("level"))


def overlap_curve(spark: SparkSession, d: str) -> DataFrame:
    """Share of common pages among the first k by PageRank and by authority, k = 10, 20, ... below min(501, pages)."""
    nodes, edges = _graph(spark, d)
    n = nodes.count()
    by = lambda df, c: ordered(df, [F.round(c, 9).desc(), F.col("id")], position="rank").select("id", "rank")
    return overlap_at(by(graph.pagerank(nodes, edges), "score"), by(graph.hits(nodes, edges), "authority"), list(range(10, min(501, n), 10)))


def _crawl(spark: SparkSession, d: str, limits: Limits) -> Crawl:
    """A crawl over the crawled state itself in place of the network, from its pages of depth 0."""
    state = checkpoint(pages(spark, d).where("url IS NOT NULL"))
    urls = state.select(F.col("id").alias("to"), F.col("url").alias("target"))
    links = state.select("url", F.posexplode_outer("outlinks").alias("pos", "to")).join(urls, "to", "left").groupBy("url").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("l"))
    links = stored(links.select("url", F.filter(F.col("l.target"), lambda x: x.isNotNull()).alias("links")))
    return crawl(state.where("depth = 0").select("url"), lambda front: front.join(links, "url"), limits)


def _found(state: Crawl) -> DataFrame:
    return state.pages.select("url", "depth").unionAll(state.waiting.select("url", "depth")).select("url", F.col("depth").cast("int").alias("depth"))


def crawl_again(spark: SparkSession, d: str) -> DataFrame:
    """Pages and depths of a crawl without caps but depth."""
    return _found(_crawl(spark, d, Limits(max_depth=4, max_dir_depth=100, max_per_site=1_000_000_000, max_total=1_000_000_000)))


def crawl_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same crawl held to depth 3, two directories and hosts of one ending."""
    return _found(_crawl(spark, d, Limits(max_depth=3, max_dir_depth=2, max_per_site=1_000_000_000, max_total=1_000_000_000, domain_filter=".example")))


def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl of at most 60 pages, 8 of a site, fetched, left and recorded."""
    state = _crawl(spark, d, Limits(max_depth=6, max_dir_depth=100, max_per_site=8, max_total=60))
    own = state.pages.agg(F.count(F.lit(1)).alias("fetched"), F.sum(F.size("outlinks")).alias("links"), F.max("depth").alias("depth"))
    return own.crossJoin(state.waiting.agg(F.count(F.lit(1)).alias("waiting"))).withColumn("failed", F.lit(state.failed))


def top_converged(spark: SparkSession, d: str) -> DataFrame:
    """The five pages with the highest PageRank, authority and hub scores, iterated until they settle: until their sum changes by less than SETTLED, however many pages share it."""
    nodes, edges = _graph(spark, d)
    h = stored(graph.hits(nodes, edges, rounds=1000, tolerance=SETTLED))
    parts = [graph.ordering(graph.pagerank(nodes, edges, rounds=150, tolerance=SETTLED / max(1, nodes.count())), "score"), graph.ordering(h, "authority"), graph.ordering(h, "hub")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def positive_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose scores aren't zero."""
    h = graph.hits(*_graph(spark, d), rounds=3)
    return h.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("hub") > 0).alias("hubs"), F.count_if(F.col("authority") > 0).alias("authorities"))


def selected_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links between the pages of depth 1."""
    p = pages(spark, d)
    return graph.with_property(p, graph.link_graph(p)[1], "node", "depth", [1])[1].select("src", "dst")


QUERIES = {
    "crawled_pages": lambda s, d: pages(s, d).select("id", "url", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce(F.size("outlinks"), F.lit(0)).alias("n_links")),
    "url_features": lambda s, d: graph.url_features(pages(s, d)),
    "crawl_stats": lambda s, d: graph.crawl_stats(pages(s, d)),
    "depth_dist": lambda s, d: pages(s, d).where("url IS NOT NULL").groupBy("depth").agg(F.count(F.lit(1)).alias("pages")).select(F.coalesce("depth", F.lit(-1)).alias("depth"), "pages"),
    "domain_top5": lambda s, d: graph.url_features(pages(s, d)).groupBy("domain").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "domain").limit(5),
    "link_edges": lambda s, d: graph.link_graph(pages(s, d))[1],
    "page_links": page_links,
    "frontier_levels": frontier_levels,
    "crawl_again": crawl_again,
    "crawl_capped": crawl_capped,
    "crawl_counters": crawl_counters,
    "top_converged": top_converged,
    "positive_scores": positive_scores,
    "selected_pages": selected_pages,
    "pagerank_pages": lambda s, d: _rounded(graph.pagerank(*_graph(s, d)), "score"),
    "hits_pages": lambda s, d: _rounded(graph.hits(*_graph(s, d)), "hub", "authority"),
    "overlap_at_k": overlap_curve,
    "two_hop": lambda s, d: graph.two_hop(graph.link_graph(pages(s, d))[1]),
    "trade_edges": lambda s, d: trade(s, d)[1],
    "pagerank_trade": lambda s, d: _rounded(graph.pagerank(*trade(s, d)), "score"),
    "hits_trade": lambda s, d: _rounded(graph.hits(*trade(s, d)), "hub", "authority"),
}

PAGES = """WITH RECURSIVE p AS (SELECT id, arg_max(struct_pack(url := url, outlinks := outlinks, depth := depth), visto_en) AS s FROM pagetask WHERE id IS NOT NULL GROUP BY id),
pages AS (SELECT id, s.url AS url, s.outlinks AS outlinks, s.depth AS depth FROM p),
nodes AS (SELECT id FROM pages), edges AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(outlinks) AS dst FROM pages) WHERE dst IN (SELECT id FROM nodes))
"""
TRADE = """WITH RECURSIVE pairs AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
nodes AS (SELECT n_nationkey AS id FROM nation), edges AS (SELECT src, dst FROM pairs WHERE revenue > (SELECT avg(revenue) FROM pairs))
"""
# arcs carry a page's mass to its targets, a loose page's to all, and nothing to itself, so that every page has a row in each round
RANK = """, deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), n AS (SELECT count(*) AS n FROM nodes),
arcs AS (SELECT src, dst, 1.0::DOUBLE / deg AS w FROM edges JOIN deg USING (src) UNION ALL SELECT a.id, b.id, 1.0::DOUBLE / n FROM (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM deg)) a, nodes b, n
  UNION ALL SELECT id, id, 0.0 FROM nodes),
pr AS (SELECT 0 AS i, id, 1.0::DOUBLE / n AS score FROM nodes, n UNION ALL
  SELECT i + 1, dst, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(score * w) FROM pr JOIN arcs ON arcs.src = pr.id, n WHERE i < 20 GROUP BY i, dst),
ranks AS (SELECT id, score FROM pr WHERE i = 20)"""
# two steps in one: hubs to hubs over common targets
HITS = """, co AS (SELECT src, dst, sum(w) AS w FROM (SELECT a.src AS src, b.src AS dst, 1.0::DOUBLE AS w FROM edges a JOIN edges b ON a.dst = b.dst UNION ALL SELECT id, id, 0.0 FROM nodes) GROUP BY src, dst),
hb AS (SELECT 0 AS i, id, 1.0::DOUBLE AS h FROM nodes UNION ALL SELECT i + 1, dst, sum(h * w) / 100 FROM hb JOIN co ON co.src = hb.id WHERE i < 20 GROUP BY i, dst),
hub AS (SELECT id, h / sum(h) OVER () AS hub FROM hb WHERE i = 20),
au AS (SELECT nodes.id, coalesce(sum(hub), 0) AS a FROM nodes LEFT JOIN edges ON edges.dst = nodes.id LEFT JOIN hub ON hub.id = edges.src GROUP BY nodes.id),
hits AS (SELECT id, hub, a / sum(a) OVER () AS authority FROM hub JOIN au USING (id))"""
_DOMAIN = r"regexp_extract(url, '^\w+://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1)"
_DEPTH = f"CAST(length({_PATH}) - length(replace({_PATH}, '/', '')) AS INT)"
_DYN = "(" + " OR ".join(f"contains(lower(url), '{x}')" for x in DYNAMIC) + ")"
SQL = {
    "crawled_pages": PAGES + "SELECT id, url, coalesce(depth, -1) AS depth, CAST(coalesce(len(outlinks), 0) AS INT) AS n_links FROM pages",
    "url_features": PAGES + f"SELECT id, {_DOMAIN} AS domain, {_DEPTH} AS dir_depth, {_DYN} AS dynamic FROM pages WHERE url IS NOT NULL",
    "crawl_stats": PAGES + f""", f AS (SELECT {_DYN} AS dynamic, depth, {_DEPTH} AS dir_depth, {_DOMAIN} AS domain FROM pages WHERE url IS NOT NULL), t AS (SELECT count(*) AS n FROM f),
g AS (SELECT 'total' AS kind, '' AS value, count(*) AS pages FROM f UNION ALL SELECT 'dynamic', CAST(dynamic AS VARCHAR), count(*) FROM f GROUP BY dynamic UNION ALL SELECT 'depth', coalesce(CAST(depth AS VARCHAR), ''), count(*) FROM f GROUP BY depth
  UNION ALL SELECT 'dir_depth', CAST(dir_depth AS VARCHAR), count(*) FROM f GROUP BY dir_depth UNION ALL SELECT 'domain', domain, count(*) FROM f GROUP BY domain)
SELECT kind, value, pages, round(100.0::DOUBLE * pages / n, 4) AS percent FROM g, t""",
    "depth_dist": PAGES + "SELECT coalesce(depth, -1) AS depth, count(*) AS pages FROM pages WHERE url IS NOT NULL GROUP BY depth",
    "domain_top5": PAGES + f"SELECT {_DOMAIN} AS domain, count(*) AS pages FROM pages WHERE url IS NOT NULL GROUP BY 1 ORDER BY pages DESC, domain LIMIT 5",
    "link_edges": PAGES + "SELECT src, dst FROM edges",
    "frontier_levels": PAGES + ", bfs AS (SELECT id, 0 AS level FROM pages WHERE depth = 0 UNION SELECT dst, level + 1 FROM bfs JOIN edges ON src = id WHERE level < 6) SELECT id, CAST(min(level) AS INT) AS level FROM bfs GROUP BY id",
    "crawl_again": PAGES + """, w AS (SELECT DISTINCT a.url AS src, b.url AS dst FROM edges JOIN pages a ON a.id = src JOIN pages b ON b.id = dst WHERE a.url IS NOT NULL AND b.url IS NOT NULL),
bfs AS (SELECT DISTINCT url, 0 AS depth FROM pages WHERE depth = 0 AND url IS NOT NULL UNION SELECT dst, depth + 1 FROM bfs JOIN w ON src = url WHERE depth < 4) SELECT url, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY url""",
    "crawl_capped": PAGES + f""", w AS (SELECT DISTINCT a.url AS src, b.url AS dst FROM edges JOIN pages a ON a.id = src JOIN pages b ON b.id = dst WHERE a.url IS NOT NULL
  AND {_DEPTH.replace('url', 'b.url')} <= 2 AND contains({_DOMAIN.replace('url', 'b.url')}, '.example')),
bfs AS (SELECT DISTINCT url, 0 AS depth FROM pages WHERE depth = 0 AND url IS NOT NULL UNION SELECT dst, depth + 1 FROM bfs JOIN w ON src = url WHERE depth < 3) SELECT url, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY url""",
    "top_converged": PAGES + RANK.replace("20", "150") + HITS.replace("20", "400") + """, t AS (SELECT 'score' AS measure, id, round(score, 6) AS s FROM ranks UNION ALL SELECT 'authority', id, round(authority, 6) FROM hits UNION ALL SELECT 'hub', id, round(hub, 6) FROM hits)
SELECT measure, CAST(row_number() OVER (PARTITION BY measure ORDER BY s DESC, id) AS INT) AS rank, id FROM t QUALIFY rank <= 5""",
    "positive_scores": PAGES + HITS.replace("20", "3") + " SELECT count(*) AS pages, count(*) FILTER (hub > 0) AS hubs, count(*) FILTER (authority > 0) AS authorities FROM hits",
    "selected_pages": PAGES + ", one AS (SELECT id FROM pages WHERE depth = 1) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM one) AND dst IN (SELECT id FROM one)",
    "pagerank_pages": PAGES + RANK + " SELECT id, round(score, 9) AS score FROM ranks",
    "hits_pages": PAGES + HITS + " SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM hits",
    "overlap_at_k": PAGES + RANK + HITS + """, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS ra FROM ranks), b AS (SELECT id, row_number() OVER (ORDER BY round(authority, 9) DESC, id) AS rb FROM hits)
SELECT CAST(k AS INT) AS k, round((SELECT count(*) FROM a JOIN b USING (id) WHERE greatest(ra, rb) <= k) / k, 6) AS overlap FROM (SELECT unnest(range(10, least(501, (SELECT n FROM n)), 10)) AS k)""",
    "two_hop": PAGES + """, b AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), f AS (SELECT src, dst FROM b UNION SELECT x.src, y.dst FROM b x JOIN b y ON x.dst = y.src WHERE x.src <> y.dst)
SELECT id, near, far FROM (SELECT src AS id, count(*) AS near FROM b GROUP BY src) JOIN (SELECT src AS id, count(*) AS far FROM f GROUP BY src) USING (id)""",
    "trade_edges": TRADE + "SELECT src, dst FROM edges",
    "pagerank_trade": TRADE + RANK + " SELECT id, round(score, 9) AS score FROM ranks",
    "hits_trade": TRADE + HITS + " SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM hits",
}
