"""Breadth-first crawl by levels with the order, caps and counters of a queue, and its stored state."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexaria.functions.urls import dir_depth, domain, normalized, read_html
from lexaria.operators.order import ordered
from lexaria.session import stored

#: What a browser would call itself; some servers answer nothing else.
AGENT = "Mozilla/5.0 (compatible; lexaria)"


@dataclass(frozen=True)
class Limits:
    """Caps of a crawl. A link is admitted by depth, by directory depth, by its site's pages fetched so far and by a part of its domain; the crawl ends at ``max_total`` fetched pages."""

    max_depth: int = 3
    max_dir_depth: int = 3
    max_per_site: int = 20
    max_total: int = 1000
    domain_filter: str | None = None


@dataclass
class Crawl:
    """``pages`` (id, url, depth, outlinks) were fetched, ``waiting`` (id, url, depth) were found and not fetched, ``failed`` counts fetches without a result. Ids are numbered from 0 by discovery."""

    pages: DataFrame
    waiting: DataFrame
    failed: int
    limits: Limits


def http_get(url: str, timeout: float) -> tuple[int, str]:
    """Status and text of an address."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetched_text(url: str, get: Callable[[str, float], tuple[int, str]], *, timeout: float = 3.0, retries: int = 1, wait: float = 0.5) -> str | None:
    """The text of an answer with status 200, else None. Any other status is asked again at once, an error after ``wait`` seconds, ``retries`` times in all."""
    for left in range(retries, -1, -1):
        try:
            status, text = get(url, timeout)
            if status == 200:
                return text
        except Exception:
            if left:
                time.sleep(wait)
    return None


def web_fetcher(*, keep_query: bool = False, get: Callable[[str, float], tuple[int, str]] = http_get, timeout: float = 3.0, retries: int = 1, wait: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` for ``crawl``: (url) to (url, links) with every link as a normalized address, in order and with duplicates; a failed fetch has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, links = [], []
            for url in b.column(0).to_pylist():
                text = fetched_text(url, get, timeout=timeout, retries=retries, wait=wait)
                if text:
                    urls.append(url)
                    links.append([x for h in read_html(text)[1] if (x := normalized(h, url, keep_query))])
            yield pa.record_batch([pa.array(urls, pa.string()), pa.array(links, pa.list_(pa.string()))], names=["url", "links"])

    def fetch(front: DataFrame) -> DataFrame:
        # few addresses, much waiting: over all cores
        return front.select("url").repartition(front.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "url string, links array<string>")

    return fetch


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], limits: Limits = Limits()) -> Crawl:
    """A breadth-first crawl from ``seeds`` (url) whose result is that of one queue, though each level is fetched at once.

    ``fetch`` gets (url) and returns (url, links ARRAY<STRING> of normalized addresses); a failed fetch returns no row. Pages are taken in order of their ids; new addresses are numbered in the order of
    the pages and links they are found by. A page's links are admitted by ``limits`` as the counts stand at its turn: a site that reaches its cap with the page at hand takes none of its links.
    Links to pages whose turn is over (the page itself included) are left out; the others are kept in ``outlinks``, duplicates too. Pages behind the one that fills ``max_total`` wait.

    NULL addresses are left out, repeated seeds count once; seeds are numbered by address. An empty frontier ends the crawl.
    """
    front = stored(ordered(seeds.where("url IS NOT NULL").select("url").distinct(), [F.col("url")], position="no").select((F.col("no") - 1).alias("id"), "url", F.lit(0).alias("depth")))
    known, pages, waiting = front, None, None
    count, done, failed = front.count(), 0, 0
    held: DataFrame | None = None  # fetched pages of each site, and the page that filled it
    for depth in range(limits.max_depth + 1):
        got = fetch(front.select("url")).groupBy("url").agg(F.max(F.coalesce("links", F.array())).alias("links"))
        level = front.join(got, "url", "left").withColumn("site", domain(F.col("url")))
        level = stored(ordered(level, [F.col("id")], position=None, sums={"nth": F.col("links").isNotNull().cast("long")}))
        # the turn of a page comes while less than the total are fetched before it
        turn = F.col("nth") - F.col("links").isNotNull().cast("long") < limits.max_total - done
        own = level.where(turn & F.col("links").isNotNull())
        turns = level.agg(F.count_if(turn & F.col("links").isNotNull()), F.count_if(turn & F.col("links").isNull())).first()
        done, failed = done + turns[0], failed + turns[1]
        rest = level.where(~turn).select("id", "url", "depth")
        waiting = rest if waiting is None else waiting.unionAll(rest)
        # the page with which a site reaches its cap: the first pages of a site are enough to know
        first = own.select("site", "id").withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy("id"))).where(F.col("rn") <= limits.max_per_site)
        fresh = first.groupBy("site").agg(F.collect_list(F.struct("rn", "id")).alias("firsts"))
        totals = own.groupBy("site").agg(F.count(F.lit(1)).alias("more"))
        now = fresh.join(totals, "site")
        if held is not None:
            now = now.join(held, "site", "full")
        else:
            now = now.withColumns({"fetched": F.lit(0).cast("long"), "full_at": F.lit(None).cast("long")})
        now = now.withColumn("fetched", F.coalesce("fetched", F.lit(0)))
        at = F.filter("firsts", lambda x: x["rn"] == limits.max_per_site - F.col("fetched"))
        full_at = F.coalesce("full_at", F.try_element_at(at, F.lit(1))["id"])
        held = stored(now.select("site", full_at.alias("full_at"), (F.col("fetched") + F.coalesce("more", F.lit(0))).alias("fetched")))
        links = own.select(F.col("id").alias("src"), F.posexplode("links").alias("pos", "url")).where("url IS NOT NULL")
        links = links.withColumn("site", domain(F.col("url"))).where((dir_depth(F.col("url")) <= limits.max_dir_depth) & F.lit(depth < limits.max_depth and limits.max_per_site > 0))
        if limits.domain_filter:
            links = links.where(F.contains("site", F.lit(limits.domain_filter)))
        links = links.join(held.select("site", "full_at"), "site", "left").where("full_at IS NULL OR src < full_at").select("src", "pos", "url")
        # new addresses, numbered by the link they are found by
        new = links.join(known.select("url"), "url", "left_anti").groupBy("url").agg(F.min(F.struct("src", "pos")).alias("by"))
        new = ordered(new.select("url", "by.src", "by.pos"), [F.col("src"), F.col("pos")], position="no")
        front = stored(new.select((F.col("no") + (count - 1)).alias("id"), "url", F.lit(depth + 1).alias("depth")))
        known = stored(known.select("id", "url", "depth").unionAll(front))
        ids = known.select("url", F.col("id").alias("dst"))
        out = links.join(ids, "url").where("dst > src").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l"))
        part = own.join(out, F.col("id") == F.col("src"), "left").select("id", "url", "depth", F.coalesce(F.col("l.dst"), F.array().cast("array<bigint>")).alias("outlinks"))
        part = stored(part)
        pages = part if pages is None else pages.unionAll(part)
        fresh_pages = front.count()
        count += fresh_pages
        if not fresh_pages or done >= limits.max_total:
            break
    left = front if fresh_pages else front.limit(0)
    return Crawl(pages, waiting.unionAll(left), failed, limits)


def save_crawl(state: Crawl, path: str, mode: str = "errorifexists") -> None:
    """Pages and waiting addresses as tables, limits and counters as one row of JSON."""
    state.pages.write.mode(mode).parquet(f"{path}/pages")
    state.waiting.write.mode(mode).parquet(f"{path}/waiting")
    spark = state.pages.sparkSession
    spark.createDataFrame([(json.dumps(asdict(state.limits) | {"failed": state.failed}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/run")


def load_crawl(spark: SparkSession, path: str) -> Crawl:
    """What ``save_crawl`` wrote. Limits that a state doesn't name take their defaults; pages without an id are numbered after the largest."""
    row = spark.read.text(f"{path}/run").first()
    said = json.loads(row[0]) if row else {}
    failed = int(said.pop("failed", 0))
    pages, waiting = spark.read.parquet(f"{path}/pages"), spark.read.parquet(f"{path}/waiting")
    if pages.where("id IS NULL").limit(1).count():
        top = max(x or -1 for df in (pages, waiting) for x in df.agg(F.max("id")).first())
        numbered = ordered(pages.where("id IS NULL").drop("id"), [F.col("url")], position="no").withColumn("id", F.col("no") + top)
        pages = pages.where("id IS NOT NULL").unionByName(numbered.drop("no"))
    return Crawl(pages, waiting, failed, Limits(**{k: v for k, v in said.items() if k in Limits.__dataclass_fields__}))


def crawl_report(state: Crawl) -> DataFrame:
    """(kind, value, pages, percent) of the fetched pages as ``graph.crawl_stats``, and the number of failed fetches."""
    from lexaria.operators.graph import crawl_stats

    failures = state.pages.sparkSession.createDataFrame([("failed", "", state.failed, None)], "kind string, value string, pages long, percent double")
    return crawl_stats(state.pages).unionByName(failures)
