import random

import pytest
from pyspark.sql import functions as F

from lexaria.functions.urls import normalized
from lexaria.operators import crawl as C, graph


def site(rnd, n=40):
    urls = [f"http://h{i % 4}.{'test' if i % 3 else 'example'}/{'a/' * (i % 3)}p{i}" for i in range(n)]
    return urls, {u: [rnd.choice(urls) for _ in range(rnd.randint(0, 6))] for i, u in enumerate(urls) if i % 7 != 6}


def queue(seeds, links, lim):
    """The crawl by one queue."""
    ids = {u: i for i, u in enumerate(seeds)}
    todo, depth, done, over, count, failed = list(seeds), dict.fromkeys(seeds, 0), {}, set(), {}, 0
    dom = lambda u: u.split("/")[2]
    while todo and len(done) < lim.max_total:
        u = todo.pop(0)
        over.add(u)
        if u not in links:
            failed += 1
            continue
        count[dom(u)] = count.get(dom(u), 0) + 1
        out = []
        for x in [x for x in links[u] if x not in over]:
            path = "/" + x.split("/", 3)[3]
            if count.get(dom(x), 0) >= lim.max_per_site or depth[u] + 1 > lim.max_depth or path.count("/") > lim.max_dir_depth or (lim.domain_filter and lim.domain_filter not in dom(x)):
                continue
            if x not in ids:
                ids[x], depth[x] = len(ids), depth[u] + 1
                todo.append(x)
            out.append(ids[x])
        done[u] = (ids[u], depth[u], out)
    return done, {u: (ids[u], depth[u]) for u in todo}, failed


@pytest.mark.parametrize("limits", [C.Limits(3, 2, 3, 999), C.Limits(4, 9, 4, 12, "h")])
def test_crawl_is_that_of_one_queue(spark, limits):
    urls, links = site(random.Random(limits.max_per_site))
    table = spark.createDataFrame(list(links.items()), "url string, links array<string>")
    seeds = sorted(urls[:3])
    state = C.crawl(spark.createDataFrame([(u,) for u in [*seeds, seeds[0], None]], "url string"), lambda f: f.join(table, "url"), limits)
    done, waiting, failed = queue(seeds, links, limits)
    assert {r["url"]: (r["id"], r["depth"], r["outlinks"]) for r in state.pages.collect()} == done
    assert {r["url"]: (r["id"], r["depth"]) for r in state.waiting.collect()} == waiting
    assert state.failed == failed


def test_saved_crawl(spark, tmp_path):
    urls, links = site(random.Random(4))
    table = spark.createDataFrame(list(links.items()), "url string, links array<string>")
    state = C.crawl(spark.createDataFrame([(urls[0],)], "url string"), lambda f: f.join(table, "url"), C.Limits(9, 9, 5, 9))
    C.save_crawl(state, str(tmp_path / "c"))
    back = C.load_crawl(spark, str(tmp_path / "c"))
    assert back.limits == state.limits and back.failed == state.failed
    assert sorted(map(str, back.pages.collect())) == sorted(map(str, state.pages.collect()))
    assert {r["kind"]: r["pages"] for r in C.crawl_report(back).where("kind IN ('total', 'failed')").collect()} == {"total": back.pages.count(), "failed": state.failed}
    with pytest.raises(Exception):
        C.save_crawl(state, str(tmp_path / "c"))
    odd = C.Crawl(state.pages.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), state.waiting, 0, state.limits)
    C.save_crawl(odd, str(tmp_path / "d"))
    assert C.load_crawl(spark, str(tmp_path / "d")).pages.where("id IS NULL").count() == 0
    empty = C.crawl(spark.createDataFrame([], "url string"), lambda f: f.join(table, "url"))
    assert empty.pages.count() == 0 and empty.waiting.count() == 0


def test_fetching(spark):
    asked = []

    def get(url, timeout):
        asked.append(url)
        if "bad" in url:
            raise OSError
        return (200, "<a href='/x'>x</a><A HREF='y?q=1#z'>") if len(asked) > 1 else (503, "")

    assert C.fetched_text("u", get, wait=0) == "<a href='/x'>x</a><A HREF='y?q=1#z'>" and len(asked) == 2
    assert C.fetched_text("bad", get, wait=0, retries=2) is None and len(asked) == 5
    page = lambda url, timeout: (200, "<a href='/x'>x</a><A HREF='y?q=1#z'>") if "good" in url else (404, "")
    got = C.web_fetcher(get=page, wait=0)(spark.createDataFrame([("http://good/a/b",), ("http://other/",)], "url string")).collect()
    assert [(r["url"], r["links"]) for r in got] == [("http://good/a/b", ["http://good/x", "http://good/a/y"])]
    assert normalized("y?q=1", "http://good/a/b", True) == "http://good/a/y?q=1"


def test_selection(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, k string")
    edges = spark.createDataFrame([(1, 2, 9), (1, 3, 8), (4, 4, 9)], "src long, dst long, w int")
    n, e = graph.with_property(nodes, edges, "node", "k", ["a"])
    assert sorted(r["id"] for r in n.collect()) == [1, 3] and [(r["src"], r["dst"], r["w"]) for r in e.collect()] == [(1, 3, 8)]
    n, e = graph.with_property(nodes, edges, "edge", "w", [9])
    assert sorted(r["id"] for r in n.collect()) == [1, 2, 4] and e.count() == 2
    with pytest.raises(ValueError):
        graph.with_property(nodes, edges, "x", "w", [])


def test_convergence(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (4, 2)], "src int, dst int")
    long, short = ({r["id"]: r["score"] for r in graph.pagerank(nodes, edges, rounds=r, tolerance=t).collect()} for r, t in ((40, None), (100, 1e-7)))
    assert all(abs(long[i] - short[i]) < 1e-4 for i in long) and abs(sum(short.values()) - 1) < 1e-9
    h = {r["id"]: r["authority"] for r in graph.hits(nodes, edges, rounds=100, tolerance=1e-6).collect()}
    assert h[2] == pytest.approx(0.5, abs=1e-5) and h[3] == pytest.approx(0.5, abs=1e-5)


def test_settling_takes_few_jobs(spark):
    # two stars whose sizes differ little: some hundred rounds
    edges = spark.createDataFrame([(100 + i, 1) for i in range(10)] + [(200 + i, 2) for i in range(11)], "src int, dst int")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    spark.sparkContext.setJobGroup("settling", "settling")
    try:
        h = {r["id"]: (r["hub"], r["authority"]) for r in graph.hits(nodes, edges, rounds=1000, tolerance=1e-9).collect()}
        s = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges, rounds=1000, tolerance=1e-12).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("settling"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert h[2][1] == pytest.approx(1, abs=1e-7) and h[1][1] == pytest.approx(0, abs=1e-7) and h[200][0] == pytest.approx(1 / 11)
    assert s[1] / s[100] == pytest.approx(1 + 0.85 * 10) and s[2] / s[200] == pytest.approx(1 + 0.85 * 11)
    assert jobs < 60


def test_top_converged_is_settled_on_many_pages(spark, tmp_path):
    from lexaria.plans.web_queries import top_converged

    # page 1 links to itself and gains for some thirty rounds; page 2 has all its links in the first
    links = {1: [1], **{i: [2] for i in range(3, 8)}}
    rows = spark.range(1, 2001).select(F.col("id").cast("int").alias("id"), F.lit("http://h.example/").alias("url"), F.lit(0).alias("depth"), F.to_timestamp_ntz(F.lit("2024-01-01")).alias("visto_en"))
    out = spark.createDataFrame(list(links.items()), "id int, outlinks array<int>")
    rows.join(out, "id", "left").write.parquet(str(tmp_path / "pagetask.parquet"))
    got = {(r["measure"], r["rank"]): r["id"] for r in top_converged(spark, str(tmp_path)).collect()}
    assert [got["score", i] for i in range(1, 6)] == [1, 2, 3, 4, 5]
    assert got["authority", 1] == 2 and [got["hub", i] for i in range(1, 6)] == [3, 4, 5, 6, 7]


def test_rounds_in_one_task_are_those_of_joins(spark, monkeypatch):
    rnd = random.Random(5)
    ends = [*range(12), 90, None]  # 90 is no node
    pairs = [(rnd.choice(ends), rnd.choice(ends)) for _ in range(60)]
    edges = spark.createDataFrame(pairs + pairs[:5], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(15), 3, None]], "id int")
    cases = [(nodes, edges), (nodes, edges.limit(0)), (nodes.limit(0), edges)]
    run = lambda f, n, e, t: {r["id"]: tuple(r)[1:] for r in f(n, e, rounds=10, tolerance=t).collect()}
    monkeypatch.setattr(graph, "CHUNK", 7)
    one = [[run(f, n, e, 1e-3) for f in (graph.pagerank, graph.hits)] for n, e in cases]
    assert graph.hits(nodes, edges, tolerance=1e-3).schema["id"].dataType == nodes.schema["id"].dataType
    monkeypatch.setattr(graph, "IN_ONE_TASK", -1)
    monkeypatch.setattr(graph, "LOOK", 1)
    for (n, e), mine in zip(cases, one):
        for f, got in zip((graph.pagerank, graph.hits), mine):
            want = run(f, n, e, 1e-3)
            assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)
