import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexaria.functions.text import main_tokens
from lexaria.operators import boolean, evaluate, graph, index, order, rank, skew, stats
from lexaria.operators.phrases import containing

TEXTS = [(1, "a b c"), (2, "a a d"), (3, "b d d e"), (4, ""), (5, None), (6, "a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.fixture(scope="module")
def tf(docs):
    return stats.term_frequencies(docs, main_tokens(F.col("text")))


def ids(df, col="doc_id"):
    return sorted(r[col] for r in df.collect())


def test_eager_join_equals_the_join(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randint(0, 3), rnd.choice([None, 1, 2])) for _ in range(200)], "k int, g int, v int")
    right = spark.createDataFrame([(rnd.choice([1, 2, 2, 4, None]), rnd.randint(1, 9)) for _ in range(80)], "k int, v int")
    for how in ("inner", "left"):
        got = skew.eager_join_aggregate(left, right, ["k"], left_sums={"v": F.col("v")}, right_sums={"v": F.col("v")}, group_by=["g"], how=how)
        a, b = left.alias("a"), right.alias("b")
        want = a.join(b, F.col("a.k") == F.col("b.k"), how).groupBy("a.g").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("a.v"), F.lit(0)).alias("lv"), F.coalesce(F.sum("b.v"), F.lit(0)).alias("rv"))
        assert sorted((r["g"], r["joined_rows"], r["joined_l_v"], r["joined_r_v"]) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    none = skew.eager_join_aggregate(left.limit(0), right, ["k"], left_sums={"v": F.col("v")})
    assert none.count() == 0
    with pytest.raises(ValueError):
        skew.eager_join_aggregate(left, right, ["k"], how="cross")


def test_p6_found_joins_and_reads_once(spark):
    from lexaria.plans import skew_queries

    for totals in (skew_queries.doc_totals, skew_queries.term_totals):
        df = totals(spark, "/root/testdata/sf0.001").withColumn("own", skew.own_figure("rows"))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == 1 and plan.count("parquet") == 2
        assert df.where("own <> l_rows").count() == 0
    left = spark.createDataFrame([(1, 2), (1, None), (2, 5), (None, 7)], "k int, v long")
    right = spark.createDataFrame([(1,), (1,), (1,), (None,)], "k int")
    t = skew.eager_join_aggregate(left, right, ["k"], left_sums={"v": F.col("v")}, how="left")
    got = {r["k"]: (r["a"], r["b"]) for r in t.select("k", skew.own_figure("rows").alias("a"), skew.own_figure("v").alias("b")).collect()}
    assert got == {1: (2, 2), 2: (1, 5), None: (1, 7)}


def test_stored_tables_can_be_discarded(spark):
    from lexaria.session import discard, stored

    t = stored(spark.range(5).repartition(2))
    assert t.count() == 5 and t.dtypes == spark.range(1).dtypes
    discard(spark.range(1))
    discard(t)
    import os

    assert not os.path.exists(t._stored_at.removeprefix("file:"))


def test_heavy_keys(spark):
    t = spark.createDataFrame([(1, 50), (2, 49), (None, 100), (3, 1)], "k int, n long")
    assert ids(skew.heavy_keys(t, "k", "n", 0.25), "k") == [1]
    assert skew.heavy_keys(t.limit(0), "k", "n", 0.25).count() == 0


def test_order_numbers_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r["x"]: (r["pos"], r["s"]) for r in order.ordered(rows, [F.col("x")], sums={"s": F.col("x")}).collect()}
    assert all(got[x] == (x + 1, x * (x + 1) // 2) for x in range(1000))
    before = {r["x"]: r["b"] for r in order.ordered(rows, [F.col("x").desc()], lags={"b": F.col("x")}).collect()}
    assert before == {x: x + 1 if x < 999 else None for x in range(1000)}
    assert order.ordered(rows.limit(0), [F.col("x")], lags={"b": F.col("x")}).count() == 0


def test_boolean_is_set_algebra(tf, docs):
    have = {t: {d for d, text in TEXTS if text and t in text.split()} for t in "abcdez"}
    every = {d for d, _ in TEXTS}
    cases = {"a AND b": have["a"] & have["b"], "a or z": have["a"], "a AND NOT b": have["a"] - have["b"], "(a OR d) AND NOT b": (have["a"] | have["d"]) - have["b"], "a OR NOT b": have["a"] | (every - have["b"]), "NOT (a OR b)": every - have["a"] - have["b"]}
    for q, want in cases.items():
        assert ids(boolean.boolean_search(tf, docs, q)) == sorted(want), q
    for x, y in itertools.combinations("abcd", 2):
        assert ids(boolean.conjunction(tf, f"{x} AND {y}")) == ids(boolean.boolean_search(tf, docs, f"{x} AND {y}"))
    assert boolean.conjunction(tf, "a AND zz").count() == 0
    for bad in ("a AND", "(a", "a)", "", "or"):
        with pytest.raises(ValueError):
            boolean.parse(bad)
    with pytest.raises(ValueError):
        boolean.conjunction(tf, "a")


def test_ranking_defined_at_the_edges(spark, docs):
    ix = rank.build_index(docs, main_tokens(F.col("text")))
    q = rank.topic_terms(spark, {1: "a b", 2: "zz", 3: ""}, main_tokens)
    for model in (rank.cosine_tf, rank.cosine_tfidf, rank.bm25, rank.coordination, rank.hiemstra_lm, rank.dirichlet_lm, rank.robertson_tfidf):
        rows = rank.top_k(model(ix, q), 3).collect()
        assert {r["qid"] for r in rows} == {1}
    best = rank.top_k(rank.cosine_tf(ix, q), 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [1, 6]  # equal texts: the smaller id first
    pads = rank.top_k(rank.query_likelihood(ix, q, 0.7, k=3), 3).where("qid = 2").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in pads] == [(1, -100.0), (2, -100.0), (3, -100.0)]


def test_index_structures(spark):
    tf = spark.createDataFrame([("t", d, 1 + d % 3) for d in range(1, 11)] + [("u", 5, 2)], "term string, doc_id long, tf long")
    terms = stats.term_stats(tf)
    skips = index.skip_lists(tf, terms).where("term = 't'").orderBy("skip_idx").collect()
    assert [(r["doc_id"], r["byte_offset"]) for r in skips] == [(1, 0), (4, 24), (7, 48), (10, 72)]
    assert [(r["term"], r["pointer"]) for r in index.lexicon(terms).orderBy("term").collect()] == [("t", 0), ("u", 80)]
    for g in (True, False):
        assert sorted(map(tuple, index.decompress(index.compress(tf, g), g).collect())) == sorted(map(tuple, tf.collect()))


def test_written_index_is_found_again(spark, tf, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(tf, path)
    assert index.posting_list(spark.read.parquet(path), "A").collect() == index.posting_list(tf, "a").collect()
    with pytest.raises(Exception):
        index.write_index(tf, path)


def test_evaluation(spark):
    run = spark.createDataFrame([("s", 1, d, 1.0 / r, r) for r, d in enumerate((10, 11, 12, 13), 1)], "system string, qid int, doc_id long, score double, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 1), (1, 99, 1), (2, 5, 1)], "qid int, doc_id long, rel int")
    r = evaluate.per_query(run, qrels).collect()[0]
    assert r["p_at_k"] == 0.2 and r["ap"] == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)
    h = evaluate.histogram(spark.createDataFrame([("s", 1.0), ("s", 1.0)], "system string, value double"), 5).collect()
    assert [(x["bin"], x["n"]) for x in h] == [(0, 2)]
    same = evaluate.rank_correlation(run, run, 10).collect()
    assert same[0]["rho"] == 1.0


def test_link_analysis(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "src int, dst int")
    pr = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges).collect()}
    assert sum(pr.values()) == pytest.approx(1) and max(pr, key=pr.get) == 3
    h = graph.hits(nodes, edges).agg(F.sum("hub"), F.sum("authority")).first()
    assert h[0] == pytest.approx(1) and h[1] == pytest.approx(1)
    assert graph.pagerank(nodes.limit(0), edges.limit(0)).count() == 0
    assert {r["id"]: r["level"] for r in graph.levels(nodes.where("id = 4"), edges, 9).collect()} == {4: 0, 3: 1, 1: 2, 2: 3}
    assert {r["id"]: (r["near"], r["far"]) for r in graph.two_hop(edges).collect()}[4] == (1, 3)


def test_crawl_state_keeps_the_latest_row(spark):
    t = spark.createDataFrame([(1, "http://h/a", [2, 2, 1, None], 0, "2024-01-01"), (1, "http://h/b", [2], 0, "2024-01-02"), (2, None, None, None, None)], "id int, url string, outlinks array<int>, depth int, at string")
    t = t.withColumn("visto_en", F.to_timestamp_ntz("at")).drop("at")
    pages = graph.crawled(t)
    assert {r["id"]: r["url"] for r in pages.collect()} == {1: "http://h/b", 2: None}
    assert [tuple(r) for r in graph.link_graph(pages)[1].collect()] == [(1, 2)]
    assert graph.crawl_stats(pages).where("kind = 'total'").first()["pages"] == 1


def test_passages(spark):
    docs = spark.createDataFrame([(1, "xx abc yy"), (2, None), (3, "abcabc"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abc"), (8, "abc"), (9, ""), (10, None), (11, "cab")], "item_id long, text string")
    assert sorted(map(tuple, containing(docs, items).collect())) == [(1, 7), (1, 8), (3, 7), (3, 8), (3, 11)]
    assert containing(docs, items.limit(0)).count() == 0


def test_empty_collection(spark, docs):
    none = docs.limit(0)
    tokens = main_tokens(F.col("text"))
    terms = stats.term_stats(stats.term_frequencies(none, tokens))
    assert stats.collection_stats(terms, stats.doc_stats(none, tokens)).first()["n_docs"] == 0
    assert index.compression_savings(index.compressed_sizes(stats.term_frequencies(none, tokens))).count() == 1
    assert stats.heaps_pairs(none, tokens).count() == 0 and stats.zipf_ranks(terms).count() == 0
