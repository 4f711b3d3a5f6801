"""Queries on boolean and ranked retrieval and on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.functions.text import main_tokens
from lexaria.operators import boolean, evaluate, rank
from lexaria.operators.phrases import containing
from lexaria.plans.text_queries import TOK, docs, tf_of, tokens
from lexaria.session import checkpoint, table

TOPICS = {1: "índice archivo página", 2: "the map of the library", 3: "lista de palabras de lectura lenta", 4: "vocabulario zzdesconocida copia", 5: "Wörterbuch Sammlung Regal", 6: "quaderno raccolta"}
BOOLEAN = {
    "bool_and2": "archivo AND mapa", "bool_or2": "archivo OR library", "bool_andnot2": "archivo AND NOT mapa", "bool_and3": "archivo AND mapa AND copia",
    "bool_or_andnot3": "(archivo OR library) AND NOT mapa", "bool_and_or3": "(archivo AND mapa) OR library", "bool_or_not": "archivo OR NOT library",
}
PATTERN_WORDS = [["archivo", "mapa"], ["library", "index"], ["archivo", "mapa", "copia"], ["the", "library", "map"]]
#: Topics of which some match few documents or none.
RARE_TOPICS = {1: "zzdesconocida", 2: "índice zzdesconocida", 3: "quaderno raccolta"}
#: Recall and precision by rank of one published series (fixed values).
SERIES = [(0.09, 1.00), (0.09, 0.50), (0.09, 0.33), (0.18, 0.50), (0.27, 0.60), (0.27, 0.50), (0.27, 0.43), (0.27, 0.38), (0.27, 0.33), (0.36, 0.40), (0.36, 0.36), (0.36, 0.33), (0.36, 0.31), (0.45, 0.36), (0.45, 0.33)]


def _index(spark: SparkSession, d: str) -> rank.Index:
    return rank.build_index(docs(spark, d), tokens())


def _topics(spark: SparkSession) -> DataFrame:
    return rank.topic_terms(spark, TOPICS, main_tokens)


def _ranked(model, k: int = 10):
    return lambda spark, d: rank.top_k(model(_index(spark, d), _topics(spark)), k)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out item as a topic."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return rank.topic_terms(spark, items, main_tokens)


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, rel): a document that holds an item's whole text is relevant to it."""
    return containing(docs(spark, d), table(spark, d, "benchmark").select("item_id", "text")).select(F.col("item_id").alias("qid"), "doc_id", F.lit(1).alias("rel"))


def runs(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """(system, qid, doc_id, score, rank) of three models over all items."""
    ix, q = rank.stored(_index(spark, d)), _items(spark, d)
    parts = [rank.top_k(m(ix, q), k, name) for name, m in (("bm25", rank.bm25), ("tfidf", rank.robertson_tfidf), ("hiemstra", rank.hiemstra_lm))]
    return checkpoint(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _evaluated(f):
    return lambda spark, d: f(runs(spark, d), checkpoint(qrels(spark, d)))


def spearman_topk(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of two models on every topic at k = 10, 25 and 50."""
    ix, q = rank.stored(_index(spark, d)), _topics(spark)
    a, b = checkpoint(rank.top_k(rank.bm25(ix, q), 50)), checkpoint(rank.top_k(rank.robertson_tfidf(ix, q), 50))
    parts = [evaluate.rank_correlation(a, b, k).withColumn("k", F.lit(k)) for k in (10, 25, 50)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def metric_hist(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.per_query(runs(spark, d), checkpoint(qrels(spark, d)))
    return evaluate.histogram(m.select("system", F.col("ap").alias("value")), 20)


def query_len_groups(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of the posting lists of a topic by its number of distinct terms."""
    q = _items(spark, d)
    sizes = tf_of(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = sizes.join(F.broadcast(q), "term").groupBy("qid").agg(F.sum("df").alias("postings"))
    n = q.groupBy("qid").agg(F.count(F.lit(1)).alias("terms"))
    return n.join(t, "qid", "left").groupBy("terms").agg(F.count(F.lit(1)).alias("topics"), F.round(F.avg(F.coalesce("postings", F.lit(0))), 6).alias("mean_postings"))


CANDIDATES = [(1, "archivo mapa"), (2, "archivo zzdesconocida"), (3, "the library map"), (4, "archivo"), (5, "a b c d"), (6, "índice copia")]


def query_filter(spark: SparkSession, d: str) -> DataFrame:
    """Queries of two or three words that are all in the vocabulary."""
    terms = tf_of(spark, d).select("term").distinct()
    return boolean.usable_queries(spark.createDataFrame(CANDIDATES, "qid int, query string"), terms, main_tokens)


def size_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of terms of a topic by ten bins of the summed sizes of its posting lists."""
    q = _items(spark, d)
    sizes = tf_of(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    per = sizes.join(F.broadcast(q), "term").groupBy("qid").agg(F.sum("df").alias("size"), F.count(F.lit(1)).cast("double").alias("value"))
    return evaluate.mean_by_bin(per, 10)


def ranked_union(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the first ten of either model, with both ranks (0: not in that list)."""
    ix, q = _index(spark, d), _topics(spark)
    a, b = (rank.top_k(m(ix, q), 10).select("qid", "doc_id", F.col("rank").alias(n)) for m, n in ((rank.bm25, "bm25_rank"), (rank.coordination, "coordination_rank")))
    return a.join(b, ["qid", "doc_id"], "full").select("qid", "doc_id", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("coordination_rank", F.lit(0)).alias("coordination_rank"))


QUERIES = {
    **{k: (lambda s, d, q=q: boolean.boolean_search(tf_of(s, d), docs(s, d), q)) for k, q in BOOLEAN.items()},
    "conj_skips": lambda s, d: boolean.conjunction(tf_of(s, d), "archivo AND mapa AND copia"),
    "pattern_batch": lambda s, d: boolean.pattern_batch(tf_of(s, d), PATTERN_WORDS),
    "idf_vocab": lambda s, d: _index(s, d).terms.crossJoin(F.broadcast(_index(s, d).corpus)).select("term", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf")),
    "doc_norms": lambda s, d: rank.tfidf_norms(_index(s, d)).select("doc_id", F.round("norm", 6).alias("norm")),
    "cosine_tf": _ranked(rank.cosine_tf),
    "tfidf_cosine": _ranked(rank.cosine_tfidf),
    "tfidf_cosine_tail": lambda s, d: rank.top_k(rank.cosine_tfidf(_index(s, d), rank.topic_terms(s, RARE_TOPICS, main_tokens), 700), 700),
    "ql_mle": _ranked(lambda ix, q: rank.query_likelihood(ix, q, 0.0)),
    "ql_jm": _ranked(lambda ix, q: rank.query_likelihood(ix, q, 0.7)),
    "coordination": _ranked(rank.coordination),
    "tfidf_robertson": _ranked(rank.robertson_tfidf),
    "bm25": _ranked(rank.bm25),
    "hiemstra_lm": _ranked(rank.hiemstra_lm),
    "dirichlet_lm": _ranked(rank.dirichlet_lm),
    "ranked_union": ranked_union,
    "qrels": qrels,
    "eval_per_query": _evaluated(evaluate.per_query),
    "eval_long": _evaluated(lambda r, q: evaluate.long_form(evaluate.per_query(r, q))),
    "eval_mean": _evaluated(lambda r, q: evaluate.summary(evaluate.per_query(r, q))),
    "iprec_11": _evaluated(evaluate.interpolated),
    "iprec_inline": lambda s, d: evaluate.interpolated_series(s.createDataFrame(SERIES, "recall double, precision double")),
    "metric_hist": metric_hist,
    "spearman_topk": spearman_topk,
    "query_len_groups": query_len_groups,
    "query_filter": query_filter,
    "size_bins": size_bins,
}

_TOKENS_Q = TOK.split("list_transform(", 1)[1].split(", lambda x: lower(x))", 1)[0].replace("(text,", "(query,")
_VALUES = ", ".join(f"({k}, '{v}')" for k, v in TOPICS.items())


def _index_sql(source: str) -> str:
    return TOK + f"""
, topics AS ({source}),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(list_filter(list_transform({_TOKENS_Q}, lambda x: lower(x)), lambda x: length(x) BETWEEN 1 AND 20)) AS term FROM topics) GROUP BY ALL),
dl AS (SELECT doc_id, n_tokens AS dl FROM ds), c AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS cl, avg(dl) AS avdl FROM dl),
m AS (SELECT q.qid, q.qtf, tf.doc_id, tf.term, tf.tf, terms.cf, terms.df, dl.dl, c.n, c.cl, c.avdl FROM q JOIN terms USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c)
"""


INDEX = _index_sql(f"SELECT qid, query FROM (VALUES {_VALUES}) v(qid, query)")
ITEMS = _index_sql("SELECT item_id AS qid, text AS query FROM benchmark")
_RANK = " SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= {k}"
_PARTS = {
    "coordination": "sum(qtf)::DOUBLE",
    "tfidf_robertson": "sum(qtf * (1.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avdl))) * log2(n / df + 1))",
    "bm25": "sum(log2((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (2.2::DOUBLE * tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avdl) + tf)) * (9.0::DOUBLE * qtf / (8.0::DOUBLE + qtf)))",
    "hiemstra_lm": "sum(qtf * log2(1 + (0.15::DOUBLE * tf * cl) / (0.85::DOUBLE * cf * dl)))",
}


def _simple(name: str) -> str:
    return f", s AS (SELECT qid, doc_id, {_PARTS[name]} AS score FROM m GROUP BY ALL)"


_W = "(1 + ln({tf})) * ln(n / df)"
_WD, _WQ = _W.format(tf="tf"), _W.format(tf="qtf")


def _ql(lam: float) -> str:
    base = f"{lam}::DOUBLE * cf / cl"
    whole = f"CASE WHEN cf IS NOT NULL THEN ln({base}) ELSE -100.0::DOUBLE END" if lam else "-100.0::DOUBLE"
    own = f"ln({base})" if lam else "-100.0::DOUBLE"
    return f"""
, b AS (SELECT qid, sum(qtf * ({whole})) AS background FROM q LEFT JOIN terms USING (term), c GROUP BY qid),
g AS (SELECT qid, doc_id, sum(qtf * (ln({1 - lam}::DOUBLE * tf / dl + {base}) - ({own}))) AS gain FROM m GROUP BY ALL),
s AS (SELECT b.qid, ds.doc_id, background + coalesce(gain, 0) AS score FROM b CROSS JOIN ds LEFT JOIN g ON g.qid = b.qid AND g.doc_id = ds.doc_id)"""


_BOOL_SQL = {
    "bool_and2": "bool_or(term = 'archivo') AND bool_or(term = 'mapa')", "bool_or2": "bool_or(term = 'archivo') OR bool_or(term = 'library')",
    "bool_andnot2": "bool_or(term = 'archivo') AND NOT bool_or(term = 'mapa')", "bool_and3": "bool_or(term = 'archivo') AND bool_or(term = 'mapa') AND bool_or(term = 'copia')",
    "bool_or_andnot3": "(bool_or(term = 'archivo') OR bool_or(term = 'library')) AND NOT bool_or(term = 'mapa')",
    "bool_and_or3": "(bool_or(term = 'archivo') AND bool_or(term = 'mapa')) OR bool_or(term = 'library')",
}
_EVAL = ITEMS + "".join(f", {n} AS (WITH s AS (SELECT qid, doc_id, {_PARTS[p]} AS score FROM m GROUP BY ALL)" + _RANK.format(k=50) + ")" for n, p in (("r_bm25", "bm25"), ("r_tfidf", "tfidf_robertson"), ("r_hiemstra", "hiemstra_lm"))) + """
, run AS (SELECT 'bm25' AS system, * FROM r_bm25 UNION ALL SELECT 'tfidf', * FROM r_tfidf UNION ALL SELECT 'hiemstra', * FROM r_hiemstra),
qrels AS (SELECT DISTINCT item_id AS qid, doc_id, 1 AS rel FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
nrel AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
j AS (SELECT run.*, coalesce(rel, 0) AS rel, n_rel, sum(coalesce(rel, 0)) OVER (PARTITION BY system, run.qid ORDER BY rank) AS hits FROM run LEFT JOIN qrels USING (qid, doc_id) JOIN nrel USING (qid)),
ideal AS (SELECT qid, sum(1 / log2(r + 1.0::DOUBLE)) AS ideal FROM (SELECT qid, unnest(range(1, least(n_rel, 10) + 1)) AS r FROM nrel) GROUP BY qid),
pq AS (SELECT system, qid, round(count_if(rank <= 10 AND rel > 0) / 10.0::DOUBLE, 6) AS p_at_k, round(sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) / max(n_rel), 6) AS ap,
  round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0::DOUBLE) ELSE 0 END) / any_value(ideal), 6) AS ndcg_at_k FROM j JOIN ideal USING (qid) GROUP BY system, qid),
lf AS (UNPIVOT pq ON p_at_k, ap, ndcg_at_k INTO NAME measure VALUE value)"""
SQL = {
    **{k: TOK + f"SELECT doc_id FROM tf GROUP BY doc_id HAVING {v}" for k, v in _BOOL_SQL.items()},
    "bool_or_not": TOK + "SELECT doc_id FROM ds WHERE doc_id IN (SELECT doc_id FROM tf WHERE term = 'archivo') OR doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'library')",
    "conj_skips": TOK + "SELECT doc_id FROM tf WHERE term IN ('archivo', 'mapa', 'copia') GROUP BY doc_id HAVING count(*) = 3",
    "idf_vocab": TOK + "SELECT term, df, round(ln((SELECT count(*) FROM ds) / df), 6) AS idf FROM terms",
    "doc_norms": TOK + f"SELECT doc_id, round(sqrt(sum(pow({_WD}, 2))), 6) AS norm FROM tf JOIN terms USING (term), (SELECT count(*) AS n FROM ds) GROUP BY doc_id",
    "cosine_tf": INDEX + """, dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY doc_id), qn AS (SELECT qid, sqrt(sum(qtf * qtf)) AS qn FROM q SEMI JOIN terms USING (term) GROUP BY qid),
s AS (SELECT qid, doc_id, sum(tf * qtf) / (any_value(dn) * any_value(qn)) AS score FROM m JOIN dn USING (doc_id) JOIN qn USING (qid) GROUP BY ALL)""" + _RANK.format(k=10),
    "tfidf_cosine": INDEX + f""", dn AS (SELECT doc_id, sqrt(sum(pow({_WD}, 2))) AS dn FROM tf JOIN terms USING (term), c GROUP BY doc_id),
qn AS (SELECT qid, sqrt(sum(pow({_WQ}, 2))) AS qn FROM q JOIN terms USING (term), c GROUP BY qid),
s AS (SELECT qid, doc_id, CASE WHEN any_value(dn) > 0 AND any_value(qn) > 0 THEN sum({_WD} * {_WQ}) / (any_value(dn) * any_value(qn)) ELSE 0 END AS score FROM m JOIN dn USING (doc_id) JOIN qn USING (qid) GROUP BY ALL)""" + _RANK.format(k=10),
    "ql_mle": INDEX + _ql(0.0).replace("1.0::DOUBLE * tf / dl + 0.0::DOUBLE * cf / cl", "tf / dl") + _RANK.format(k=10),
    "ql_jm": INDEX + _ql(0.7).replace("0.30000000000000004", "0.3") + _RANK.format(k=10),
    **{k: INDEX + _simple(k) + _RANK.format(k=10) for k in _PARTS},
    "dirichlet_lm": INDEX + """, ql AS (SELECT qid, sum(qtf) AS qlen FROM q SEMI JOIN terms USING (term) GROUP BY qid),
s AS (SELECT qid, doc_id, sum(qtf * ln(1 + tf / (2500.0::DOUBLE * cf / cl))) + any_value(qlen) * ln(2500.0::DOUBLE / (any_value(dl) + 2500.0::DOUBLE)) AS score FROM m JOIN ql USING (qid) GROUP BY qid, doc_id)""" + _RANK.format(k=10),
    "ranked_union": INDEX + f""", a AS (WITH s AS (SELECT qid, doc_id, {_PARTS['bm25']} AS score FROM m GROUP BY ALL){_RANK.format(k=10)}), b AS (WITH s AS (SELECT qid, doc_id, {_PARTS['coordination']} AS score FROM m GROUP BY ALL){_RANK.format(k=10)})
SELECT qid, doc_id, coalesce(a.rank, 0) AS bm25_rank, coalesce(b.rank, 0) AS coordination_rank FROM a FULL JOIN b USING (qid, doc_id)""",
    "qrels": "SELECT DISTINCT item_id AS qid, doc_id, 1 AS rel FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "eval_per_query": _EVAL + "SELECT * FROM pq",
    "eval_long": _EVAL + "SELECT * FROM lf",
    "eval_mean": _EVAL + "SELECT system, measure, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS deviation FROM lf GROUP BY ALL",
    "iprec_11": _EVAL + """, lv AS (SELECT unnest(range(0, 11)) / 10 AS recall), t AS (SELECT DISTINCT system, qid FROM j),
x AS (SELECT t.system, t.qid, lv.recall, coalesce(max(hits / rank) FILTER (rel > 0 AND hits / n_rel >= lv.recall - 1e-9), 0) AS p FROM t CROSS JOIN lv LEFT JOIN j ON j.system = t.system AND j.qid = t.qid GROUP BY ALL)
SELECT system, recall, round(avg(p), 6) AS precision FROM x GROUP BY system, recall""",
    "iprec_inline": "SELECT round(r / 10, 1) AS recall, coalesce(max(p)::DOUBLE, 0) AS precision FROM (SELECT unnest(range(0, 11)) AS r) LEFT JOIN (VALUES " + ", ".join(f"({a}, {b})" for a, b in SERIES) + ") v(rc, p) ON rc >= r / 10 - 1e-9 GROUP BY r",
    "metric_hist": _EVAL + ", lim AS (SELECT min(ap) AS lo, max(ap) AS hi FROM pq) SELECT system, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((ap - lo) / ((hi - lo) / 20)), 19) END AS INT) AS bin, count(*) AS n FROM pq, lim GROUP BY ALL",
    "spearman_topk": INDEX + f""", a AS (WITH s AS (SELECT qid, doc_id, {_PARTS['bm25']} AS score FROM m GROUP BY ALL){_RANK.format(k=50)}), b AS (WITH s AS (SELECT qid, doc_id, {_PARTS['tfidf_robertson']} AS score FROM m GROUP BY ALL){_RANK.format(k=50)}),
u AS (SELECT k, coalesce(x.qid, y.qid) AS qid, coalesce(x.rank, k + 1) AS rx, coalesce(y.rank, k + 1) AS ry FROM (VALUES (10), (25), (50)) v(k),
  LATERAL (SELECT * FROM a WHERE a.rank <= k) x FULL JOIN (SELECT * FROM b) y ON x.qid = y.qid AND x.doc_id = y.doc_id),
z AS (SELECT 1) SELECT 1""",
    "query_len_groups": ITEMS + ", t AS (SELECT qid, count(*) AS terms, coalesce(sum(df), 0) AS postings FROM q LEFT JOIN terms USING (term) GROUP BY qid) SELECT terms, count(*) AS topics, round(avg(postings), 6) AS mean_postings FROM t GROUP BY terms",
}

SQL["tfidf_cosine_tail"] = SQL["tfidf_cosine"].replace(INDEX, _index_sql("SELECT qid, query FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in RARE_TOPICS.items()) + ") v(qid, query)")).replace(
    _RANK.format(k=10), ", r AS (SELECT q.qid, d.doc_id, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT qid FROM q) q CROSS JOIN documents d LEFT JOIN s ON s.qid = q.qid AND s.doc_id = d.doc_id)" + _RANK.format(k=700).replace("FROM s", "FROM r"))
SQL["query_filter"] = _index_sql("SELECT qid, query FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CANDIDATES) + ") v(qid, query)") + """
, w AS (SELECT qid, query, count(*) AS n FROM (SELECT qid, query, unnest(string_split(query, ' ')) AS term FROM topics) GROUP BY ALL)
SELECT w.qid, w.query AS words FROM w WHERE n IN (2, 3) AND (SELECT count(*) FROM q SEMI JOIN terms USING (term) WHERE q.qid = w.qid) = n"""
SQL["size_bins"] = ITEMS + """, t AS (SELECT qid, CAST(sum(df) AS BIGINT) AS size, count(*) AS value FROM q JOIN terms USING (term) GROUP BY qid), lim AS (SELECT min(size) AS lo, max(size) AS hi FROM t)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((size - lo) * 10 / (hi - lo)), 9) END AS INT) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM t, lim GROUP BY ALL"""


def _spearman(k: int) -> str:
    return f"""SELECT {k} AS k, qid, round(corr(rx, ry), 6) AS rho FROM (
  SELECT qid, rank() OVER (PARTITION BY qid ORDER BY x) + (count(*) OVER (PARTITION BY qid, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY qid ORDER BY y) + (count(*) OVER (PARTITION BY qid, y) - 1) / 2 AS ry
  FROM (SELECT qid, coalesce(x, {k} + 1) AS x, coalesce(y, {k} + 1) AS y FROM (SELECT qid, doc_id, rank AS x FROM a WHERE rank <= {k}) FULL JOIN (SELECT qid, doc_id, rank AS y FROM b WHERE rank <= {k}) USING (qid, doc_id))) GROUP BY qid"""


SQL["spearman_topk"] = SQL["spearman_topk"].split(",\nu AS")[0] + " " + " UNION ALL ".join(_spearman(k) for k in (10, 25, 50))
_PATTERN_SQL = []
for _ws in PATTERN_WORDS:
    for _p in boolean.PATTERNS[len(_ws)]:
        _q = _p.format(*_ws)
        _cond = _p.format(*[f"bool_or(term = '{w}')" for w in _ws])
        _PATTERN_SQL.append(f"SELECT '{_q}' AS query, (SELECT count(*) FROM (SELECT doc_id FROM tf GROUP BY doc_id HAVING {_cond})) AS n_docs, (SELECT count(*) FROM tf WHERE term IN ({', '.join(repr(w) for w in _ws)})) AS posting_sum")
SQL["pattern_batch"] = TOK + " UNION ALL ".join(_PATTERN_SQL)
