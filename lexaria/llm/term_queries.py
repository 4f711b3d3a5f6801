"""Queries on the postings: distinctive terms (p1) and frequencies of every term (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.distinctive import distinctive_terms
from lexaria.llm.frequency import mark_useless, ngram_frequencies
from lexaria.llm.postings import canonical_terms, clean_postings, n_documents, term_doc_counts
from lexaria.session import stored, table


def _counts(spark: SparkSession, d: str):
    postings, terminos = table(spark, d, "postings"), table(spark, d, "terminos")
    # stored, as both the counts per term and the scores read them
    return stored(term_doc_counts(clean_postings(postings, terminos))), canonical_terms(terminos)[0], n_documents(postings)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The three most distinctive terms of each document, by the ranking that the data's description fixes."""
    counts, names, n = _counts(spark, d)
    return distinctive_terms(counts, names, n, k=3, score="tfidf", min_df=2).select("doc_id", "termino")


def p1_log_odds(spark: SparkSession, d: str) -> DataFrame:
    """The three terms of each document with the highest log-odds z-score."""
    counts, names, n = _counts(spark, d)
    return distinctive_terms(counts, names, n, k=3, score="log_odds", min_df=2).select("doc_id", "termino", "tf", "score")


def _term_frequencies(clean: DataFrame) -> DataFrame:
    """(canon, cf, df) of every term, by suffix-sorted counting over the term of each posting. The clean postings are spread by term and document already."""
    seq = term_doc_counts(clean).select("doc_id", F.array("canon").alias("t"), "tf")
    return ngram_frequencies(seq, "doc_id", "t", max_n=1, weight_col="tf", routed=True).select(F.col("gram")[0].alias("canon"), "cf", "df")


def _blocks(clean: DataFrame, published: DataFrame) -> DataFrame:
    """Published and true number of terms whose frequency within the block is 1, for each published block."""
    published = published.where("bloque IS NOT NULL").groupBy("bloque").agg(
        F.max("terminos_una_vez").alias("publicado"), F.min("terminos_una_vez").alias("menor"), F.count("terminos_una_vez").alias("n"), F.count(F.lit(1)).alias("filas"))
    true = clean.groupBy("bloque", "canon").agg(F.sum("freq").alias("f")).where("f = 1").groupBy("bloque").agg(F.count(F.lit(1)).alias("una_vez"))
    # a null-safe join, as it adds no filter below the shuffle of the clean postings, which the counts per term use, too
    true = true.withColumnRenamed("bloque", "b")
    return published.join(true, published["bloque"].eqNullSafe(true["b"]), "left").withColumn("una_vez", F.coalesce("una_vez", F.lit(0)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Too rare and too common terms, and blocks whose published count of singletons can't be trusted."""
    terminos = table(spark, d, "terminos")
    clean = clean_postings(table(spark, d, "postings"), terminos)
    freqs = mark_useless(_term_frequencies(clean), n_documents(table(spark, d, "postings")))
    names = canonical_terms(terminos)[0]
    terms = freqs.where("marca IS NOT NULL").join(names, "canon").select("marca", F.col("termino").alias("clave"))
    blocks = _blocks(clean, table(spark, d, "estadisticas")).where("n < filas OR publicado <> una_vez OR menor <> una_vez")
    return terms.unionAll(blocks.select(F.lit("bloque").alias("marca"), F.col("bloque").cast("string").alias("clave"))).distinct()


def p5_term_trust(spark: SparkSession, d: str) -> DataFrame:
    """Every published term row with the true counts of its term and whether the published ones agree (-1: none published)."""
    published = table(spark, d, "terminos").where("term_id IS NOT NULL").select("term_id", F.col("cf").alias("cf_pub"), F.col("df").alias("df_pub")).distinct()
    names = canonical_terms(table(spark, d, "terminos"))
    canon = names[1].withColumnRenamed("alias", "term_id")
    clean = clean_postings(table(spark, d, "postings"), table(spark, d, "terminos"))
    freqs = mark_useless(_term_frequencies(clean), n_documents(table(spark, d, "postings")))
    rows = published.join(canon, "term_id", "left").withColumn("canon", F.coalesce("canon", "term_id"))
    return rows.join(freqs, "canon", "left").select(
        "term_id", F.coalesce("cf_pub", F.lit(-1)).alias("cf_pub"), F.coalesce("df_pub", F.lit(-1)).alias("df_pub"), F.coalesce("cf", F.lit(0)).alias("cf"), F.coalesce("df", F.lit(0)).alias("df"), "marca",
        F.coalesce(F.col("cf_pub") == F.coalesce("cf", F.lit(0)), F.lit(False)).alias("cf_ok"), F.coalesce(F.col("df_pub") == F.coalesce("df", F.lit(0)), F.lit(False)).alias("df_ok"),
    )


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Count and document count of every run of one to three words of the corpus that occurs in at least 3 documents."""
    words = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    return ngram_frequencies(words, "doc_id", "w", max_n=3).where("df >= 3").select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n"), "cf", "df")


QUERIES = {"p1_found": p1_found, "p1_log_odds": p1_log_odds, "p5_found": p5_found, "p5_term_trust": p5_term_trust, "p5_ngrams": p5_ngrams}

CLEAN = """
WITH t0 AS (SELECT term_id, min(lower(trim(nfc_normalize(termino), ' '))) AS termino FROM terminos WHERE term_id IS NOT NULL AND termino IS NOT NULL GROUP BY term_id),
names AS (SELECT termino, min(term_id) AS canon FROM t0 GROUP BY termino),
mapped AS (SELECT t0.term_id, canon FROM t0 JOIN names ON t0.termino = names.termino),
clean AS (
  SELECT coalesce(m.canon, p.term_id) AS canon, p.doc_id, p.bloque, p.freq
  FROM (SELECT bloque, term_id, doc_id, arg_max(freq, cargado_en) AS freq FROM postings WHERE freq >= 1 GROUP BY bloque, term_id, doc_id) p
  LEFT JOIN mapped m ON p.term_id = m.term_id),
tf AS (SELECT canon, doc_id, CAST(sum(freq) AS BIGINT) AS tf FROM clean GROUP BY canon, doc_id),
n AS (SELECT count(DISTINCT doc_id) AS n FROM clean),
freqs AS (SELECT canon, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY canon)
"""

SQL = {
    "p1_found": CLEAN + """
, s AS (SELECT doc_id, termino, round((1 + ln(tf)) * ln(n.n / df), 6) AS score FROM tf JOIN freqs USING (canon) JOIN names USING (canon), n WHERE df >= 2)
SELECT doc_id, termino FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, termino) <= 3""",
    "p1_log_odds": CLEAN + """
, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), c AS (SELECT CAST(sum(tf) AS DOUBLE) AS c FROM tf),
s AS (SELECT doc_id, termino, tf, round((ln((tf + cf * (1000.0 / c)) / (dl + 1000.0 - tf - cf * (1000.0 / c)))
    - ln((cf - tf + cf * (1000.0 / c)) / (c - dl + 1000.0 - (cf - tf) - cf * (1000.0 / c))))
    / sqrt(1 / (tf + cf * (1000.0 / c)) + 1 / (cf - tf + cf * (1000.0 / c))), 6) AS score
  FROM tf JOIN freqs USING (canon) JOIN names USING (canon) JOIN dl USING (doc_id), c WHERE df >= 2)
SELECT doc_id, termino, tf, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, termino) <= 3""",
    "p5_found": CLEAN + """
, una AS (SELECT bloque, count(*) AS una_vez FROM (SELECT bloque, canon FROM clean GROUP BY bloque, canon HAVING sum(freq) = 1) GROUP BY bloque)
SELECT DISTINCT * FROM (
SELECT CASE WHEN cf = 1 THEN 'raro' ELSE 'comun' END AS marca, termino AS clave FROM freqs JOIN names USING (canon), n WHERE cf = 1 OR df > 0.5 * n.n
UNION ALL SELECT 'bloque', CAST(e.bloque AS VARCHAR) FROM estadisticas e LEFT JOIN una ON e.bloque = una.bloque
WHERE e.bloque IS NOT NULL AND (terminos_una_vez IS NULL OR terminos_una_vez <> coalesce(una_vez, 0)))""",
    "p5_term_trust": CLEAN + """
SELECT DISTINCT t.term_id, coalesce(t.cf, -1) AS cf_pub, coalesce(t.df, -1) AS df_pub, coalesce(f.cf, 0) AS cf, coalesce(f.df, 0) AS df,
  CASE WHEN f.cf <= 1 THEN 'raro' WHEN f.df > 0.5 * n.n THEN 'comun' END AS marca,
  coalesce(t.cf = coalesce(f.cf, 0), false) AS cf_ok, coalesce(t.df = coalesce(f.df, 0), false) AS df_ok
FROM terminos t LEFT JOIN mapped m ON t.term_id = m.term_id LEFT JOIN freqs f ON coalesce(m.canon, t.term_id) = f.canon, n WHERE t.term_id IS NOT NULL""",
    "p5_ngrams": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM w, (VALUES (1), (2), (3)) v(n))
SELECT gram, CAST(n AS INT) AS n, count(*) AS cf, count(DISTINCT doc_id) AS df FROM g GROUP BY gram, n HAVING count(DISTINCT doc_id) >= 3""",
}
