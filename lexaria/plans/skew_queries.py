"""Queries on keys that hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.operators.skew import eager_join_aggregate, heavy_keys, own_figure
from lexaria.session import table


def doc_totals(spark: SparkSession, d: str) -> DataFrame:
    return eager_join_aggregate(
        table(spark, d, "postings").select("doc_id", "freq"), table(spark, d, "documento").select("doc_id"), ["doc_id"], left_sums={"freq": F.col("freq").cast("long")}, how="left"
    )


def term_totals(spark: SparkSession, d: str) -> DataFrame:
    return eager_join_aggregate(table(spark, d, "vocab").select("term_id", "df"), table(spark, d, "terminos").select("term_id", "cf"), ["term_id"], left_sums={"df": F.col("df")}, right_sums={"cf": F.col("cf")}, how="left")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id with at least 1 % of the rows of postings, term_id with at least 0.5 % of the sum of vocab.df; both from the joined states of the totals."""
    docs = heavy_keys(doc_totals(spark, d), "doc_id", own_figure("rows"), 0.01).select(F.lit("doc_id").alias("campo"), F.col("doc_id").alias("clave"))
    terms = heavy_keys(term_totals(spark, d), "term_id", own_figure("df"), 0.005).select(F.lit("term_id").alias("campo"), F.col("term_id").alias("clave"))
    return docs.unionAll(terms)


def p6_doc_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per document: rows and frequency of its postings, and of postings joined with documento as delivered."""
    return doc_totals(spark, d).select("doc_id", "l_rows", "r_rows", "joined_rows", "l_freq", "joined_l_freq")


def p6_term_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per term: rows and df of the lexicons, and of vocab joined with terminos as delivered."""
    return term_totals(spark, d).select("term_id", "l_rows", "r_rows", "joined_rows", "l_df", "joined_l_df", "joined_r_cf")


QUERIES = {"p6_found": p6_found, "p6_doc_totals": p6_doc_totals, "p6_term_totals": p6_term_totals}

SQL = {
    "p6_found": """
SELECT 'doc_id' AS campo, doc_id AS clave FROM postings WHERE doc_id IS NOT NULL GROUP BY doc_id
HAVING count(*) >= 0.01 * (SELECT count(*) FROM postings)
UNION ALL
SELECT 'term_id', term_id FROM vocab WHERE term_id IS NOT NULL GROUP BY term_id
HAVING coalesce(sum(df), 0) >= 0.005 * (SELECT sum(df) FROM vocab)""",
    "p6_doc_totals": """
WITH j AS (
  SELECT p.doc_id, p.freq, d.n FROM postings p LEFT JOIN (SELECT doc_id, count(*) AS n FROM documento GROUP BY doc_id) d ON p.doc_id = d.doc_id)
SELECT doc_id, count(*) AS l_rows, coalesce(any_value(n), 0) AS r_rows, CAST(sum(coalesce(n, 1)) AS BIGINT) AS joined_rows,
  CAST(coalesce(sum(freq), 0) AS BIGINT) AS l_freq, CAST(coalesce(sum(freq * coalesce(n, 1)), 0) AS BIGINT) AS joined_l_freq
FROM j GROUP BY doc_id""",
    "p6_term_totals": """
WITH l AS (SELECT term_id, count(*) AS l_rows, coalesce(sum(df), 0) AS l_df FROM vocab GROUP BY term_id),
j AS (SELECT v.term_id, v.df, t.cf, t.term_id AS hit FROM vocab v LEFT JOIN terminos t ON v.term_id = t.term_id)
SELECT l.term_id, l_rows, CAST(count(hit) / l_rows AS BIGINT) AS r_rows, count(*) AS joined_rows, CAST(l_df AS BIGINT) AS l_df,
  CAST(coalesce(sum(j.df), 0) AS BIGINT) AS joined_l_df, CAST(coalesce(sum(j.cf), 0) AS BIGINT) AS joined_r_cf
FROM l JOIN j ON l.term_id IS NOT DISTINCT FROM j.term_id GROUP BY l.term_id, l_rows, l_df""",
}
