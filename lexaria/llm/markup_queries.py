"""Queries on markup (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.markup import clean_markup
from lexaria.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """(id, host, text); only texts with a page are joined with the addresses."""
    urls = table(spark, d, "pagetask").where("id IS NOT NULL AND url IS NOT NULL").groupBy("id").agg(F.min("url").alias("url"))
    host = F.regexp_extract(F.lower("url"), r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    urls = urls.select(F.col("id").alias("page_id"), F.when(host != "", host).alias("host"))
    docs = table(spark, d, "documento").select(F.col("doc_id").alias("id"), "page_id", F.col("texto").alias("text"))
    on_web = docs.where("page_id IS NOT NULL").join(urls, "page_id", "left").select("id", "host", "text")
    return on_web.unionAll(docs.where("page_id IS NULL").select("id", F.lit(None).cast("string").alias("host"), "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Markups of each text, and its headings, items, code blocks and formulas."""
    rows = clean_markup(_docs(spark, d), with_text=False)
    parts = F.concat(
        F.transform("syntaxes", lambda s: F.struct(F.lit("syntax").alias("kind"), s.alias("content"))),
        F.zip_with("kinds", "contents", lambda k, c: F.struct(k.alias("kind"), c.alias("content"))),
    )
    return rows.select(F.col("id").alias("doc_id"), F.inline(parts).alias("kind", "content")).distinct()


def p3_clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text without markup."""
    return clean_markup(_docs(spark, d)).select(F.col("id").alias("doc_id"), F.array_join("syntaxes", ",").alias("syntaxes"), "clean_text").distinct()


QUERIES = {"p3_found": p3_found, "p3_clean_texts": p3_clean_texts}
SQL: dict[str, str] = {}
