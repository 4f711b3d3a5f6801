"""Queries on page texts (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.boilerplate import page_lines
from lexaria.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(id, host, text): every text with a page, the host from the page's smallest address; the same text of one id once."""
    urls = table(spark, d, "pagetask").where("id IS NOT NULL AND url IS NOT NULL").groupBy("id").agg(F.min("url").alias("url"))
    host = F.regexp_extract(F.lower("url"), r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    urls = urls.select(F.col("id").alias("page_id"), F.when(host != "", host).alias("host"))
    docs = table(spark, d, "documento").where("doc_id IS NOT NULL AND page_id IS NOT NULL AND texto IS NOT NULL").select("doc_id", "page_id", "texto")
    return docs.join(urls, "page_id", "left").select(F.col("doc_id").alias("id"), "host", F.col("texto").alias("text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that aren't the page's title, headings or body."""
    return page_lines(_pages(spark, d)).where("boilerplate").select(F.col("id").alias("doc_id"), F.col("line").alias("linea")).distinct()


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every page with the judgement on it."""
    return page_lines(_pages(spark, d)).select(F.col("id").alias("doc_id"), F.col("line").alias("linea"), "boilerplate").distinct()


QUERIES = {"p4_found": p4_found, "p4_lines": p4_lines}
SQL: dict[str, str] = {}
