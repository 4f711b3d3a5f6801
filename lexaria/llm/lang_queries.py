"""Queries on languages (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.langid import identify, label_code, train_profiles
from lexaria.session import table


def _identified(spark: SparkSession, d: str) -> DataFrame:
    profiles = train_profiles(table(spark, d, "muestra_idioma"), "idioma", "texto")
    docs = table(spark, d, "documento").where("doc_id IS NOT NULL")
    # the label travels with the id, so that the texts needn't be joined back
    tagged = docs.select(F.struct("doc_id", label_code(F.col("idioma")).alias("label")).alias("key"), "texto")
    tagged = tagged.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("key"), "texto")
    found = identify(tagged, "key", "texto", profiles).withColumn("key", F.from_json("key", "doc_id bigint, label string"))
    return found.select("key.doc_id", "key.label", "seg", "lang", F.round("confidence", 6).alias("confidence"), "letters", "mixed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The language of every wrongly or not labelled text (seg -1), and of each paragraph of texts in several languages."""
    rows = _identified(spark, d).where("lang IS NOT NULL")
    wrong = (F.col("seg") == -1) & ~F.col("label").eqNullSafe(F.col("lang"))
    return rows.where(wrong | ((F.col("seg") >= 0) & F.col("mixed"))).select("doc_id", "seg", F.col("lang").alias("idioma")).distinct()


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every text and every paragraph."""
    return _identified(spark, d).select("doc_id", "seg", F.col("lang").alias("idioma"), "confidence", "mixed").distinct()


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
SQL: dict[str, str] = {}
