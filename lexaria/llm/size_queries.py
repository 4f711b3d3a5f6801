"""Queries on sizes in tokens: containers (p8) and pieces (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexaria.llm.packing import pack_containers
from lexaria.llm.splitting import split_texts
from lexaria.llm.tokens import TOKENIZER, token_sizes
from lexaria.session import table


def _tokenizer(spark: SparkSession) -> str:
    """The vocabulary file that the session names, else the default one."""
    return spark.conf.get("spark.lexaria.tokenizer", TOKENIZER)


def limit_of(spark: SparkSession, d: str, use: str) -> tuple[int, int]:
    """Size and overlap in tokens of the two-row table of limits."""
    row = table(spark, d, "limites").where(F.col("uso") == use).agg(F.max("max_tokens"), F.max("solape")).first()
    return int(row[0]), int(row[1] or 0)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text of the corpus, or of every part of a text bigger than a container."""
    capacity, _ = limit_of(spark, d, "contenedor")
    docs = table(spark, d, "documents")
    return pack_containers(token_sizes(docs, "doc_id", "text", _tokenizer(spark)), "doc_id", "n_tokens", capacity, n_items=docs.count())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the packing had to divide."""
    return p8_containers(spark, d).where("part > 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text of the corpus."""
    limit, overlap = limit_of(spark, d, "fragmento")
    return split_texts(table(spark, d, "documents"), "doc_id", "text", limit, overlap, path=_tokenizer(spark))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut."""
    return p10_pieces(spark, d).where("pieces > 1").select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers, "p10_found": p10_found, "p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
