"""Clean postings: the latest valid revision of each partial posting, keyed by canonical term."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lexaria.session import broadcast_if_small

#: Most alias rows that are broadcast: two BIGINT columns, so some 32 MB. Above it the join shuffles.
MAX_ALIASES = 1_000_000


@F.pandas_udf(T.StringType())
def term_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode form NFC, trimmed of spaces, in lower case; NULL stays NULL."""
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip(" ").lower())


def term_names(terminos: DataFrame) -> DataFrame:
    """(term_id, termino): one row per term_id. Rows with a NULL in either column are dropped; a term_id with several terms takes the smallest in code-point order."""
    named = terminos.select("term_id", "termino").where("term_id IS NOT NULL AND termino IS NOT NULL").distinct()
    return named.select("term_id", term_form("termino").alias("termino")).groupBy("term_id").agg(F.min("termino").alias("termino"))


def canonical_terms(terminos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canon, termino) with the smallest term_id of each term, and (alias, canon) for every other term_id."""
    ranked = term_names(terminos).withColumn("canon", F.min("term_id").over(Window.partitionBy("termino")))
    return ranked.where("term_id = canon").select("canon", "termino"), ranked.where("term_id <> canon").select(F.col("term_id").alias("alias"), "canon")


def clean_postings(postings: DataFrame, terminos: DataFrame | None = None) -> DataFrame:
    """(canon, doc_id, bloque, freq): clean postings.

    Rows with ``freq`` NULL or below 1, or with NULL ``term_id`` or ``doc_id``, are dropped. Per (bloque, term_id, doc_id) the
    row with the latest ``cargado_en`` is kept (NULL is the earliest; of equal times the largest ``freq``). A NULL ``bloque`` is a
    block of its own. With ``terminos``, ``canon`` is the smallest term_id of the same term; a term_id that has no name is its own.

    One shuffle, on (canon, doc_id): a pair has at most a few rows per block, so neither a term that occurs in every document nor
    a document that holds a third of the rows gathers in one task. Everything that groups by these two needs no further shuffle.
    """
    rows = postings.select("bloque", "term_id", "doc_id", "freq", "cargado_en").where("freq >= 1 AND term_id IS NOT NULL AND doc_id IS NOT NULL")
    if terminos is not None:
        aliases = broadcast_if_small(canonical_terms(terminos)[1], MAX_ALIASES)
        rows = rows.join(aliases, F.col("term_id") == F.col("alias"), "left").withColumn("canon", F.coalesce("canon", "term_id")).drop("alias")
    else:
        rows = rows.withColumn("canon", F.col("term_id"))
    n = max(1, int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("at", F.coalesce(F.unix_micros(F.col("cargado_en").cast("timestamp")), F.lit(-(2**62)))).drop("cargado_en")
    # the term_id only tells aliases apart: NULL where it is the canonical one, which packs well
    rows = rows.withColumn("term_id", F.nullif("term_id", "canon")).repartition(n, "canon", "doc_id")
    keys = ["canon", "doc_id", "bloque", "term_id"]
    return rows.groupBy(*keys, "at").agg(F.max("freq").alias("freq")).groupBy(*keys).agg(F.max_by("freq", "at").alias("freq")).drop("term_id")


def term_doc_counts(clean: DataFrame) -> DataFrame:
    """(canon, doc_id, tf) over all blocks; needs no shuffle after ``clean_postings``."""
    return clean.groupBy("canon", "doc_id").agg(F.sum("freq").cast("long").alias("tf"))


def n_documents(postings: DataFrame) -> int:
    """Distinct doc_id of the clean postings: those with a valid row, as each key with one keeps one."""
    return postings.where("freq >= 1 AND term_id IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().count()
