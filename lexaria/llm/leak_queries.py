"""Queries on leaked evaluation items (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaria.llm.leaks import find_leaks
from lexaria.session import table


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document that leaks an item, with the item's distinct runs and those found."""
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text").select("doc_id", "item_id", "runs", "shared")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}

_RUNS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(nfc_normalize(strip_accents(lower(text))), '\p{M}', '', 'g'), '[\p{L}\p{N}]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM d),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(nfc_normalize(strip_accents(lower(text))), '\p{M}', '', 'g'), '[\p{L}\p{N}]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM b),
n AS (SELECT item_id, CAST(count(*) AS INT) AS runs FROM bg GROUP BY item_id),
leaks AS (SELECT doc_id, item_id, runs, CAST(count(*) AS INT) AS shared FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, runs HAVING count(*) >= 0.4 * runs)
"""
SQL = {"p9_found": _RUNS + "SELECT doc_id, item_id FROM leaks", "p9_leaks": _RUNS + "SELECT doc_id, item_id, runs, shared FROM leaks"}
