"""How characteristic each term is of each record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def log_odds_z(tf: Column, dl: Column, cf: Column, total: float, prior: float) -> Column:
    """z-score of the log-odds ratio of record against rest, with a Dirichlet prior of mass ``prior`` spread as the collection's counts."""
    a = cf * (prior / total)
    rest, rest_n = cf - tf, F.lit(float(total)) - dl
    own = F.ln((tf + a) / (dl + prior - tf - a))
    other = F.ln((rest + a) / (rest_n + prior - rest - a))
    return (own - other) / F.sqrt(1 / (tf + a) + 1 / (rest + a))


def distinctive_terms(counts: DataFrame, names: DataFrame, n_docs: int, *, k: int | None = 3, score: str = "log_odds", min_df: int = 1, prior: float = 1000.0, digits: int = 6) -> DataFrame:
    """(doc_id, termino, tf, df, cf, score): the ``k`` terms with the highest score of each record (``None``: all terms).

    ``counts`` is (canon, doc_id, tf), a row per pair; ``names`` is (canon, termino); ``n_docs`` the number of records. ``score``:

    * ``log_odds``: log-odds ratio of the record versus the rest of the collection with an informative Dirichlet prior from the
      collection's counts (mass ``prior``), divided by its standard error. A collection of a single record scores NULL-free but
      without contrast: rest counts are zero and only the prior remains.
    * ``tfidf``: (1 + ln tf) * ln(n_docs / df), for callers that need that ranking.

    Scores are rounded to ``digits``; ties go by term in code-point order. Terms in fewer than ``min_df`` records, without a name,
    or with a NULL tf give no row. Empty inputs give an empty result.

    Counts per term are combined in the map tasks and joined to the pairs on the term; the join is left to the engine, which splits
    a hot term's partition. The top k are cut within each map task before the records are gathered, so a record with a third of
    all rows sends k rows per task.
    """
    counts = counts.where("tf IS NOT NULL")
    terms = counts.groupBy("canon").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).join(names, "canon")
    rows = counts.join(terms, "canon")
    if score == "tfidf":
        value = (1 + F.ln(F.col("tf").cast("double"))) * F.ln(F.lit(float(n_docs)) / F.col("df"))
    elif score == "log_odds":
        lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
        total = counts.agg(F.sum("tf")).first()[0] or 1
        rows = rows.join(lengths, "doc_id")
        value = log_odds_z(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("cf").cast("double"), float(total), float(prior))
    else:
        raise ValueError("score must be log_odds or tfidf")
    rows = rows.select("doc_id", "termino", "tf", "df", "cf", F.round(value, digits).alias("score"))
    if k is None:
        return rows
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("termino"))
    return rows.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
