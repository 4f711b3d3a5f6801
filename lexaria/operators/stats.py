"""Collection statistics and the laws of Zipf and Heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexaria.operators.order import ordered
from lexaria.session import broadcast_if_small


def term_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, term, tf) of ``docs`` (doc_id, ...)."""
    return docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def without_terms(tf: DataFrame, words: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``tf`` without the terms of a list (term), of any size: a list of at most ``max_rows`` words is broadcast, a longer one shuffled. NULL words take nothing away."""
    return tf.join(broadcast_if_small(words.select("term").where("term IS NOT NULL").distinct(), max_rows), "term", "left_anti").select(*tf.columns)


def term_stats(tf: DataFrame) -> DataFrame:
    """(term, cf, df)."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def doc_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, n_tokens, n_terms), documents without tokens included; no shuffle."""
    return docs.select("doc_id", F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.array_distinct(tokens)), F.lit(0)).cast("long").alias("n_terms"))


def collection_stats(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, terms, averages (terms per document both as vocabulary / N and as the mean of each document's), mean term length, terms with cf 1."""
    t = terms.agg(F.count(F.lit(1)).alias("n_terms"), F.avg(F.length("term").cast("double")).alias("mean_term_length"), F.count_if(F.col("cf") == 1).alias("hapax"))
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.avg("n_tokens").alias("mean_tokens"), F.avg("n_terms").alias("mean_doc_terms"))
    both = d.crossJoin(F.broadcast(t))
    return both.select(
        "n_docs", "n_tokens", "n_terms", F.round("mean_tokens", 6).alias("mean_tokens"), F.round(F.try_divide(F.col("n_terms"), F.col("n_docs")), 6).alias("vocab_per_doc"),
        F.round("mean_doc_terms", 6).alias("mean_doc_terms"), F.round("mean_term_length", 6).alias("mean_term_length"), "hapax",
    )


def doc_extremes(docs: DataFrame) -> DataFrame:
    """Shortest and longest document by tokens, the smallest id on ties, with its terms."""
    low = F.min_by(F.struct("doc_id", "n_tokens", "n_terms"), F.struct("n_tokens", "doc_id")).alias("s")
    high = F.max_by(F.struct("doc_id", "n_tokens", "n_terms"), F.struct(F.col("n_tokens"), (-F.col("doc_id")))).alias("s")
    return docs.agg(low).select(F.lit("shortest").alias("which"), "s.*").unionAll(docs.agg(high).select(F.lit("longest").alias("which"), "s.*"))


def zipf_ranks(terms: DataFrame) -> DataFrame:
    """(rank, term, cf) by falling frequency, ties by term."""
    return ordered(terms.select("term", "cf"), [F.col("cf").desc(), F.col("term")], position="rank")


def zipf_fit(ranks: DataFrame) -> DataFrame:
    """Least-squares line ln cf = intercept + slope ln rank."""
    x, y = F.ln(F.col("rank").cast("double")), F.ln(F.col("cf").cast("double"))
    return ranks.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def zipf_mass(ranks: DataFrame, fit: DataFrame, shares=(0.1, 0.2, 0.3)) -> DataFrame:
    """Tokens that the fitted law and the collection hold in the top share of the vocabulary."""
    j = ranks.crossJoin(F.broadcast(fit))
    guess = F.exp("intercept") * F.pow(F.col("rank").cast("double"), F.col("slope"))
    wide = j.agg(*[x for k, p in enumerate(shares) for x in (F.sum(F.when(F.col("rank") <= F.floor(F.col("n") * p), guess)).alias(f"e{k}"), F.sum(F.when(F.col("rank") <= F.floor(F.col("n") * p), F.col("cf"))).alias(f"r{k}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(p).alias("share"), F.round(f"e{k}", 3).alias("estimated"), F.col(f"r{k}").alias("real")) for k, p in enumerate(shares)])))


def vocab_prune(ranks: DataFrame, n_terms: int, stop_words: list[str], shares=(0.1, 0.2, 0.3)) -> DataFrame:
    """For each top share: terms pruned, how many of them aren't stop words, and their percentage."""
    cuts = [(p, int(n_terms * p)) for p in shares]
    content = ~F.col("term").isin(stop_words)
    wide = ranks.where(F.col("rank") <= max(n for _, n in cuts)).agg(*[F.count_if((F.col("rank") <= n) & content).alias(f"c{k}") for k, (_, n) in enumerate(cuts)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("share"), F.lit(n).cast("long").alias("pruned"), F.col(f"c{k}").alias("content_terms"), F.round(F.col(f"c{k}") * 100.0 / max(1, n), 4).alias("content_percent")) for k, (p, n) in enumerate(cuts)
    ])))


def heaps_pairs(docs: DataFrame, tokens: Column, step: int = 100) -> DataFrame:
    """(n, v): tokens and distinct terms read so far, in order of doc_id, after each document in which n passes a multiple of ``step``, and at the end."""
    first = docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("term").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_terms"))
    lengths = docs.select("doc_id", F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("own"))
    rows = lengths.groupBy("doc_id").agg(F.sum("own").alias("own")).join(first, "doc_id", "left").withColumn("new_terms", F.coalesce("new_terms", F.lit(0)))
    run = ordered(rows, [F.col("doc_id")], position=None, sums={"n": F.col("own"), "v": F.col("new_terms")})
    kept = run.where((F.col("n") % step) < F.col("own")).select("n", "v")
    last = run.agg(F.max("n").alias("n"), F.max("v").alias("v")).where("n > 0")
    return kept.unionAll(last).distinct()


def heaps_fit(pairs: DataFrame) -> DataFrame:
    """Least-squares line ln v = intercept + slope ln n."""
    x, y = F.ln(F.col("n").cast("double")), F.ln(F.col("v").cast("double"))
    return pairs.where("n > 0 AND v > 0").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))
