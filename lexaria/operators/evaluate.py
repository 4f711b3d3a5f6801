"""Evaluation of ranked results against judgements, and comparison of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

def _by_rank():
    return Window.partitionBy("system", "qid").orderBy("rank")



def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` (system, qid, doc_id, score, rank) with ``rel`` (0 if unjudged) and ``n_rel`` of its topic."""
    total = qrels.where("rel > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return run.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).join(total, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, cut: int = 10) -> DataFrame:
    """(system, qid, p_at_k, ap, ndcg_at_k) of each judged topic; topics without a relevant document are left out."""
    j = judged(run, qrels).where("n_rel > 0")
    j = j.withColumn("hits", F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(_by_rank().rowsBetween(Window.unboundedPreceding, 0)))
    top = F.col("rank") <= cut
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    best = qrels.where("rel > 0").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id"))).where(F.col("r") <= cut)
    ideal = best.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1.0)).alias("ideal"))
    own = j.groupBy("system", "qid").agg(
        (F.sum(F.when(top & (F.col("rel") > 0), 1).otherwise(0)) / F.lit(float(cut))).alias("p_at_k"),
        (F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.max("n_rel")).alias("ap"), F.sum(F.when(top, gain).otherwise(0.0)).alias("dcg"),
    )
    return own.join(ideal, "qid").select("system", "qid", F.round("p_at_k", 6).alias("p_at_k"), F.round("ap", 6).alias("ap"), F.round(F.try_divide("dcg", "ideal"), 6).alias("ndcg_at_k"))


def long_form(metrics: DataFrame) -> DataFrame:
    """(system, qid, measure, value)."""
    return metrics.unpivot(["system", "qid"], ["p_at_k", "ap", "ndcg_at_k"], "measure", "value")


def summary(metrics: DataFrame) -> DataFrame:
    """(system, measure, mean, median, deviation) over the topics."""
    return long_form(metrics).groupBy("system", "measure").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


def interpolated(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(system, recall, precision): best precision at or beyond each of 11 recall levels, mean over the topics."""
    j = judged(run, qrels).where("n_rel > 0").withColumn("hits", F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(_by_rank().rowsBetween(Window.unboundedPreceding, 0)))
    points = j.where("rel > 0").select("system", "qid", (F.col("hits") / F.col("n_rel")).alias("recall"), (F.col("hits") / F.col("rank")).alias("precision"))
    topics = j.select("system", "qid").distinct()
    return _levels(topics, points, ["system", "qid"]).groupBy("system", "recall").agg(F.round(F.avg("precision"), 6).alias("precision"))


def _levels(keys: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    levels = keys.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)).alias("recall"))
    p = points.withColumnRenamed("recall", "at")
    j = levels.join(p, by, "left").where("at IS NULL OR at >= recall - 1e-9")
    best = j.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))
    return levels.join(best, [*by, "recall"], "left").withColumn("precision", F.coalesce("precision", F.lit(0.0)))


def interpolated_series(points: DataFrame) -> DataFrame:
    """(recall, precision) at 11 levels of one series (recall, precision)."""
    keyed = points.withColumn("s", F.lit(0))
    return _levels(keyed.select("s").distinct(), keyed, ["s"]).select(F.round("recall", 1).alias("recall"), F.round("precision", 6).alias("precision"))


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """(system, bin, n): equal-width bins over the range of all values of ``values`` (system, value), the last closed on the right."""
    lim = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = values.crossJoin(F.broadcast(lim))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return j.select("system", at.alias("bin")).groupBy("system", "bin").agg(F.count(F.lit(1)).alias("n"))


def rank_correlation(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, rho): Spearman between two top-k lists (qid, doc_id, rank); a document missing from one has rank k + 1; ties have mean ranks."""
    x, y = (r.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").cast("double").alias(n)) for r, n in ((a, "x"), (b, "y")))
    j = x.join(y, ["qid", "doc_id"], "full").select("qid", F.coalesce("x", F.lit(k + 1.0)).alias("x"), F.coalesce("y", F.lit(k + 1.0)).alias("y"))
    mean = lambda c: F.rank().over(Window.partitionBy("qid").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("qid", c)) - 1) / 2
    r = j.select("qid", mean("x").alias("rx"), mean("y").alias("ry"))
    return r.groupBy("qid").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


def overlap_at(a: DataFrame, b: DataFrame, cuts: list[int]) -> DataFrame:
    """(k, overlap): share of the first k of ``a`` that are among the first k of ``b``; both (id, rank)."""
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id")
    worst = both.select(F.greatest("ra", "rb").alias("w")).where(F.col("w") <= max(cuts, default=0))
    wide = worst.agg(*[F.count_if(F.col("w") <= k).alias(f"k{k}") for k in cuts])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"k{k}") / k, 6).alias("overlap")) for k in cuts])))


def mean_by_bin(values: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean): mean ``value`` of rows of (size, value) by equal-width bins of ``size``, the last closed on the right."""
    lim = values.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("size") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).cast("int")
    return values.crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def timing_summary(seconds: dict[str, float], k: int = 10) -> list[tuple[str, float]]:
    """The k fastest, an ellipsis if more than 2k were measured, and the k slowest of measured queries."""
    order = sorted(seconds.items(), key=lambda x: (x[1], x[0]))
    return order if len(order) <= 2 * k else [*order[:k], ("...", float("nan")), *order[-k:]]
