"""Retrieval models over a sparse index: all topics at once, one shuffle by topic and document."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexaria.operators.stats import term_frequencies, term_stats
from lexaria.session import checkpoint


@dataclass
class Index:
    """tf (doc_id, term, tf), terms (term, cf, df), lengths (doc_id, dl), and the one-row corpus (n, cl, avdl)."""

    tf: DataFrame
    terms: DataFrame
    lengths: DataFrame
    corpus: DataFrame


def build_index(docs: DataFrame, tokens: Column) -> Index:
    tf = term_frequencies(docs, tokens)
    lengths = docs.select("doc_id", F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("dl")).groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("cl"), F.avg("dl").alias("avdl"))
    return Index(tf, term_stats(tf), lengths, corpus)


def stored(ix: Index) -> Index:
    """The index with its postings, statistics and lengths in the checkpoint folder, for several models or many topics."""
    tf = checkpoint(ix.tf)
    return Index(tf, checkpoint(term_stats(tf)), checkpoint(ix.lengths), checkpoint(ix.corpus))


def topic_terms(spark: SparkSession, topics: Mapping[int, str] | DataFrame, tokenizer) -> DataFrame:
    """(qid, term, qtf)."""
    df = topics if isinstance(topics, DataFrame) else spark.createDataFrame(list(topics.items()), "qid int, query string")
    return df.select("qid", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_k(scores: DataFrame, k: int, system: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of each topic, ties by doc_id."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")
    return out.withColumn("system", F.lit(system)) if system else out


def _matches(ix: Index, q: DataFrame, lengths: bool = False) -> DataFrame:
    """Topic terms with their postings, term statistics and corpus figures. Topics are the stated query set: their terms are few, so both small joins broadcast."""
    known = ix.terms.join(F.broadcast(q), "term")
    m = ix.tf.join(F.broadcast(known), "term").crossJoin(F.broadcast(ix.corpus))
    return m.join(ix.lengths, "doc_id") if lengths else m


def cosine_tf(ix: Index, q: DataFrame) -> DataFrame:
    """Cosine with raw counts on both sides; the query's norm is over the terms of the vocabulary."""
    norms = ix.tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    qn = q.join(ix.terms, "term").groupBy("qid").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qn"))
    dot = _matches(ix, q).groupBy("qid", "doc_id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    return dot.join(norms, "doc_id").join(F.broadcast(qn), "qid").select("qid", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def tfidf_weight(tf: Column, df: Column, n: Column) -> Column:
    return (1 + F.ln(tf.cast("double"))) * F.ln(n / df)


def tfidf_norms(ix: Index) -> DataFrame:
    """(doc_id, norm) of the documents' TF-IDF vectors."""
    w = tfidf_weight(F.col("tf"), F.col("df"), F.col("n"))
    return ix.tf.join(ix.terms, "term").crossJoin(F.broadcast(ix.corpus)).groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def with_zero_tail(scores: DataFrame, ix: Index, qids: DataFrame, k: int) -> DataFrame:
    """``scores`` (qid, doc_id, score) with documents of score 0 for topics (qid) that fewer than ``k`` match: those with the smallest ids, which are among the 2k smallest of the collection."""
    few = ix.lengths.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = few.crossJoin(F.broadcast(qids.select("qid").distinct())).join(scores.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    return scores.select("qid", "doc_id", "score").unionAll(rest.select("qid", "doc_id", F.lit(0.0).alias("score")))


def cosine_tfidf(ix: Index, q: DataFrame, k: int | None = None) -> DataFrame:
    """Cosine of (1 + ln tf) ln(N / df) vectors; terms in all documents vanish. With ``k``, every topic has k documents at least, those that share no term with score 0."""
    wd, wq = tfidf_weight(F.col("tf"), F.col("df"), F.col("n")), tfidf_weight(F.col("qtf"), F.col("df"), F.col("n"))
    qn = q.join(ix.terms, "term").crossJoin(F.broadcast(ix.corpus)).groupBy("qid").agg(F.sqrt(F.sum(wq * wq)).alias("qn"))
    dot = _matches(ix, q).groupBy("qid", "doc_id").agg(F.sum(wd * wq).alias("dot"))
    j = dot.join(tfidf_norms(ix), "doc_id").join(F.broadcast(qn), "qid")
    scores = j.select("qid", "doc_id", F.when((F.col("norm") > 0) & (F.col("qn") > 0), F.col("dot") / (F.col("norm") * F.col("qn"))).otherwise(0.0).alias("score"))
    return with_zero_tail(scores, ix, q, k) if k else scores


def coordination(ix: Index, q: DataFrame) -> DataFrame:
    """One point for each query word in the document; repeated words count each time."""
    return _matches(ix, q).groupBy("qid", "doc_id").agg(F.sum("qtf").cast("double").alias("score"))


def robertson_tfidf(ix: Index, q: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    tf, dl = F.col("tf").cast("double"), F.col("dl") / F.col("avdl")
    part = F.col("qtf") * (k1 * tf / (tf + k1 * (1 - b + b * dl))) * F.log2(F.col("n") / F.col("df") + 1)
    return _matches(ix, q, lengths=True).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def bm25(ix: Index, q: DataFrame, k1: float = 1.2, b: float = 0.75, k3: float = 8.0) -> DataFrame:
    """Okapi with log2((N - df + .5) / (df + .5))."""
    tf, qtf = F.col("tf").cast("double"), F.col("qtf").cast("double")
    norm = k1 * ((1 - b) + b * F.col("dl") / F.col("avdl"))
    part = F.log2((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * ((k1 + 1) * tf / (norm + tf)) * ((k3 + 1) * qtf / (k3 + qtf))
    return _matches(ix, q, lengths=True).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def hiemstra_lm(ix: Index, q: DataFrame, lam: float = 0.15) -> DataFrame:
    part = F.col("qtf") * F.log2(1 + (lam * F.col("tf") * F.col("cl")) / ((1 - lam) * F.col("cf") * F.col("dl")))
    return _matches(ix, q, lengths=True).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def dirichlet_lm(ix: Index, q: DataFrame, mu: float = 2500.0) -> DataFrame:
    """Query likelihood with a Dirichlet prior over the documents that share a term; a query term outside the collection adds nothing."""
    own = _matches(ix, q, lengths=True)
    fit = F.ln(1 + F.col("tf") / (mu * F.col("cf") / F.col("cl")))
    size = q.join(ix.terms, "term").groupBy("qid").agg(F.sum("qtf").alias("qlen"))
    s = own.groupBy("qid", "doc_id", "dl").agg(F.sum(F.col("qtf") * fit).alias("s"))
    return s.join(F.broadcast(size), "qid").select("qid", "doc_id", (F.col("s") + F.col("qlen") * F.ln(mu / (F.col("dl") + mu))).alias("score"))


def query_likelihood(ix: Index, q: DataFrame, lam: float = 0.0, k: int = 10, zero: float = -100.0) -> DataFrame:
    """Log query likelihood of every document, p = (1 - lam) tf / dl + lam cf / cl; a token of probability 0 adds ``zero``.

    A document without any term of the topic has the topic's background score, so only documents that share a term are scored, as
    correction of that background. For topics that fewer than ``k`` documents match, the documents with the smallest ids fill up to k: those are
    among the 2k smallest ids of the collection.
    """
    terms = q.join(ix.terms, "term", "left").crossJoin(F.broadcast(ix.corpus))
    base_p = lam * F.col("cf") / F.col("cl")
    base = F.when(F.col("cf").isNotNull() & (base_p > 0), F.ln(base_p)).otherwise(F.lit(zero)) if lam > 0 else F.lit(zero)
    background = terms.groupBy("qid").agg(F.sum(F.col("qtf") * base).alias("background"))
    own_base = F.ln(base_p) if lam > 0 else F.lit(zero)
    p = (1 - lam) * F.col("tf") / F.col("dl") + base_p
    gain = _matches(ix, q, lengths=True).groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * (F.ln(p) - own_base)).alias("gain"))
    few = ix.lengths.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = few.crossJoin(F.broadcast(background.select("qid"))).join(gain.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("gain", F.lit(0.0))
    return gain.unionByName(rest).join(F.broadcast(background), "qid").select("qid", "doc_id", (F.col("gain") + F.col("background")).alias("score"))
