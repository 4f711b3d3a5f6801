"""Boolean retrieval: a query's tree becomes one predicate over flags that a single grouped pass computes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Node:
    op: str  # term, and, or, not
    args: tuple = ()
    term: str = ""


def parse(query: str) -> Node:
    """AND, OR, NOT (any case), parentheses and words; AND binds before OR, words side by side are a conjunction. In lower case."""
    tokens = re.findall(r"\(|\)|[^\s()]+", query.lower())
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "or":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [single()]
        while peek() not in (None, ")", "or"):
            if peek() == "and":
                at += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def single() -> Node:
        nonlocal at
        t = peek()
        if t is None or t in (")", "and", "or"):
            raise ValueError(f"a word is missing in: {query}")
        at += 1
        if t == "not":
            return Node("not", (single(),))
        if t == "(":
            inside = either()
            if peek() != ")":
                raise ValueError(f"a parenthesis is open in: {query}")
            at += 1
            return inside
        return Node("term", term=t)

    tree = either()
    if at < len(tokens):
        raise ValueError(f"a parenthesis is too many in: {query}")
    return tree


def terms_of(node: Node) -> list[str]:
    return [node.term] if node.op == "term" else [t for a in node.args for t in terms_of(a)]


def predicate(node: Node, flag) -> Column:
    if node.op == "term":
        return flag(node.term)
    if node.op == "not":
        return ~predicate(node.args[0], flag)
    return reduce(lambda a, b: a & b if node.op == "and" else a | b, (predicate(a, flag) for a in node.args))


def holds_without_terms(node: Node) -> bool:
    """Whether a document with none of the terms satisfies the query."""
    if node.op == "term":
        return False
    if node.op == "not":
        return not holds_without_terms(node.args[0])
    return (all if node.op == "and" else any)(holds_without_terms(a) for a in node.args)


def boolean_search(tf: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(doc_id) that satisfy ``query``. ``docs`` (doc_id) is only read if documents without any of the terms can satisfy it."""
    tree = parse(query)
    words = sorted(set(terms_of(tree)))
    names = {w: f"f{i}" for i, w in enumerate(words)}
    flags = tf.where(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(n) for w, n in names.items()])
    if holds_without_terms(tree):
        flags = docs.select("doc_id").distinct().join(flags, "doc_id", "left")
    return flags.where(predicate(tree, lambda w: F.coalesce(F.col(names[w]), F.lit(False)))).select("doc_id")


def conjunction(tf: DataFrame, query: str) -> DataFrame:
    """(doc_id) of the documents with all terms of ``a AND b ...``, by counting; an unknown term gives none. At least two terms."""
    words = [w for w in re.split(r"\s+and\s+", query.strip().lower()) if w]
    if len(words) < 2:
        raise ValueError("a conjunction has at least two terms")
    distinct = sorted(set(words))
    return tf.where(F.col("term").isin(distinct)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(distinct)).select("doc_id")


#: Query patterns for two and three terms (fixed values).
PATTERNS = {2: ("{0} AND {1}", "{0} OR {1}", "{0} AND NOT {1}"), 3: ("{0} AND {1} AND {2}", "({0} OR {1}) AND NOT {2}", "({0} AND {1}) OR {2}")}


def pattern_batch(tf: DataFrame, word_lists: list[list[str]]) -> DataFrame:
    """(query, n_docs, posting_sum) of every pattern over every list of two or three words, in one grouped pass over the postings."""
    queries = [p.format(*ws) for ws in word_lists for p in PATTERNS.get(len(ws), ())]
    words = sorted({w.lower() for ws in word_lists for w in ws})
    names = {w: f"f{i}" for i, w in enumerate(words)}
    flags = tf.where(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(n) for w, n in names.items()])
    counts = flags.agg(*[F.count_if(predicate(parse(q), lambda w: F.col(names[w]))).alias(f"q{i}") for i, q in enumerate(queries)], *[F.count_if(n).alias(f"d_{n}") for n in names.values()])
    rows = [F.struct(F.lit(q).alias("query"), F.col(f"q{i}").alias("n_docs"), reduce(lambda a, b: a + b, (F.col(f"d_{names[w]}") for w in sorted(set(terms_of(parse(q)))))).alias("posting_sum")) for i, q in enumerate(queries)]
    return counts.select(F.inline(F.array(*rows)))


def usable_queries(queries: DataFrame, terms: DataFrame, tokenizer, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(qid, words) of the queries (qid, query) with as many tokens as ``sizes`` says, all of them in the vocabulary ``terms`` (term)."""
    q = queries.select("qid", tokenizer(F.col("query")).alias("words")).where(F.size("words").isin(list(sizes)))
    known = terms.select("term").join(F.broadcast(q.select("qid", "words", F.explode("words").alias("term"))), "term").groupBy("qid", "words").agg(F.count(F.lit(1)).alias("n"))
    return known.where(F.col("n") == F.size("words")).select("qid", F.concat_ws(" ", "words").alias("words"))
