"""Writers of statistics, run and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def term_file(terms: DataFrame, path: str) -> None:
    """Lines ``term cf df`` in order of term."""
    terms.orderBy("term").select(F.concat_ws(" ", "term", "cf", "df").alias("value")).write.text(path)


def statistics_lines(stats: DataFrame, extremes: DataFrame) -> DataFrame:
    """(no, value): the nine labelled lines of a collection's statistics."""
    e = extremes.agg(*[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{w}_{c}") for w in ("shortest", "longest") for c in ("n_tokens", "n_terms")])
    wide = stats.crossJoin(F.broadcast(e))
    pairs = [
        ("Documents", F.col("n_docs")), ("Tokens", F.col("n_tokens")), ("Terms", F.col("n_terms")), ("Mean tokens", F.col("mean_tokens")), ("Mean terms", F.col("vocab_per_doc")),
        ("Mean term length", F.col("mean_term_length")), ("Tokens of the shortest and longest document", F.concat_ws(" ", "shortest_n_tokens", "longest_n_tokens")),
        ("Terms of the shortest and longest document", F.concat_ws(" ", "shortest_n_terms", "longest_n_terms")), ("Terms with frequency 1", F.col("hapax")),
    ]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.concat(F.lit(k + ": "), v.cast("string")).alias("value")) for i, (k, v) in enumerate(pairs)])))


def statistics_file(stats: DataFrame, extremes: DataFrame, path: str) -> None:
    statistics_lines(stats, extremes).coalesce(1).sortWithinPartitions("no").select("value").write.text(path)


def frequency_file(terms: DataFrame, path: str, k: int = 10) -> None:
    """The k most frequent terms, a blank line, the k least frequent."""
    top = terms.orderBy(F.desc("cf"), "term").limit(k).select(F.lit(0).alias("part"), (-F.col("cf")).alias("o"), "term", F.concat_ws(" ", "term", "cf").alias("value"))
    low = terms.orderBy("cf", "term").limit(k).select(F.lit(2).alias("part"), F.col("cf").alias("o"), "term", F.concat_ws(" ", "term", "cf").alias("value"))
    gap = terms.sparkSession.createDataFrame([(1, 0, "", "")], "part int, o long, term string, value string")
    top.unionAll(gap).unionAll(low).coalesce(1).sortWithinPartitions("part", "o", "term").select("value").write.text(path)


def json_dump(data: DataFrame, path: str) -> None:
    """One JSON object a line."""
    data.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def json_report(data: DataFrame, statistics: DataFrame, path: str) -> None:
    """Lines of JSON ``{"data": ...}`` for each row of ``data``, and one ``{"statistics": ...}`` of the single row of ``statistics`` at the end of the last file."""
    rows = data.select(F.lit(0).alias("o"), F.to_json(F.struct(F.struct("*").alias("data"))).alias("value")).unionAll(statistics.select(F.lit(1).alias("o"), F.to_json(F.struct(F.struct("*").alias("statistics"))).alias("value")))
    rows.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.text(path)


def pair_file(pairs: DataFrame, path: str) -> None:
    """Lines ``n v``."""
    pairs.orderBy("n").select(F.concat_ws(" ", "n", "v").alias("value")).write.text(path)


def result_lines(run: DataFrame, names: DataFrame) -> DataFrame:
    """(value): ``name:id:score`` of a ranked result, names joined by doc_id."""
    return run.join(names, "doc_id").orderBy("qid", "rank").select(F.concat_ws(":", "doc_name", "doc_id", F.format_number("score", 4)).alias("value"))


def graph_tables(pages: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, for drawing elsewhere."""
    pages.write.parquet(path + "/nodes")
    edges.write.parquet(path + "/edges")
