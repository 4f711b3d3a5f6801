"""Readers of text collections: folders, tagged files, query files, posting dumps, word lists, language samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _decoded(content: str = "content"):
    """Bytes as UTF-8; what is no UTF-8 is dropped."""
    return F.regexp_replace(F.make_valid_utf8(F.col(content).cast("string")), "�", "")


def _strip(c):
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def flat_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, text): every file of one folder, whole, UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_name"), F.col("value").alias("text"))


def folder_tree(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("html", "txt")) -> DataFrame:
    """(doc_name, text): all files below ``path`` with one of the suffixes, the name relative to it; bytes that are no UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    root = path.rstrip("/") + "/"
    return raw.select(F.substring_index(F.col("path"), root, -1).alias("doc_name"), _decoded().alias("text"))


def corpus_size(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, bytes) of the text and HTML files below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,txt}").load(path)
    return raw.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, text): trimmed lines that aren't blank."""
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("value string").csv(path) if encoding.upper() != "UTF-8" else spark.read.text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), _strip(F.col("value")).alias("text")).where("text <> ''")


def tagged_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, text) of a file of <DOC> records with <DOCNO>; what follows the last record is dropped."""
    raw = spark.read.text(path, lineSep="</DOC>")
    name = _strip(F.regexp_extract("value", r"(?s)<DOCNO>(.*?)</DOCNO>", 1))
    return raw.select(name.alias("doc_name"), _strip(F.regexp_replace("value", r"(?s)^.*?</DOCNO>", "")).alias("text")).where("doc_name <> ''")


def posting_dump(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of lines ``term:df:d1,d2``; shorter lines are skipped and the count isn't used."""
    parts = F.split("value", ":")
    raw = spark.read.text(path).where(F.size(parts) >= 3)
    return raw.select(parts[0].alias("term"), F.explode(F.split(parts[2], ",")).alias("d")).where(F.trim("d") != "").select("term", F.trim("d").cast("long").alias("doc_id"))


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of lines ``id:query``, or whole lines (NULL qid); blank ones dropped."""
    raw = spark.read.text(path).where(_strip(F.col("value")) != "")
    has = F.contains("value", F.lit(":"))
    return raw.select(F.when(has, F.trim(F.substring_index("value", ":", 1))).alias("qid"), F.trim(F.when(has, F.regexp_replace("value", "^[^:]*:", "")).otherwise(F.col("value"))).alias("query"))


def short_queries(spark: SparkSession, path: str, least: int = 2, most: int = 4) -> DataFrame:
    """(query) of lines with ``least`` to ``most`` words."""
    q = _strip(F.col("value"))
    return spark.read.text(path).where(F.size(F.split(q, r"\s+")).between(least, most) & (q != "")).select(q.alias("query"))


def topic_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a file of <top> records: the digits after <num>, and the title (up to the next tag), its white space squeezed. Records without a number are dropped."""
    raw = spark.read.text(path, lineSep="</top>")
    num = F.regexp_extract("value", r"(?is)<num>\D*(\d+)", 1)
    title = F.regexp_replace(F.regexp_extract("value", r"(?is)<title>([^<]*)", 1), r"\s+", " ")
    return raw.select(num.alias("n"), _strip(title).alias("query")).where("n <> ''").select(F.col("n").cast("int").alias("qid"), "query")


def judgement_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_name, rel) of lines ``qid iteration document relevance``; shorter lines are skipped, of repeated judgements the highest counts."""
    p = F.split(_strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.size(p) >= 4).select(p[0].try_cast("int").alias("qid"), p[2].alias("doc_name"), p[3].try_cast("int").alias("rel"))
    return rows.where("qid IS NOT NULL AND rel IS NOT NULL").groupBy("qid", "doc_name").agg(F.max("rel").alias("rel"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a list, one a line, in lower case."""
    return spark.read.text(path).select(F.lower(_strip(F.col("value"))).alias("term")).where("term <> ''").distinct()


def language_solution(spark: SparkSession, path: str) -> DataFrame:
    """(n, lang) of lines ``n Label``."""
    p = F.split(_strip(F.col("value")), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 2).select(p[0].cast("long").alias("n"), p[1].alias("lang"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings written by ``operators.index.write_index``; filters on ``term`` skip files by their statistics."""
    return spark.read.parquet(path)
