"""Inverted index: postings in term order, lexicon with byte offsets, skip lists, compressed lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexaria.functions import codecs
from lexaria.operators.order import ordered

POSTING_BYTES = 8


def first_seen_ids(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, term_id): terms numbered from 1 in the order of their first appearance (document, then position)."""
    seen = docs.select("doc_id", F.posexplode(tokens).alias("pos", "term")).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return ordered(seen.select("term", "at.doc_id", "at.pos"), [F.col("doc_id"), F.col("pos")], position="term_id").select("term", "term_id")


def lexicon(terms: DataFrame) -> DataFrame:
    """(term, df, term_idx, pointer): alphabetical number from 0 and byte offset of each posting list."""
    rows = ordered(terms.select("term", "df"), [F.col("term")], position="pos", sums={"upto": F.col("df")})
    return rows.select("term", "df", (F.col("pos") - 1).alias("term_idx"), ((F.col("upto") - F.col("df")) * POSTING_BYTES).alias("pointer"))


def write_index(tf: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Postings range-partitioned by term and sorted by (term, doc_id), so that a term's list is found by the files' statistics; an index that exists isn't built again unless ``mode`` says so."""
    tf.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(path)


@dataclass
class StoredIndex:
    """Parts of an index on disk: postings (term, doc_id, tf), lexicon (term, df, cf, term_idx, pointer), skips (term, skip_idx, doc_id, byte_offset), names (doc_id, doc_name), norms (doc_id, norm)."""

    postings: DataFrame
    lexicon: DataFrame
    skips: DataFrame
    names: DataFrame
    norms: DataFrame


PARTS = tuple(StoredIndex.__dataclass_fields__)


def load_parts(spark: SparkSession, path: str) -> StoredIndex:
    """A stored index, read lazily; filters on ``term`` skip files and row groups by their statistics."""
    return StoredIndex(*(spark.read.parquet(f"{path}/{p}") for p in PARTS))


def save_parts(tf: DataFrame, names: DataFrame, path: str) -> StoredIndex:
    """Writes every part of the index of ``tf`` (term, doc_id, tf) and the documents' names below ``path``; an index that is there is read and not built again.

    Postings and skips are range-partitioned and sorted by term and document. Empty inputs give an index without rows. The parts are complete when ``done`` exists, so a build that was broken off is done anew.
    """
    spark = tf.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        write_index(tf.select("term", "doc_id", "tf"), f"{path}/postings", "overwrite")
        rows = lexicon(terms).join(terms.select("term", "cf"), "term").select("term", "df", "cf", "term_idx", "pointer")
        rows.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
        skip_lists(tf, terms).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/skips")
        names.select("doc_id", "doc_name").write.mode("overwrite").parquet(f"{path}/names")
        n = names.select("doc_id").distinct().count()
        w = (1 + F.ln(F.col("tf").cast("double"))) * F.ln(F.lit(float(max(n, 1))) / F.col("df"))
        tf.join(terms, "term").select("doc_id", w.alias("w")).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).write.mode("overwrite").parquet(f"{path}/norms")
        fs.create(done).close()
    return load_parts(spark, path)


def posting_lines(ix: StoredIndex, term: str) -> DataFrame:
    """(value): ``name:id:frequency`` of a term's list; one line that says so if the term is unknown."""
    rows = ix.postings.where(F.col("term") == term.lower()).join(ix.names, "doc_id").select(F.concat_ws(":", "doc_name", "doc_id", "tf").alias("value"))
    if ix.lexicon.where(F.col("term") == term.lower()).limit(1).count():
        return rows
    return ix.postings.sparkSession.createDataFrame([(f"unknown term: {term}",)], "value string")


def skip_view(ix: StoredIndex, term: str) -> DataFrame:
    """(doc_name, doc_id, byte_offset): a term's skip list in order of the documents' names."""
    return ix.skips.where(F.col("term") == term.lower()).join(ix.names, "doc_id").select("doc_name", "doc_id", "byte_offset").orderBy("doc_name")


def from_skip(ix: StoredIndex, term: str, doc_id: int) -> DataFrame:
    """(doc_id, tf): a term's list from the last skip at or before ``doc_id``; what lies before isn't read, as files and row groups are sorted by term and document."""
    start = ix.skips.where((F.col("term") == term.lower()) & (F.col("doc_id") <= doc_id)).agg(F.max("doc_id")).first()[0]
    own = ix.postings.where(F.col("term") == term.lower())
    return (own if start is None else own.where(F.col("doc_id") >= start)).select("doc_id", "tf").orderBy("doc_id")


def posting_list(tf: DataFrame, term: str) -> DataFrame:
    """(doc_id, tf) of one term, in order; none if it is unknown."""
    return tf.where(F.col("term") == term.lower()).select("doc_id", "tf").orderBy("doc_id")


def skip_lists(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, skip_idx, doc_id, byte_offset): every k-th posting, k = floor(sqrt(df)), from the first. Offsets are within the term's list.

    Postings are numbered over the whole index and the number at which the term's list begins is taken off, so no list is gathered in one task.
    """
    k = F.floor(F.sqrt("df")).cast("int")
    starts = lexicon(terms).select("term", "df", (F.col("pointer") / POSTING_BYTES).cast("long").alias("start"))
    rows = ordered(tf.select("term", "doc_id"), [F.col("term"), F.col("doc_id")]).join(starts, "term").withColumn("rn", F.col("pos") - 1 - F.col("start"))
    return rows.where(F.col("rn") % k == 0).select("term", F.floor(F.col("rn") / k).cast("int").alias("skip_idx"), "doc_id", (F.col("rn") * POSTING_BYTES).cast("long").alias("byte_offset"))


def gaps(tf: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap): differences of neighbouring ids of a list, the first one itself."""
    rows = ordered(tf.select("term", "doc_id", "tf"), [F.col("term"), F.col("doc_id")], position=None, lags={"t": F.col("term"), "d": F.col("doc_id")})
    return rows.select("term", "doc_id", "tf", (F.col("doc_id") - F.when(F.col("t") == F.col("term"), F.col("d")).otherwise(0)).alias("gap"))


def gaps_restored(gapped: DataFrame) -> DataFrame:
    """(term, doc_id, restored): ids from running sums of gaps, less what the lists before the term's sum up to."""
    rows = ordered(gapped.select("term", "doc_id", "gap"), [F.col("term"), F.col("doc_id")], position=None, sums={"s": F.col("gap")})
    base = rows.groupBy("term").agg(F.min(F.col("s") - F.col("gap")).alias("base"))
    return rows.join(base, "term").select("term", "doc_id", (F.col("s") - F.col("base")).alias("restored"))


def compressed_sizes(tf: DataFrame) -> DataFrame:
    """(term, df, ids_bytes, gap_bytes, freq_bytes): variable-byte sizes of the ids with and without gaps, gamma size of the frequencies padded to bytes."""
    return gaps(tf).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(codecs.vbyte_size(F.col("doc_id"))).alias("ids_bytes"), F.sum(codecs.vbyte_size(F.col("gap"))).alias("gap_bytes"),
        F.ceil(F.sum(codecs.gamma_bits(F.col("tf"))) / 8).alias("freq_bytes"),
    )


def compression_savings(sizes: DataFrame) -> DataFrame:
    """One row: bytes raw, compressed without and with gaps, and the percentage that gaps save."""
    return sizes.agg(
        (F.sum("df") * POSTING_BYTES).alias("raw_bytes"), F.sum(F.col("ids_bytes") + F.col("freq_bytes")).alias("plain_bytes"), F.sum(F.col("gap_bytes") + F.col("freq_bytes")).alias("gap_bytes"),
    ).withColumn("saving_percent", F.round(100.0 * (1 - F.try_divide("gap_bytes", "plain_bytes")), 4))


#: Documents that one stored block of a compressed list holds; longer lists have several blocks.
BLOCK_POSTINGS = 65_536


def compress(tf: DataFrame, with_gaps: bool = True) -> DataFrame:
    """(term, block, n, ids, freqs): each list as variable-byte ids (or gaps within the block) and gamma frequencies, in blocks by range of doc_id so that no list is gathered whole."""
    rows = tf.withColumn("block", F.floor(F.col("doc_id") / BLOCK_POSTINGS))
    lists = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("l"))
    ids = F.col("l.doc_id")
    deltas = F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at(ids, i.cast("int")))) if with_gaps else ids
    return lists.select("term", "block", F.size("l").alias("n"), codecs.vbyte_bytes(deltas).alias("ids"), codecs.gamma_bytes(F.col("l.tf")).alias("freqs"))


def decompress(stored: DataFrame, with_gaps: bool = True) -> DataFrame:
    """(term, doc_id, tf) of compressed lists."""
    ids = codecs.gap_numbers("ids") if with_gaps else codecs.vbyte_numbers("ids")
    rows = stored.select("term", F.arrays_zip(ids.alias("d"), codecs.gamma_numbers("freqs").alias("f")).alias("l"))
    return rows.select("term", F.explode("l").alias("p")).select("term", F.col("p.d").alias("doc_id"), F.col("p.f").alias("tf"))
