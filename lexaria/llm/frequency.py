"""Frequencies of every term or n-gram over a whole collection, by sorting suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


class _Out:
    """Closed prefixes: the suffix that each is the beginning of, its length, count and records."""

    def __init__(self):
        self.rows: tuple[list, list, list, list] = ([], [], [], [])

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        suffix, depth, cf, df = self.rows
        flat = [x for s, n in zip(suffix, depth) for x in s[:n]]
        grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth)], pa.int32()), pa.array(flat, kind))
        self.rows = ([], [], [], [])
        return pa.record_batch([grams, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], names=["gram", "cf", "df"])


def _flush(stack: list, depth: int, out: _Out) -> None:
    """Closes the prefixes deeper than ``depth``; each hands its count and records to the prefix one shorter."""
    suffix_, depth_, cf_, df_ = out.rows
    while len(stack) > depth:
        suffix, cf, parts = stack.pop()
        ids = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        suffix_.append(suffix)
        depth_.append(len(stack) + 1)
        cf_.append(cf)
        df_.append(len(ids))
        if stack:
            stack[-1][1] += cf
            stack[-1][2].append(ids)


def _stacked(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that arrive in reverse lexicographic order, by record within equal ones: only the open prefixes are held.

    Equal suffixes are summed and their records made distinct by whole columns; the stack then works once for each different suffix. Each entry has its suffix, count, and
    lists of records, which are merged when it closes.
    """
    stack: list = []
    last = None
    out = _Out()
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("rid").to_numpy(zero_copy_only=False)
        w = b.column("w").to_numpy(zero_copy_only=False)
        suffixes = b.column("suffix")
        ends = suffixes.offsets.to_numpy().astype(np.int64)
        size = np.diff(ends)
        codes = suffixes.values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        most = int(size.max())
        at = ends[:-1, None] + np.arange(most)
        table = np.where(np.arange(most) < size[:, None], codes[np.minimum(at, len(codes) - 1)], -1)
        # common beginning with the row before, in terms
        common = np.r_[0, np.logical_and.accumulate((table[1:] == table[:-1]) & (table[1:] >= 0), axis=1).sum(axis=1)]
        new = np.r_[True, (common[1:] < size[1:]) | (size[1:] != size[:-1])]
        new_id = np.r_[True, ids[1:] != ids[:-1]] | new
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(w, starts).tolist()
        id_starts = np.flatnonzero(new_id)
        own = np.searchsorted(id_starts, np.r_[starts, len(ids)])
        distinct = ids[id_starts]
        firsts = suffixes.take(pa.array(starts)).to_pylist()
        lcps = common[starts].tolist()
        for k, (s, cf, lcp, lo, hi) in enumerate(zip(firsts, sums, lcps, own[:-1].tolist(), own[1:].tolist())):
            if k == 0 and last is not None:
                while lcp < len(s) and lcp < len(last) and s[lcp] == last[lcp]:
                    lcp += 1
            if lcp < len(stack):
                _flush(stack, lcp, out)
            for _ in range(len(stack), len(s)):
                stack.append([s, 0, []])
            top = stack[-1]
            top[1] += cf
            top[2].append(distinct[lo:hi])
            last = s
        if len(out.rows[0]) > 20_000:
            yield out.batch(kind)
    _flush(stack, 0, out)
    if out.rows[0]:
        yield out.batch(kind)


def ngram_frequencies(sequences: DataFrame, id_col: str, tokens_col: str, *, max_n: int = 3, weight_col: str | None = None, salts: int | None = None, routed: bool = False) -> DataFrame:
    """(gram ARRAY, cf, df) of all n-grams up to ``max_n`` terms: occurrences (or sum of ``weight_col``), and distinct records.

    Suffix-sorted counting: each position emits its suffix cut to ``max_n`` terms, once, and not every n-gram; suffixes are
    routed by their first term, sorted in reverse lexicographic order, and one pass with a stack gives the counts and record sets
    of all prefixes. A first term's suffixes are also spread over ``salts`` parts by record (default: the shuffle's number of
    partitions): a record's suffixes stay together, so the parts' record counts add up and no term gathers in one task; the partial
    counts are then added. ``routed``: the caller's rows have one term each and are spread by term and record already, so that they aren't shuffled again.

    NULL sequences, empty ones and NULL ids give no rows; NULL terms inside a sequence are removed first; NULL weights count 0.
    Repeated rows with one id count as one record. Ids may be of any type (they are hashed to 64 bits unless integral).
    """
    kind = sequences.schema[tokens_col].dataType.elementType
    integral = isinstance(sequences.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    rid = F.col(id_col).cast("long") if integral else F.xxhash64(F.col(id_col))
    w = F.coalesce(F.col(weight_col), F.lit(0)).cast("long") if weight_col else F.lit(1).cast("long")
    rows = sequences.where(F.col(id_col).isNotNull() & F.col(tokens_col).isNotNull()).select(rid.alias("rid"), F.col(tokens_col).alias("t"), w.alias("w"))
    if max_n == 1:
        # outer, so that no filter on the array moves below the caller's own shuffle and keeps it from being reused
        rows = rows.select(F.explode_outer("t").alias("first"), "rid", "w").where("first IS NOT NULL").withColumn("suffix", F.array("first"))
    else:
        at = F.sequence(F.lit(1), F.size("t"))
        rows = rows.withColumn("t", F.array_compact("t")).where(F.size("t") > 0).select(F.explode(F.transform(at, lambda i: F.slice(F.col("t"), i, max_n))).alias("suffix"), "rid", "w").withColumn("first", F.col("suffix")[0])
    spark = sequences.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not routed:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts or parts)).cast("int")).repartition(parts, "first", "salt").drop("salt")
    elif max_n > 1:
        raise ValueError("only suffixes of one term can come routed")
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    order = F.col("first") if max_n == 1 else F.col("suffix")
    rows = rows.sortWithinPartitions(order.desc(), "rid").select("suffix", "rid", "w")
    fields = [T.StructField("gram", T.ArrayType(kind)), T.StructField("cf", T.LongType()), T.StructField("df", T.LongType())]
    partial = rows.mapInArrow(lambda b: _stacked(b, arrow), T.StructType(fields))
    return partial.groupBy("gram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def mark_useless(freqs: DataFrame, n_docs: int, *, rare_cf: int = 1, common_share: float = 0.5) -> DataFrame:
    """``freqs`` with ``marca``: ``raro`` if cf <= ``rare_cf``, ``comun`` if df > ``common_share`` of the records, else NULL. (A term in a collection of one record may be both; it is ``raro``.)"""
    return freqs.withColumn("marca", F.when(F.col("cf") <= rare_cf, "raro").when(F.col("df") > common_share * n_docs, "comun"))
