"""Near-duplicate texts by ball hashing of short fingerprints, and addresses that lead to one page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lexaria.llm.words import words
from lexaria.session import checkpoint, stored

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Least and most bits of the filter on candidate ids, which has eight for each of them. At most it takes 16 MB; fuller, it only lets more texts through to the exact join.
FILTER_BITS = (1 << 20, 1 << 27)
#: Variants in one partition of the join that finds candidates.
PARTITION_VARIANTS = 500_000


@dataclass(frozen=True)
class BallScheme:
    """Fingerprints of one text: ``tables`` of them, each ``anchors`` whole minimum hashes followed by a code of ``bits`` bits of further ones.

    Two fingerprints with equal anchors and codes at Hamming distance up to ``radius`` share a variant, as each emits all codes within half
    the radius. At similarity s a code bit differs with probability (1 - s) / 2, so a table finds a pair with probability
    s^anchors * P(Binomial(bits, (1 - s) / 2) <= radius). ``signature`` is the number of minimum hashes that give a bit to the text's signature; with 0
    no pair is dropped by its signatures.
    """

    tables: int = 26
    anchors: int = 3
    bits: int = 5
    radius: int = 2
    shingle: int = 3
    seed: int = 20_240_301
    signature: int = 256

    def recall(self, s: float) -> float:
        from math import comb

        q = (1 - s) / 2
        one = s**self.anchors * sum(comb(self.bits, k) * q**k * (1 - q) ** (self.bits - k) for k in range(self.radius + 1))
        return 1 - (1 - one) ** self.tables

    def most_bits(self, threshold: float) -> int:
        """Bits of two signatures that texts of similarity ``threshold`` differ in at most, but for one pair in some twenty million (mean and five and a half deviations)."""
        k, q = self.signature_bits(), (1 - threshold) / 2
        return int(np.ceil(k * q + 5.5 * np.sqrt(k * q * (1 - q))))

    def signature_bits(self) -> int:
        return min(self.signature, self.tables * (self.anchors + self.bits))

    def flips(self) -> np.ndarray:
        """All bit patterns with at most half the radius bits set."""
        codes = np.arange(1 << self.bits)
        return codes[np.array([int(c).bit_count() for c in codes]) <= self.radius // 2].astype(np.uint64)

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        k = self.tables * (self.anchors + self.bits)
        return rng.integers(1, 1 << 32, (k, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingles(text: str, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    w = np.array([hashes[x] for x in words(text)], dtype=np.uint64)
    if len(w) < n:
        return np.zeros(0, dtype=np.uint64)
    x = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        x = _mix(x + w[k : len(w) - n + 1 + k])
    return np.unique(x)


def _sketch(scheme: BallScheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = scheme.multipliers()
        hashes = _Hashes()
        t, a, b, sig = scheme.tables, scheme.anchors, scheme.bits, scheme.signature_bits()
        weight = (np.uint64(1) << np.arange(b, dtype=np.uint64))[None, :]
        free = ~np.uint64((1 << b) - 1)
        salt = _mix(np.arange(1, t + 1, dtype=np.uint64))
        for batch in batches:
            ids, same, keys, sigs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, scheme.shingle, hashes) if text else ()
                if doc is None or not len(s):
                    continue
                low = (s >> np.uint64(32)).astype(np.uint32)
                least = np.empty((len(mul), 1), dtype=np.uint32)
                # rows of many shingles are done in parts, so that a very long text needs no large matrix
                for k in range(0, len(low), 4096):
                    part = (low[None, k : k + 4096] * mul + add).min(axis=1, keepdims=True)
                    least = part if k == 0 else np.minimum(least, part)
                m = least.reshape(t, a + b).astype(np.uint64)
                key = salt.copy()
                for k in range(a):
                    key = _mix(key + m[:, k])
                ids.append(doc)
                sigs.append(np.packbits(np.pad(((least.reshape(-1)[:sig] >> np.uint32(7)) & np.uint32(1)).astype(np.uint8), (0, -sig % 64))).view(np.uint64))
                same.append(xxhash.xxh128_digest(s.tobytes()))
                # a table's anchors and, in the lowest bits, its code
                keys.append((key & free) | (((m[:, a:] >> np.uint64(3)) & np.uint64(1)) * weight).sum(axis=1))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), _lists(keys), _lists(sigs)], names=["id", "same", "keys", "sig"])

    return run


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
    ends = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)] if rows else np.zeros(1, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _variants(scheme: BallScheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = scheme.flips()
        free = ~np.uint64((1 << scheme.bits) - 1)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy()
            keys = b.column("keys").flatten().to_numpy().view(np.uint64)
            # the free bits of keys and codes don't overlap, so a flip of the code is one of the key
            ball = _mix((keys & free)[:, None] + _mix(((keys & ~free)[:, None] ^ flips[None, :]) + _C)).reshape(-1)
            yield pa.record_batch([pa.array(ball.view(np.int64)), pa.array(np.repeat(ids, scheme.tables * len(flips)))], names=["variant", "id"])

    return run


def _filter_words(candidates: DataFrame, bits: int) -> np.ndarray:
    """Fixed-size bit filter of the ids of ``candidates``: aggregated in the executors, at most ``bits`` / 8 bytes come back."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1  # bitmap functions count from 1
    rows = candidates.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros(bits, dtype=bool)
    for r in rows:
        at_bits = (r["b"] - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["m"]), dtype=np.uint8), bitorder="little"))
        out[at_bits[at_bits < bits]] = True
    return np.packbits(out)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, scheme: BallScheme | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): near-duplicate texts by the share of common word shingles in the union of both sets (>= ``threshold``).

    ``members`` is (id, rep): texts with equal shingle sets form a class, represented by its smallest id. ``pairs`` is (id_a, id_b,
    similarity), id_a < id_b, between representatives: with the members it holds every link, and copies are never paired with each other.

    Meet-in-the-middle ball hashing: each representative's fingerprints (see ``BallScheme``) emit all variants within half the radius, the variants
    are shuffled over as many partitions as their number asks for, ids that meet on one are paired and deduplicated, pairs with too different signatures dropped
    (unless the scheme has none), and the rest verified on their exact shingle sets (64-bit hashes). ``spark.checkpoint.dir`` holds the fingerprints and candidates. Only texts that have a candidate
    are read again for the verification: a bit filter of bounded size picks them where they are read.

    NULL or too short texts (fewer words than a shingle) and NULL ids take no part. Rows that repeat an id count as versions of one text:
    a link of any version is a link of the id.
    """
    scheme = scheme or BallScheme(shingle=5)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sketches = stored(source.mapInArrow(_sketch(scheme), "id long, same binary, keys array<long>, sig array<long>"))
    versions = sketches.select("id", "same").distinct()
    classes = versions.groupBy("same").agg(F.min("id").alias("rep"))
    members = versions.join(classes, "same").select("id", "rep").distinct()
    # a representative's own row per class: the class's fingerprint, whichever version of the id carries it
    reps = classes.select(F.col("same").alias("s"), "rep")
    kept = sketches.join(reps, (F.col("same") == F.col("s")) & (F.col("id") == F.col("rep")))
    balls = kept.select("id", "keys").mapInArrow(_variants(scheme), "variant long, id long")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(n, -(-classes.count() * scheme.tables * len(scheme.flips()) // PARTITION_VARIANTS))
    balls = balls.repartition(parts, "variant")
    a, b = balls.alias("a"), balls.alias("b")
    met = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    if scheme.signature_bits():
        # one bit of each minimum hash: pairs whose signatures differ too much for the threshold are dropped before any set is shipped
        first_sig = kept.select("id", "sig")
        apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(-(-scheme.signature_bits() // 64))), F.lit(0))
        met = met.join(first_sig.select(F.col("id").alias("id_a"), F.col("sig").alias("x")), "id_a").join(first_sig.select(F.col("id").alias("id_b"), F.col("sig").alias("y")), "id_b")
        met = met.where(apart <= scheme.most_bits(threshold)).select("id_a", "id_b").distinct()
    met = stored(met)
    wanted_ids = met.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    low, high = FILTER_BITS
    size = min(high, max(low, 1 << (8 * wanted_ids.count()).bit_length()))
    bits = _filter_words(wanted_ids, size)

    @F.pandas_udf(T.BooleanType())
    def wanted(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series(((bits[x >> 3] >> (7 - (x & 7))) & 1).astype(bool))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            s = [shingles(t, scheme.shingle, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(s, pa.binary())], names=["id", "s"])

    again = source.where(wanted(F.pmod(F.xxhash64("id"), F.lit(size)))).mapInArrow(sets, "id long, s binary").repartition(n, "id")

    @F.pandas_udf(T.DoubleType())
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for i, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[i] = both / (len(p) + len(q) - both) if len(p) + len(q) else 0.0
        return pd.Series(out)

    pairs = (
        met.join(again.select(F.col("id").alias("id_a"), F.col("s").alias("s_a")), "id_a")
        .join(again.select(F.col("id").alias("id_b"), F.col("s").alias("s_b")), "id_b")
        .select("id_a", "id_b", jaccard("s_a", "s_b").alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
    )
    return members, pairs


def short_members(df: DataFrame, id_col: str, text_col: str, members: DataFrame, shingle: int) -> DataFrame:
    """(id, rep) of the ids that ``near_duplicates`` leaves out: those of equal words make a class, represented by its smallest id; a NULL text is alone."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, None if t is None else w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is None or len(w := words(t)) < shingle]
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([None if w is None else " ".join(w) for _, w in rows], pa.string())], names=["id", "key"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").mapInArrow(keys, "id long, key string")
    rows = rows.join(members.select("id"), "id", "left_anti").groupBy("id").agg(F.min("key").alias("key"))
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"))
    return rows.join(reps, "key", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def all_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b): every linked pair of ids, copies included. Its size is that of the result; callers that can do with classes use ``near_duplicates`` alone."""
    m = members
    across = (
        pairs.select(F.col("id_a").alias("ra"), F.col("id_b").alias("rb"))
        .join(m.select(F.col("rep").alias("ra"), F.col("id").alias("x")), "ra")
        .join(m.select(F.col("rep").alias("rb"), F.col("id").alias("y")), "rb")
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    inside = m.alias("p").join(m.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))
    return across.unionAll(inside).distinct()


def connected_classes(members: DataFrame, pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, class_id, links): the smallest id that can be reached over links, and the number of other texts directly linked (copies included).

    Hash-to-min with shortcuts over the representatives: each round sends the smallest known label to all neighbours and jumps to that label's own; rounds grow with the logarithm of a
    component's diameter in practice. Each round's labels go to the checkpoint folder.
    """
    edges = checkpoint(pairs.select(F.col("id_a").alias("s"), F.col("id_b").alias("t")).unionAll(pairs.select(F.col("id_b").alias("s"), F.col("id_a").alias("t"))))
    labels = checkpoint(members.select(F.col("rep").alias("v")).distinct().withColumn("c", F.col("v")))
    for _ in range(max_rounds):
        near = edges.join(labels, edges["t"] == labels["v"]).groupBy("s").agg(F.min("c").alias("m"))
        stepped = labels.join(near, labels["v"] == near["s"], "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = labels.select(F.col("v").alias("jv"), F.col("c").alias("jc"))
        new = checkpoint(stepped.join(jump, stepped["c"] == jump["jv"], "left").select("v", "old", F.least("c", F.coalesce("jc", "c")).alias("c")))
        labels = new.select("v", "c")
        if not new.where("old <> c").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    linked = edges.join(sizes, edges["t"] == sizes["rep"]).groupBy("s").agg(F.sum("size").alias("others"))
    per_rep = labels.join(sizes, labels["v"] == sizes["rep"]).join(linked, labels["v"] == linked["s"], "left")
    per_rep = per_rep.select(F.col("v").alias("rep"), F.col("c"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"))
    return members.join(per_rep, "rep").groupBy("id").agg(F.min("c").alias("class_id"), F.max("n").alias("links"))


#: Parameters that carry only a session, a campaign or a referrer (fixed values; prefixes end in *).
EMPTY_PARAMETERS = (
    "sid", "phpsessid", "jsessionid", "aspsessionid*", "sessionid", "session_id", "sess", "cfid", "cftoken", "utm_*", "gclid", "fbclid", "msclkid", "dclid",
    "yclid", "mc_cid", "mc_eid", "ref", "referer", "referrer", "campaign", "campaign_id",
)
#: Names of a folder's default file (fixed values).
DEFAULT_FILE = re.compile(r"/(?:index\.(?:html?|php\d?|xhtml|shtml|aspx?|jsp|cgi)|default\.(?:html?|aspx?|php)|home\.html?)$", re.I)
_EMPTY = re.compile("^(?:" + "|".join(re.escape(p).replace(r"\*", ".*") for p in EMPTY_PARAMETERS) + ")$", re.I)
_HEX = re.compile("%([0-9a-fA-F]{2})")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _decode(s: str) -> str:
    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c in _PLAIN else m[0].upper()

    return _HEX.sub(one, s)


def same_page_key(url: str | None) -> str | None:
    """The address without what doesn't change the page: scheme, host case and ``www.``, default port, coding of plain characters, final slash, default file, fragment, order of parameters, session, campaign and referrer parameters. NULL and blank give NULL."""
    if url is None or not url.strip():
        return None
    try:
        p = urlsplit(url.strip())
    except ValueError:
        return url.strip()
    host = _decode(p.netloc).lower()
    user, at, host = host.rpartition("@")
    host = host.removeprefix("www.")
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    host = host.removesuffix(":").removesuffix(".")
    path = DEFAULT_FILE.sub("/", re.sub(r";(?:jsessionid|sid|phpsessid)=[^/;]*", "", _decode(p.path), flags=re.I))
    path = path.rstrip("/")
    query = sorted(x for x in _decode(p.query).split("&") if x and not _EMPTY.match(x.split("=", 1)[0]))
    return user + at + host + path + ("?" + "&".join(query) if query else "")


@F.pandas_udf(T.StringType())
def page_key(urls: pd.Series) -> pd.Series:
    return urls.map(same_page_key)


def same_pages(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, key): the distinct keys of each id's addresses; ids with one key lead to one page. NULL ids and addresses take no part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).where("id IS NOT NULL AND url IS NOT NULL").distinct()
    return rows.select("id", page_key("url").alias("key")).where("key IS NOT NULL").distinct()
