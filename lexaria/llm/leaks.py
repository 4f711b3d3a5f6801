"""Corpus documents that contain passages of held-out items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexaria.llm.words import plain_words

#: Items that are matched in one pass over the corpus; more are done in blocks of this size. An item's grams take some kilobytes.
BLOCK_ITEMS = 20_000
#: Width in words of a band of diagonals; neighbouring bands overlap by half.
BAND = 16
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def _gram_codes(words: np.ndarray, starts: np.ndarray, q: int) -> np.ndarray:
    """64-bit code of the ``q`` word codes from each start."""
    code = np.zeros(len(starts), dtype=np.uint64)
    for k in range(q):
        code = _mix(code + words[starts + k].astype(np.uint64) + np.uint64(1))
    return code


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: ``np.unique`` without counts hashes them, which takes much longer."""
    x = np.sort(x)
    return x[_begins(x)]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


@dataclass
class ItemIndex:
    """Everything the scan needs of one block of items."""

    ids: list
    words: np.ndarray  # codes of all items' words, one item after the other
    begins: np.ndarray  # where each item's words begin
    lengths: np.ndarray  # words of each item
    run_of: np.ndarray  # number within its item of the distinct run that begins at each word, -1 for its last words
    runs: np.ndarray  # distinct runs of each item
    need: np.ndarray  # of them, those that a leak must hold
    vocabulary: dict[str, int]
    q: int  # words of a gram
    least: int  # grams of any run: the bound of a band
    codes: np.ndarray  # distinct codes, sorted
    first: np.ndarray  # range of each code in the occurrence arrays
    item: np.ndarray
    pos: np.ndarray
    filter: np.ndarray


def build_index(items: Sequence[tuple], n: int, share: float) -> ItemIndex | None:
    """Index of the items that have runs of ``n`` words, by their grams of ``n - 1`` words (one word for runs of one); None if no item has any."""
    q = max(1, n - 1)
    ids, words, run_of, runs, lengths = [], [], [], [], []
    vocabulary: dict[str, int] = {}
    for item_id, text in items:
        w = plain_words(text or "")
        if len(w) < n:
            continue
        numbers: dict[tuple, int] = {}
        run_of.append(np.array([numbers.setdefault(tuple(w[i : i + n]), len(numbers)) for i in range(len(w) - n + 1)] + [-1] * (n - 1), dtype=np.int32))
        words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], dtype=np.int32))
        ids.append(item_id)
        runs.append(len(numbers))
        lengths.append(len(w))
    if not ids:
        return None
    words, run_of, runs, lengths = np.concatenate(words), np.concatenate(run_of), np.array(runs), np.array(lengths)
    begins = np.cumsum(lengths) - lengths
    item = np.repeat(np.arange(len(ids)), lengths - q + 1)
    pos = np.arange(len(item)) - np.repeat(np.cumsum(lengths - q + 1) - (lengths - q + 1), lengths - q + 1)
    codes = _gram_codes(words, begins[item] + pos, q)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = _begins(codes)
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(codes[first] >> np.uint64(44)).astype(np.int64)] = True
    need = np.maximum(1, np.ceil(share * runs - 1e-9).astype(np.int64))
    return ItemIndex(ids, words, begins, lengths, run_of, runs, need, vocabulary, q, n - q + 1, codes[first], np.r_[first, len(order)], item[order], pos[order], bits)


def banded_alignment(items: np.ndarray, lengths: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lo: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, held): aligns many items with their documents, each on the ``width`` diagonals (document position less item position) from ``lo``.

    ``items`` has an item's word codes in each row, of which ``lengths`` are used; its document is the ``sizes`` codes of ``words`` from ``starts``. ``edits`` is the least number of word
    edits that bring the item into the document there (any part of the document under the band may be the counterpart); ``held`` tells for each item
    position whether the run of ``n`` words from it stands unchanged on one of the diagonals.
    """
    count, most = items.shape
    kind = np.int16 if most + width < 8000 else np.int32
    big = kind(np.iinfo(kind).max // 2)
    # a column per item, so that each step works on whole rows; the words under diagonals 0, 1, ... at item position i are rows i, i + 1, ...
    ends = lo + np.arange(most + width)[:, None]
    inside = (ends >= 0) & (ends < sizes)
    under = np.where(inside, words[np.where(inside, starts + ends, 0)], -3)
    beyond = np.where((ends >= 0) & (ends <= sizes), kind(0), big)
    steps = np.arange(width, dtype=kind)[:, None]
    equal = np.empty((most, width, count), dtype=bool)
    edits = np.zeros(count, dtype=np.int64)
    row = beyond[:width]
    last = np.full((1, count), big, dtype=kind)
    for i in range(most):
        np.equal(under[i : i + width], items[:, i], out=equal[i])
        new = np.minimum(row + ~equal[i], np.concatenate([row[1:], last]) + kind(1))
        new = np.minimum.accumulate(new - steps, axis=0) + steps
        row = np.minimum(np.maximum(new, beyond[i + 1 : i + 1 + width]), big)
        ended = lengths == i + 1
        if ended.any():
            edits[ended] = row[:, ended].min(axis=0)
    held = np.zeros((count, max(0, most - n + 1)), dtype=bool)
    if most >= n:
        whole = equal[: most - n + 1]
        for k in range(1, n):
            whole = whole & equal[k : most - n + 1 + k]
        held = whole.any(axis=1).T
    return np.minimum(edits, lengths), held


#: Cells (bands, item positions, diagonals) that are aligned at once, unless a single band has more.
ALIGNED = 2_000_000
#: Characters of text that are scanned at once, unless a single document has more, so that the arrays stay in the caches.
SCANNED = 1_000_000


def _align(ix: ItemIndex, i: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lo: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, at_band, at_pos) of items ``i`` on their bands: the edits of each, and the bands and item positions of the runs that are held. Items of like length are aligned together."""
    edits, bands, places = np.zeros(len(i), dtype=np.int64), [], []
    order = np.argsort(-ix.lengths[i], kind="stable")
    done = 0
    while done < len(order):
        most = int(ix.lengths[i[order[done]]])
        x = order[done : done + max(1, ALIGNED // (most * width))]
        done += len(x)
        own = ix.lengths[i[x]]
        at = np.arange(most)
        rows = np.where(at < own[:, None], ix.words[np.minimum(ix.begins[i[x]][:, None] + at, len(ix.words) - 1)], -2)
        edits[x], held = banded_alignment(rows, own, words, starts[x], sizes[x], lo[x], width, n)
        b, p = np.nonzero(held)
        bands.append(x[b])
        places.append(p)
    return edits, np.concatenate(bands), np.concatenate(places)


def _scan(ids: list, texts: list, ix: ItemIndex | None, n: int, band: int):
    """(id, item_id, runs, shared, edits) of all documents of a batch with bands that align well enough."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SCANNED or k + 1 == len(texts):
            if ix is not None:
                yield from _scan_some(ids[first : k + 1], texts[first : k + 1], ix, n, band)
            first, size = k + 1, 0


def _scan_some(ids: list, texts: list, ix: ItemIndex, n: int, band: int):
    """The rows of ``_scan`` for some of its documents."""
    lists = [plain_words(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in lists])
    doc_start = np.cumsum(sizes) - sizes
    # words that no item has are -1
    words = np.fromiter(map(ix.vocabulary.get, chain.from_iterable(lists), repeat(-1)), dtype=np.int32, count=int(sizes.sum()))
    # grams of items' words only; those over the end of a document are left out below
    known = words >= 0
    starts = known[: max(0, len(words) - ix.q + 1)].copy()
    for k in range(1, ix.q):
        starts &= known[k : k + len(starts)]
    starts = np.flatnonzero(starts)
    codes = _gram_codes(words, starts, ix.q)
    maybe = np.flatnonzero(ix.filter[(codes >> np.uint64(44)).astype(np.int64)])
    starts, codes = starts[maybe], codes[maybe]
    k = np.searchsorted(ix.codes, codes)
    k[k == len(ix.codes)] = 0
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    hit = (ix.codes[k] == codes) & (starts + ix.q <= doc_start[doc] + sizes[doc])
    starts, k, doc = starts[hit], k[hit], doc[hit]
    items, places = len(ix.ids), int(ix.lengths.max())
    times = ix.first[k + 1] - ix.first[k]
    occ = np.repeat(ix.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    pair = np.repeat(doc * items, times) + ix.item[occ]
    # most pairs have fewer hits than they need runs
    by_pair = np.argsort(pair, kind="stable")
    begins = _begins(pair[by_pair])
    hits = np.diff(np.r_[begins, len(by_pair)])
    enough = by_pair[np.repeat(hits >= ix.need[pair[by_pair[begins]] % items], hits)]
    if not len(enough):
        return
    pair, pos = pair[enough], ix.pos[occ[enough]]
    doc = pair // items
    word = np.repeat(starts, times)[enough]
    half = max(1, band // 2)
    # bands are numbered from the lowest that a hit can fall into
    lowest, bands_of_all = -(places // half) - 2, int(sizes.max()) // half + places // half + 4
    step = (word - doc_start[doc] - pos) // half - lowest
    # overlapping bands: each hit counts in the band of two half widths that begins with its own and in the one before; an item position counts once in a band
    key = _distinct(np.r_[(pair * bands_of_all + step) * places + pos, (pair * bands_of_all + step - 1) * places + pos])
    of_hit = key // places
    begins = _begins(of_hit)
    count = np.diff(np.r_[begins, len(key)])
    bands, keep = of_hit[begins], count >= ix.least
    held_by = key[np.repeat(keep, count)]
    bands = bands[keep]
    # the positions that the kept bands of a pair hold together: each contained run gives one at least
    pairs, hits = np.unique(_distinct(held_by // places // bands_of_all * places + held_by % places) // places, return_counts=True)
    pairs = pairs[hits >= ix.need[pairs % items]]
    bands = bands[np.isin(bands // bands_of_all, pairs)]
    if not len(bands):
        return
    of_pair, lo = bands // bands_of_all, (bands % bands_of_all + lowest) * half
    d, i = of_pair // items, of_pair % items
    edits, at_band, at_pos = _align(ix, i, words, doc_start[d], sizes[d], lo, 2 * half, n)
    # the distinct runs that a pair's bands hold together
    number = _distinct(of_pair[at_band] * places + ix.run_of[ix.begins[i[at_band]] + at_pos])
    pairs, shared = np.unique(number // places, return_counts=True)
    fine = shared >= ix.need[pairs % items]
    pairs, shared = pairs[fine], shared[fine]
    begins = _begins(of_pair)
    least = np.minimum.reduceat(edits, begins)[np.searchsorted(of_pair[begins], pairs)]
    for p, s, e in zip(pairs.tolist(), shared.tolist(), least.tolist()):
        yield ids[p // items], ix.ids[p % items], int(ix.runs[p % items]), s, int(e)


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, *, n: int = 5, share: float = 0.4, band: int = BAND) -> DataFrame:
    """(id, item, runs, shared, edits): documents that contain at least ``share`` of an item's distinct runs of ``n`` words.

    Texts are compared without accents, case and punctuation. Q-gram lemma filter: grams of ``n - 1`` words are
    looked up, and counted over overlapping bands of ``band`` diagonals. A band that holds a whole run of the item holds both of its grams;
    bands below that are dropped, and pairs whose hits, or the item positions of whose kept bands together, are fewer than the runs they would need, so nothing is lost. The kept bands are
    verified by banded alignment in words, which gives ``shared``, the item's distinct runs that stand unchanged under a band, and ``edits``, the word edits that the whole
    item needs to lie under the best kept band; pairs with too few runs are dropped.

    The items are the stated query set: they are read in blocks of 20,000 by id and each block is matched against all documents where these are read, without
    a shuffle, so an item that leaks into a third of the corpus, or a source with a third of it, makes no task longer. NULL texts and items with fewer than ``n`` words match nothing; items with equal
    ids or texts and repeated documents each give their rows; empty tables give an empty result.
    """
    item_kind, doc_kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_kind}, `{item_col}` {item_kind}, runs int, shared int, edits int"
    names = [id_col, item_col, "runs", "shared", "edits"]
    source = docs.select(F.col(id_col), F.col(text_col))

    def matcher(index: ItemIndex | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(_scan(b.column(0).to_pylist(), b.column(1).to_pylist(), index, n, band))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.record_batch([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], item_type), *(pa.array(c, pa.int32()) for c in cols[2:])], names=names)

        return run

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    block: list[tuple] = []
    out = None
    wanted = items.where(F.col(item_text_col).isNotNull()).select(item_col, item_text_col).orderBy(item_col)
    rows = wanted.toLocalIterator()
    while True:
        block = [tuple(r) for _, r in zip(range(BLOCK_ITEMS), rows)]
        if not block and out is not None:
            return out
        part = source.mapInArrow(matcher(build_index(block, n, share)), schema)
        out = part if out is None else out.unionAll(part)
        if len(block) < BLOCK_ITEMS:
            return out
