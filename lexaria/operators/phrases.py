"""Texts that hold given passages, all passages in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Passages in one automaton; more are searched in blocks.
BLOCK = 50_000


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): texts of ``docs`` (doc_id, text) that hold the whole text of an item of ``passages`` (item_id BIGINT, text).

    The passages are the stated query set: an automaton of them goes to every task, and each text is read once for each block of them. NULL and empty
    passages match nothing. No shuffle.
    """
    rows = passages.where("item_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("item_id", "text").orderBy("item_id").toLocalIterator()
    out = None
    while True:
        block = [tuple(r) for _, r in zip(range(BLOCK), rows)]
        if not block and out is not None:
            return out

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            a = ahocorasick.Automaton()
            owners: dict[str, list[int]] = {}
            for item, text in block:
                owners.setdefault(text, []).append(item)
            for text, items in owners.items():
                a.add_word(text, items)
            a.make_automaton()
            for b in batches:
                ids, items = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = {i for _, own in (a.iter(text) if text and owners else ()) for i in own}
                    ids += [doc] * len(found)
                    items += sorted(found)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long").distinct()
        out = part if out is None else out.unionAll(part)
        if len(block) < BLOCK:
            return out
