"""Filling containers of fixed capacity with items that stay whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Items that one task packs; only ids and sizes travel, some 16 bytes each.
GROUP_ITEMS = 20_000


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, part, bin, tokens) of the sum-of-squares packing of ``sizes`` in the given order.

    With N(g) the number of open bins with room g left, an item of size s goes where the sum of N(g)^2 over all g becomes smallest:
    into a bin with room g the sum changes by 2 (N(g - s) - N(g) + 1), or by 1 - 2 N(g) if it becomes full; into a new bin by
    2 N(capacity - s) + 1, or 0 if it fills it. Ties prefer an open bin, then the smallest room. An item above the capacity is
    divided: full bins of its own, and the rest is placed like an item. Items of size 0 take a place in some bin, too.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    bins: dict[int, list[int]] = {}
    out: list[tuple[int, int, int, int]] = []
    count = 0
    open_gaps = np.zeros(0, dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        part = 0
        while s > capacity:
            out.append((i, part, count, capacity))
            count, part, s = count + 1, part + 1, s - capacity
        at = np.searchsorted(open_gaps, s)
        fit = open_gaps[at:]
        best_gap, best = None, 2 * n[capacity - s] + 1 if s < capacity else 0
        if len(fit):
            change = np.where(fit == s, 1 - 2 * n[fit], 2 * (n[fit - s] - n[fit] + 1)) if s else np.zeros(len(fit), dtype=np.int64)
            j = int(change.argmin())
            if change[j] <= best:
                best_gap = int(fit[j])
        if best_gap is None:
            b, gap = count, capacity
            count += 1
        else:
            gap = best_gap
            b = bins[gap].pop()
            n[gap] -= 1
            if not n[gap]:
                open_gaps = np.delete(open_gaps, np.searchsorted(open_gaps, gap))
        out.append((i, part, b, s))
        left = gap - s
        if left:
            if not n[left]:
                open_gaps = np.insert(open_gaps, np.searchsorted(open_gaps, left), left)
            n[left] += 1
            bins.setdefault(left, []).append(b)
    a = np.array(out, dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack_containers(sizes: DataFrame, id_col: str, size_col: str, capacity: int, *, n_items: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(id, part, container, tokens): where each item, or each part of an item above ``capacity``, goes.

    Items are spread by a hash of their id over groups of about ``group_items``; each group is packed on its own, by falling size
    (ties by id), so the number of groups grows with the data and a group's size doesn't. A group leaves at most its few open bins
    partly empty. ``n_items`` saves counting the rows (an estimate will do). ``container`` is ``<group>-<bin>``. Rows with NULL id or size and negative sizes are left out; a repeated row is packed
    once per row; no input rows give no result. ``part`` is 0 for items that stay whole; a divided item has parts 0, 1, ...
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = sizes.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size")).where("id IS NOT NULL AND size >= 0")
    groups = max(1, -(-(sizes.count() if n_items is None else n_items) // group_items))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        item, part, b, tokens = pack(pdf["size"].to_numpy(), capacity)
        g = int(pdf["g"].iloc[0])
        return pd.DataFrame({id_col: pdf["id"].to_numpy()[item], "part": part.astype("int32"), "container": [f"{g}-{x}" for x in b.tolist()], "tokens": tokens.astype("int32")})

    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long"))
    # groups are few bytes but much work: their number, not their size, sets the tasks
    spark = sizes.sparkSession
    rows = rows.repartition(min(groups, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "g")
    return rows.groupBy("g").applyInPandas(one, f"`{id_col}` long, part int, container string, tokens int")
