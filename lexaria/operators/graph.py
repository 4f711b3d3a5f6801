"""Link graph, distances, PageRank and HITS."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from lexaria.functions.urls import dir_depth, domain, is_dynamic
from lexaria.session import checkpoint, stored

#: Nodes and edges, together, that one task holds to iterate until scores settle. Larger graphs are joined in each round.
IN_ONE_TASK = 10_000_000
#: Edges whose values are gathered at once there, and edges of a partition where graphs are joined until scores settle.
CHUNK, PART_EDGES = 2_000_000, 500_000
#: Rounds between two looks, there, at whether the scores settled.
LOOK = 5


def crawled(tasks: DataFrame) -> DataFrame:
    """The latest row of each id of the crawl state."""
    return tasks.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("url", "outlinks", "depth"), F.coalesce("visto_en", F.lit("1900-01-01").cast("timestamp_ntz"))).alias("s")).select("id", "s.*")


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id) and distinct edges (src, dst) between crawled pages; self links stay."""
    nodes = pages.select("id").distinct()
    edges = pages.select(F.col("id").alias("src"), F.explode("outlinks").alias("dst")).where("dst IS NOT NULL").distinct()
    return nodes, edges.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def levels(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(id, level): breadth-first distance from ``seeds`` (id) up to ``max_depth``; one job per level, each checkpointed."""
    seen = checkpoint(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = checkpoint(found.join(seen, "id", "left_anti").withColumn("level", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionAll(front)
    return seen


def url_features(pages: DataFrame) -> DataFrame:
    """(id, domain, dir_depth, dynamic) of (id, url)."""
    return pages.where("url IS NOT NULL").select("id", domain(F.col("url")).alias("domain"), dir_depth(F.col("url")).alias("dir_depth"), is_dynamic(F.col("url")).alias("dynamic"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    """(kind, value, pages, percent): totals, dynamic and static, by logical depth, by directory depth and by domain, in one grouping-sets pass."""
    f = pages.where("url IS NOT NULL").select(is_dynamic(F.col("url")).alias("dynamic"), F.col("depth").alias("depth"), dir_depth(F.col("url")).alias("dir_depth"), domain(F.col("url")).alias("domain"))
    g = f.groupingSets([[], ["dynamic"], ["depth"], ["dir_depth"], ["domain"]], "dynamic", "depth", "dir_depth", "domain").agg(F.count(F.lit(1)).alias("pages"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "dynamic").when(F.col("g") == 11, "depth").when(F.col("g") == 13, "dir_depth").otherwise("domain")
    value = F.when(F.col("g") == 7, F.col("dynamic").cast("string")).when(F.col("g") == 11, F.col("depth").cast("string")).when(F.col("g") == 13, F.col("dir_depth").cast("string")).when(F.col("g") == 14, F.col("domain"))
    total = f.agg(F.count(F.lit(1)).alias("n"))
    return g.select(kind.alias("kind"), F.coalesce(value, F.lit("")).alias("value"), "pages").crossJoin(F.broadcast(total)).select("kind", "value", "pages", F.round(F.try_divide(100.0 * F.col("pages"), F.col("n")), 4).alias("percent"))


def _kept_by(df: DataFrame, key: str, settling: bool = False) -> DataFrame:
    """``df`` stored, and cached in partitions by ``key``: joins on it in many rounds don't shuffle it again. What a lost executor cached is read from the stored table. ``settling``: no more partitions than its rows need, as the rounds may be hundreds."""
    df = stored(df)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if settling:
        n = min(n, max(df.sparkSession.sparkContext.defaultParallelism, df.count() // PART_EDGES))
    return df.repartition(n, key).persist(StorageLevel.MEMORY_AND_DISK)


def _gathered(to: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the sum of ``values[at]`` over the edges that lead ``to`` it."""
    out = np.zeros(n)
    for i in range(0, len(to), CHUNK):
        out += np.bincount(to[i : i + CHUNK], values[at[i : i + CHUNK]], n)
    return out


def _share(x: np.ndarray) -> np.ndarray:
    return x / total if (total := x.sum()) > 0 else np.zeros(len(x))


def _in_one_task(nodes: DataFrame, edges: DataFrame, cols: list[str], scores: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(id, ``cols``) by ``scores(n, src, dst)`` over nodes numbered from 0, stored; an end that isn't a node has the number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends = [], {"src": [], "dst": []}
        for b in batches:
            ids.append(b.filter(b["is_node"])["src"])
            links = b.filter(pc.invert(b["is_node"]))
            for c, kept in ends.items():
                kept.append(links[c])
        if not (n := sum(map(len, ids))):
            return
        ids = pa.concat_arrays(ids)
        src, dst = (pc.index_in(pa.chunked_array(ends.pop(c)), value_set=ids, skip_nulls=True).fill_null(n).to_numpy() for c in ("src", "dst"))
        yield from pa.table([ids, *map(pa.array, scores(n, src, dst))], names=["id", *cols]).to_batches(max_chunksize=100_000)

    kind, common = nodes.schema["id"].dataType, nodes.select("id").unionAll(edges.select("src")).unionAll(edges.select("dst")).schema["id"].dataType
    ends = edges.select(F.col("src").cast(common).alias("src"), F.col("dst").cast(common).alias("dst"), F.lit(False).alias("is_node"))
    rows = nodes.select(F.col("id").cast(common).alias("src"), F.lit(None).cast(common).alias("dst"), F.lit(True).alias("is_node")).unionAll(ends)
    found = rows.coalesce(1).mapInArrow(run, ", ".join([f"id {common.simpleString()}", *(f"{c} double" for c in cols)]))
    return stored(found.select(F.col("id").cast(kind).alias("id"), *cols))


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, score) after ``rounds`` iterations from the uniform start; the mass of pages without links is spread over all. Scores sum to 1.

    With ``tolerance`` it stops before, when the scores change by less than pages * ``tolerance`` in sum; rounds of up to ``IN_ONE_TASK`` rows then run in one task, without jobs of their own. A node without a row in ``edges`` counts; edges to unknown nodes are lost mass. Empty nodes give no rows.
    """
    nodes = checkpoint(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    if tolerance is not None and n + (edges := stored(edges.select("src", "dst"))).count() <= IN_ONE_TASK:

        def scores(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
            src, dst = src[src < n], dst[src < n]
            degree, score = np.maximum(np.bincount(src, minlength=n), 1), np.full(n, 1.0 / n)
            for _ in range(rounds):
                flow = _gathered(dst, src, score / degree, n + 1)
                before, score = score, (1 - alpha) / n + alpha * (flow[:n] + (1 - flow.sum()) / n)
                if np.abs(score - before).sum() < n * tolerance:
                    break
            return [score]

        return _in_one_task(nodes, edges, ["score"], scores)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    arcs = _kept_by(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")), "src", tolerance is not None)
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    for i in range(rounds):
        # each round reads the last one once: what flows over links, kept, tells the rest of the mass
        flow = checkpoint(ranks.join(arcs, ranks["id"] == arcs["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("flow")))
        loose = flow.agg((1 - F.coalesce(F.sum("flow"), F.lit(0.0))).alias("loose"))
        new = nodes.join(flow, nodes["id"] == flow["dst"], "left").crossJoin(F.broadcast(loose))
        new = new.select("id", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n)).alias("score"))
        settled = tolerance is not None and i % LOOK == LOOK - 1 and new.join(ranks.withColumnRenamed("score", "before"), "id").agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < n * tolerance
        ranks = new
        if settled:
            break
    arcs.unpersist()
    return ranks


def hits(nodes: DataFrame, edges: DataFrame, *, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, hub, authority) after ``rounds`` iterations, each summing to 1 (0 without edges).

    With ``tolerance`` it stops before, when the hub scores change by less than that in sum; rounds of up to ``IN_ONE_TASK`` rows then run in one task, too.
    """
    nodes, edges = checkpoint(nodes.select("id").distinct()), stored(edges)
    if tolerance is not None and nodes.count() + edges.count() <= IN_ONE_TASK:

        def scores(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
            known = (src < n) & (dst < n)
            src, dst, hub = src[known], dst[known], np.ones(n)
            for _ in range(rounds):
                before, hub = hub, _share(_gathered(src, dst, _gathered(dst, src, hub, n), n))
                if np.abs(hub - before).sum() < tolerance:
                    break
            return [hub, _share(_gathered(dst, src, hub, n))]

        return _in_one_task(nodes.where("id IS NOT NULL"), edges, ["hub", "authority"], scores)
    outward, inward = _kept_by(edges, "src", tolerance is not None), _kept_by(edges, "dst", tolerance is not None)

    def scaled(df: DataFrame, col: str) -> DataFrame:
        total = df.agg(F.sum(col).alias("__t"))
        return df.crossJoin(F.broadcast(total)).select("id", F.when(F.col("__t") > 0, F.col(col) / F.col("__t")).otherwise(0.0).alias(col))

    def authority(h: DataFrame) -> DataFrame:
        s = h.join(outward, h["id"] == outward["src"]).groupBy("dst").agg(F.sum("hub").alias("authority"))
        return nodes.join(s, nodes["id"] == s["dst"], "left").select("id", F.coalesce("authority", F.lit(0.0)).alias("authority"))

    hub = nodes.withColumn("hub", F.lit(1.0))
    for i in range(rounds):
        a = authority(hub)
        s = a.join(inward, a["id"] == inward["dst"]).groupBy("src").agg(F.sum("authority").alias("hub"))
        before, hub = hub, nodes.join(s, nodes["id"] == s["src"], "left").select("id", F.coalesce("hub", F.lit(0.0)).alias("hub"))
        if i % 2 or i == rounds - 1 or tolerance is not None:
            # scaling reads its input twice, so it is done on kept rows; in between the values only grow
            hub = scaled(checkpoint(hub), "hub")
            if tolerance is not None and (hub.join(before.withColumnRenamed("hub", "before"), "id").agg(F.sum(F.abs(F.col("hub") - F.col("before")))).first()[0] or 0.0) < tolerance:
                break
    out = hub.join(scaled(checkpoint(authority(hub)), "authority"), "id")
    outward.unpersist()
    inward.unpersist()
    return out


def ordering(scores: DataFrame, measure: str, k: int = 5) -> DataFrame:
    """(measure, rank, id): the ``k`` nodes with the highest ``measure`` (rounded to 6 digits, ties by id)."""
    best = scores.select("id", F.round(measure, 6).alias("s")).orderBy(F.desc("s"), "id").limit(k)
    return best.select(F.lit(measure).alias("measure"), F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("rank"), "id")


def selected(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, ...) named in ``ids`` (id) and the edges between them, all columns kept; everything else is hidden, and nothing is lost, as the inputs stay."""
    ids = ids.select("id").where("id IS NOT NULL").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def with_property(nodes: DataFrame, edges: DataFrame, of: str, name: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Selection by property: ``of`` is ``node`` (nodes whose column ``name`` has one of ``values``, and the edges between them) or ``edge`` (such edges and their ends). NULL has no value."""
    if of == "node":
        return selected(nodes, edges, nodes.where(F.col(name).isin(values)))
    if of != "edge":
        raise ValueError("of must be node or edge")
    kept = edges.where(F.col(name).isin(values))
    ends = kept.select(F.col("src").alias("id")).unionAll(kept.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi"), kept


def two_hop(edges: DataFrame) -> DataFrame:
    """(id, near, far): neighbours over one link and over at most two, links taken both ways, without the node itself.

    Pairs of neighbours meet on the node between them and are combined before they are counted.
    """
    both = edges.where("src <> dst").select("src", "dst").unionAll(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    second = both.alias("a").join(both.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    near = both.groupBy("src").agg(F.count(F.lit(1)).alias("near"))
    far = both.unionAll(second).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("far"))
    return near.join(far, "src").select(F.col("src").alias("id"), "near", "far")
