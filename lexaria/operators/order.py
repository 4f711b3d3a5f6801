"""Positions and running sums over a total order, without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexaria.session import checkpoint


def ordered(df: DataFrame, by: Sequence[Column], *, position: str | None = "pos", sums: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with ``position`` (from 1) in the order ``by``, which must be total, and running sums (own row included) of ``sums``,
    and the values of ``lags`` in the row before (NULL in the first).

    The rows are range-partitioned by the order and numbered within their partition; what the partitions before it hold is added
    from one row for each partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums, lags = dict(sums or {}), dict(lags or {})
    rows = df.withColumns({f"__v_{k}": v for k, v in sums.items()} | {f"__l_{k}": v for k, v in lags.items()}).repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id())
    rows = checkpoint(rows)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    offsets = totals.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*by)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if lags:
        # the last row of the nearest part before that has any
        ends = rows.withColumn("__rn", F.row_number().over(inside)).join(F.broadcast(totals.select(F.col("__part").alias("__p"), F.col("__n"))), F.col("__part") == F.col("__p")).where("__rn = __n")
        ends = ends.select("__part", F.struct(*[f"__l_{k}" for k in lags]).alias("__end"))
        offsets = offsets.join(ends.select(F.col("__part").alias("__p"), F.lag("__end").over(Window.orderBy("__part")).alias("__before")), "__p")
    out = rows.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    new = {position: F.row_number().over(inside) + F.col("__n0")} if position else {}
    new |= {k: F.coalesce(F.sum(f"__v_{k}").over(running), F.lit(0)) + F.col(f"__o_{k}") for k in sums}
    first = F.row_number().over(inside) == 1
    new |= {k: F.when(first, F.col(f"__before.__l_{k}")).otherwise(F.lag(f"__l_{k}").over(inside)) for k in lags}
    return out.withColumns(new).drop("__part", "__p", "__n0", "__before", *[f"__l_{k}" for k in lags], *[f"__v_{k}" for k in sums], *[f"__o_{k}" for k in sums])
