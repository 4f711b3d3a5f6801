"""Keyed totals and joins whose cost doesn't depend on how unevenly rows spread over the keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexaria.session import stored


def compact_state(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], prefix: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, group): ``<prefix>_rows`` and ``<prefix>_<name>`` for each sum.

    Spark combines rows in every map task before the shuffle, so a key with a third of all rows sends one row per map task.
    NULL values add 0. Rows with a NULL key form a group of their own.
    """
    return df.groupBy(*[F.col(f"`{k}`") for k in (*keys, *group)]).agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{prefix}_{n}") for n, c in sums.items()],
    )


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    group_by: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Aggregates over ``left JOIN right ON on`` without building the joined rows.

    Both inputs are first aggregated by the join key (left also by those columns of ``group_by`` that aren't keys), the compact
    states are joined one to one, and the join's results follow by algebra: ``joined_rows`` = left rows * right rows, the sum of
    a left column over the joined rows = left sum * right rows, and the reverse. Then the states are rolled up to ``group_by``
    (default: the key). Columns: the group, ``l_rows``, ``r_rows``, ``joined_rows``, and for each sum ``l_<name>``/``r_<name>``
    (over the input's own rows with a partner kept by ``how``) and ``joined_l_<name>``/``joined_r_<name>`` (over the joined rows).
    Right figures are counted once per left group that meets them.

    ``how`` is ``inner`` or ``left``. With ``left``, a key without partner has ``r_rows`` 0 and its left rows count once in
    ``joined_rows``, as in SQL. A NULL key matches nothing: it is lost by ``inner`` and kept by ``left``. Empty inputs give empty
    results (``left``: left's groups). Columns other than keys, group and sums are never read, so clashing names don't matter.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    group_by = list(group_by or on)
    extra = [c for c in group_by if c not in on]
    l = compact_state(left, list(on), left_sums, "l", extra)
    r = compact_state(right.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in on))), list(on), right_sums, "r")
    r = r.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = [F.col(f"`{k}`") == F.col(f"`__r_{k}`") for k in on]
    j = l.join(r, cond, how)
    times = F.greatest(F.coalesce(F.col("r_rows"), F.lit(0)), F.lit(1 if how == "left" else 0))
    out = [F.sum("l_rows").alias("l_rows"), F.sum(F.coalesce("r_rows", F.lit(0))).alias("r_rows"), F.sum(F.col("l_rows") * times).alias("joined_rows")]
    for n in left_sums:
        out += [F.sum(f"l_{n}").alias(f"l_{n}"), F.sum(F.col(f"l_{n}") * times).alias(f"joined_l_{n}")]
    for n in right_sums:
        r_n = F.coalesce(F.col(f"r_{n}"), F.lit(0))
        out += [F.sum(r_n).alias(f"r_{n}"), F.sum(r_n * F.col("l_rows")).alias(f"joined_r_{n}")]
    return j.groupBy(*[F.col(f"`{c}`") for c in group_by]).agg(*out)


def own_figure(name: str) -> Column:
    """A left figure of a key (``rows`` or a sum's name) from the joined states: the figure over the joined rows, divided by the rows that each left row met."""
    return F.expr(f"{'joined_rows' if name == 'rows' else 'joined_l_' + name} div greatest(r_rows, 1)")


def heavy_keys(totals: DataFrame, key: str, measure: str | Column, share: float) -> DataFrame:
    """Rows of ``totals`` whose ``measure`` is at least ``share`` of the sum over all rows (NULL keys count in the sum, but aren't returned).

    The totals, one row per key, are stored whole, so that the inputs are read and joined once for both the sum and the keys. The sum is one row, joined to them by a broadcast of that row.
    """
    own = stored(totals.withColumn("__own", F.col(measure) if isinstance(measure, str) else measure))
    whole = own.agg(F.sum("__own").alias("__all"))
    return own.crossJoin(F.broadcast(whole)).where((F.col("__own") >= F.col("__all") * share) & F.col(key).isNotNull() & (F.col("__all") > 0)).drop("__own", "__all")
