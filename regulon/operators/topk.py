"""Skew-safe top-k per group.

``row_number() <= k`` with a constant ``k`` lets Spark plan a partial
``WindowGroupLimit`` before the shuffle, so each map task sends at most ``k``
rows per group and a hot group cannot flood one reducer.

A per-group limit (a column) cannot use that rule by itself.
:func:`top_k_by_column` adds the largest limit as a constant: what a task sends
of a group is then bounded by a limit that some group really has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per ``keys`` by ``order`` (which must be a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def largest_limit(limits: DataFrame, k_col: str) -> int:
    return int(limits.agg(F.max(k_col)).first()[0] or 0)


def top_k_by_column(
    df: DataFrame, limits: DataFrame, keys: list[str], order: list[Column], k_col: str, rank_col: str = "rank",
    most: int | None = None,
) -> DataFrame:
    """Rows ranked 1..``k_col`` per ``keys``, where ``limits`` holds ``keys + [k_col]``.

    Groups without a limit are dropped. One number, the largest limit, is
    collected to bound the partial limit before the shuffle, unless the caller
    knows that no limit is above ``most``.
    """
    if most is None:
        most = largest_limit(limits, k_col)
    ranked = top_k(df.join(limits, keys), keys, order, most, rank_col)
    return ranked.where(F.col(rank_col) <= F.col(k_col))
