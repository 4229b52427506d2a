"""Ranks over range partitions: no group meets in one task, however large it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_parts(df: DataFrame, order: list[str], part: str = "part") -> DataFrame:
    """``df`` with ``part``: the range partition of ``order`` that a row lies in, ascending.

    No number is given, so the ranges are as many as ``spark.sql.shuffle.partitions``
    and AQE joins neighbours that are small. A part is numbered by its task: ranges in
    ascending order, whoever runs it. Rows equal in ``order`` share a part. The ranges
    come from a sample, so two runs of the plan may cut elsewhere: use the result once,
    or checkpoint it.
    """
    return df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())


def row_numbers(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """``row_number`` per ``keys`` (none: over all rows) by ``order`` (which must be a total order) as ``rank``.

    Rows are numbered inside ranges of (keys, order), and what a key has in the ranges
    before is added: counts by (key, range), summed up. A range border cuts at most one
    key, so there are fewer such sums than ranges, and they are broadcast.
    """
    placed = range_parts(df, [*keys, *order], "_part").checkpoint(eager=True)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "_part", F.sum("_n").over(before).alias("_base")).where(F.col("_base") > 0)
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    ranked = placed.withColumn("_inside", inside).join(F.broadcast(bases), [*keys, "_part"], "left")
    ranked = ranked.withColumn(rank, F.col("_inside") + F.coalesce(F.col("_base"), F.lit(0)))
    return ranked.drop("_part", "_inside", "_base")
