"""Sinks: submission CSV and the append-only response store (SNK-1/2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_submission(sub: DataFrame, path: str, single_file: bool = False, order: list[str] | None = None) -> None:
    """SNK-1: submission table to CSV with a header (quotes doubled).

    One DataFrame, so column lengths cannot differ. Without ``order`` every part file
    has the header, and ``single_file`` funnels the rows through one task; use that only
    for small, final files. With it the columns ``order`` (such as the ``position`` of
    ``read_pairs``) are left out and give the order of the rows: each part file holds a
    range of them, and the part files one after the other, by name, are one CSV file
    with one header.
    """
    if order is None:
        out = sub.coalesce(1) if single_file else sub
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    names = [c for c in sub.columns if c not in order]
    rows = sub.select(F.lit(1).alias("_row"), *order, *[F.col(c).cast("string").alias(c) for c in names])
    head = sub.sparkSession.range(1).select(
        F.lit(0).alias("_row"), *[F.lit(None).cast(sub.schema[c].dataType).alias(c) for c in order], *[F.lit(c).alias(c) for c in names])
    placed = head.unionByName(rows).repartitionByRange("_row", *order).sortWithinPartitions("_row", *order)
    placed.select(*names).write.mode("overwrite").option("escape", '"').csv(path)


def append_responses(batch: DataFrame, path: str) -> None:
    """SNK-2: append one batch of scored rows to the long Parquet store;
    the store is never rewritten as a whole."""
    batch.write.mode("append").option("compression", "zstd").parquet(path)


def latest_responses(store: DataFrame, keys=("id", "seed"), order: str = "batch", tasks: int | None = None) -> DataFrame:
    """Read side of SNK-2: one row per key, the latest batch winning (a
    one-row top-k per key, limited map-side before the shuffle).

    With ``tasks`` the store is dealt out by key over so many tasks and each sorts its
    rows once: the form for a large store whose batches hold different keys or lie in
    different files, of which a limit before the shuffle drops nothing.
    """
    from ..operators.topk import top_k

    if tasks:
        store = store.repartition(tasks, *keys)
    return top_k(store, list(keys), [F.col(order).desc()], 1).drop("rank")
