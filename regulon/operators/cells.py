"""Sparse single-cell arrays and differential-expression tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import top_k

TOP_GENES = 10
TOP_DE = 20


def zip_sparse(cells: DataFrame, genes: str = "genes", values: str = "expressions",
               keep: list[str] | None = None) -> DataFrame:
    """ARR-1: parallel (token, value) arrays -> one row per entry (narrow)."""
    keep = list(keep or ["cell_id"])
    z = cells.select(*keep, F.inline(F.arrays_zip(F.col(genes).alias("token"), F.col(values).alias("expr"))))
    return z


def cell_summary(cells: DataFrame, meta: list[str]) -> DataFrame:
    """ARR-2: per-cell metadata plus array sizes (a projection, no shuffle)."""
    return cells.select(*meta, F.size("genes").alias("n_genes"), F.array_max("expressions").alias("max_expr"))


def decode_tokens(entries: DataFrame, vocab: DataFrame) -> DataFrame:
    """JOI-7 + JOI-8: keep entries whose token is in the vocabulary and name
    them. One inner join; the planner and AQE pick its kind from measured sizes."""
    return entries.join(vocab, entries["token"] == vocab["token_id"], "inner").drop("token_id")


def top_genes_per_cell(decoded: DataFrame, cell: str = "cell_id", k: int = TOP_GENES) -> DataFrame:
    """WIN-1: k highest expressions per cell; ties by token. Spark limits each
    cell to k rows on the map side (partial ``WindowGroupLimit``) before the
    shuffle, so a cell's full array never crosses the network."""
    return top_k(decoded, [cell], [F.col("expr").desc(), F.col("token").asc()], k)


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def top_de_genes(de: DataFrame, k: int = TOP_DE, drug: str = "drug", gene: str = "gene",
                 value: str = "log2FoldChange") -> DataFrame:
    """WIN-2 (grouped): per drug, the k largest and k smallest fold changes,
    nulls (and NaN, read as null) last both ways. Adds direction and rank."""
    v = _nan_to_null(F.col(value))
    base = de.withColumn("_v", v)
    up = top_k(base, [drug], [F.col("_v").desc_nulls_last(), F.col(gene).asc()], k).withColumn("direction", F.lit("up"))
    down = top_k(base, [drug], [F.col("_v").asc_nulls_last(), F.col(gene).asc()], k).withColumn("direction", F.lit("down"))
    return up.unionByName(down).drop("_v")


def top_de_for_drug(de: DataFrame, drug_name: str, k: int = TOP_DE, ascending: bool = False,
                    drug: str = "drug", gene: str = "gene", value: str = "log2FoldChange") -> DataFrame:
    """WIN-2 (one drug): filter (pushed to the scan) + sort + limit, planned as
    ``TakeOrderedAndProject`` (a per-partition top-k, then a merge)."""
    v = _nan_to_null(F.col(value))
    order = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    return de.where(F.col(drug) == drug_name).orderBy(order, F.col(gene).asc()).limit(k)
