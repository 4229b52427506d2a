"""Queries: dataset construction (DSC-1..6, WIN-3, AGG-14, LIM-1/2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..session import scratch_path
from . import standins as S
from .registry import query

HEAD_N = 10
SAMPLE_N = 10
SAMPLE_SEED = 7

S.register("pert_split", None, D.sql_axis_split("pairs", "pert", D.PERT_SPLIT), ["pairs"])
S.register("gene_split", None, D.sql_axis_split("pairs", "gene", D.GENE_SPLIT), ["pairs"])
S.register("assigned", None, """SELECT p.*, s.split FROM pairs p JOIN pert_split s ON s.pert = p.pert
JOIN gene_split g ON g.gene = p.gene AND g.split = s.split""", ["pairs", "pert_split", "gene_split"])
S.register("eligible", None, f"""SELECT pert, count(*) FILTER (WHERE label IN ('up', 'down')) AS n_degs
FROM pairs GROUP BY pert HAVING count(*) FILTER (WHERE label IN ('up', 'down')) >= {D.MIN_DEGS}""", ["pairs"])
S.register("positives", None, f"""SELECT * FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.pert ORDER BY a.fdr, abs(a.lfc) DESC, a.gene) AS rank
  FROM assigned a SEMI JOIN eligible e ON a.pert = e.pert WHERE a.label IN ('up', 'down'))
WHERE rank <= {D.TOP_DEGS}""", ["assigned", "eligible"])
S.register("neg_cand", None, f"""SELECT a.*, md5(a.id) AS h FROM assigned a SEMI JOIN eligible e ON a.pert = e.pert
WHERE a.label = 'none' AND abs(a.lfc) < {S.dbl(D.NEG_ABS_LFC_MAX)}""", ["assigned", "eligible"])
S.register("neg_pass1", None, """SELECT * FROM (
  SELECT c.*, k.k, row_number() OVER (PARTITION BY c.gene ORDER BY c.h, c.id) AS r
  FROM neg_cand c JOIN (SELECT gene, count(*) AS k FROM positives GROUP BY gene) k USING (gene))
WHERE r <= k""", ["neg_cand", "positives"])
S.register("neg_pass2", None, """SELECT * FROM (
  SELECT c.*, d.k, row_number() OVER (PARTITION BY c.pert ORDER BY c.h, c.id) AS r
  FROM (SELECT * FROM neg_cand WHERE id NOT IN (SELECT id FROM neg_pass1)) c
  JOIN (SELECT p.pert, p.np - coalesce(g.ng, 0) AS k FROM (SELECT pert, count(*) AS np FROM positives GROUP BY pert) p
        LEFT JOIN (SELECT pert, count(*) AS ng FROM neg_pass1 GROUP BY pert) g USING (pert)
        WHERE p.np - coalesce(g.ng, 0) > 0) d USING (pert))
WHERE r <= k""", ["neg_cand", "neg_pass1", "positives"])


def _pairs(spark, sf):
    return S.pairs(spark, sf)


@query("ternary_labels", S.with_ctes("SELECT id, label FROM pairs", "pairs"))
def ternary_labels(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-1: up / down / none from fold change and FDR."""
    return _pairs(spark, sf).select("id", "label")


@query("two_axis_split", S.with_ctes("SELECT id, split FROM assigned", "assigned"))
def two_axis_split(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-2: splits of exact shares on both axes; only split-consistent pairs kept."""
    return D.two_axis_split(_pairs(spark, sf)).select("id", "split")


@query("eligible_perts", S.with_ctes("SELECT pert, n_degs FROM eligible", "eligible"))
def eligible_perts(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-3: perturbations with at least 9 DEGs."""
    return D.eligible_perts(_pairs(spark, sf))


@query("top_degs_per_pert", S.with_ctes(f"""SELECT pert, gene, CAST(rank AS INTEGER) AS rank FROM (
  SELECT pert, gene, row_number() OVER (PARTITION BY pert ORDER BY fdr, abs(lfc) DESC, gene) AS rank
  FROM pairs WHERE label IN ('up', 'down')) WHERE rank <= {D.TOP_DEGS}""", "pairs"))
def top_degs_per_pert(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-3: up to 9 most significant genes per perturbation (partial top-k before the shuffle)."""
    return D.top_degs_per_pert(_pairs(spark, sf)).select("pert", "gene", "rank")


@query("positive_pairs", S.with_ctes("SELECT pert, gene, split, label, CAST(rank AS INTEGER) AS rank FROM positives", "positives"))
def positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-4: eligible, split-consistent pairs; top DEGs per perturbation."""
    return D.positive_pairs(_pairs(spark, sf)).select("pert", "gene", "split", "label", "rank")


@query("negative_pairs", S.with_ctes("""SELECT pert, gene, split, 1 AS pass FROM neg_pass1
UNION ALL SELECT pert, gene, split, 2 AS pass FROM neg_pass2""", "neg_pass1", "neg_pass2"))
def negative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-5: negatives matched per gene, then topped up per perturbation."""
    return D.negative_pairs(_pairs(spark, sf)).select("pert", "gene", "split", "pass")


@query("negative_match_balance", S.with_ctes("\nUNION ALL ".join(f"""SELECT '{k}' AS kind, w.{k} AS key, w.n AS wanted, greatest(w.n - coalesce(c.n, 0), 0) AS shortfall
FROM (SELECT {k}, count(*) AS n FROM positives GROUP BY {k}) w LEFT JOIN (SELECT {k}, count(*) AS n FROM neg_cand GROUP BY {k}) c USING ({k})"""
    for k in ("pert", "gene")), "positives", "neg_cand"))
def negative_match_balance(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-5: negatives by a largest match within the genes' quotas, then topped up. What each
    perturbation and gene lacks in the result is what it lacks in candidates, which SQL
    can tell; that no more pairs than must be go beyond quotas is held in the tests
    against augmenting paths."""
    pairs = _pairs(spark, sf)
    eligible = D.match_input(pairs)
    return D.match_balance(D.matched_negative_pairs(pairs, eligible), D.positive_pairs(pairs, eligible))


def _leak_sql(src: str) -> str:
    return f"""SELECT 'pert' AS kind, pert AS key, count(DISTINCT split) AS n_splits FROM {src}
GROUP BY pert HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'gene', gene, count(DISTINCT split) FROM {src} GROUP BY gene HAVING count(DISTINCT split) > 1"""


S.register("pair_split", None, f"SELECT *, {D.sql_split_of(D.sql_hash_pct('id'), D.PERT_SPLIT)} AS split FROM pairs", ["pairs"])


@query("split_leakage", S.with_ctes(_leak_sql("assigned"), "assigned"))
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-6 / SET-3: keys of the two-axis split in more than one split (must be empty)."""
    return D.split_leakage(D.two_axis_split(_pairs(spark, sf)))


@query("split_leakage_by_pair", S.with_ctes(_leak_sql("pair_split"), "pair_split"))
def split_leakage_by_pair(spark: SparkSession, sf: str) -> DataFrame:
    """DSC-6 / SET-3: the same check of a split by pair, which leaks."""
    return D.split_leakage(D.pair_hash_split(_pairs(spark, sf)))


@query("dataset_profile", S.with_ctes("""SELECT split, count(DISTINCT pert) AS n_perts, count(DISTINCT gene) AS n_genes,
  count(*) AS n_rows, count(*) FILTER (WHERE label = 'up') AS n_up, count(*) FILTER (WHERE label = 'down') AS n_down,
  count(*) FILTER (WHERE label = 'none') AS n_none FROM assigned GROUP BY split""", "assigned"))
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14: per split: perturbations, genes, rows, label counts."""
    return D.dataset_profile(D.two_axis_split(_pairs(spark, sf)))


N_BATCHES = 4
SKETCH_ERROR = 0.04  # five standard errors of the sketches


@query("profile_sketches", S.with_ctes("""SELECT split, count(DISTINCT pert) AS n_perts, count(DISTINCT gene) AS n_genes,
  count(*) AS n_rows, count(*) FILTER (WHERE label = 'up') AS n_up, count(*) FILTER (WHERE label = 'down') AS n_down,
  count(*) FILTER (WHERE label = 'none') AS n_none, true AS perts_close, true AS genes_close, true AS union_is_whole
FROM assigned GROUP BY split""", "assigned"))
def profile_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14: pairs come in four batches; each leaves its sketches in a store, and the profile
    is merged from them. The estimates are within the stated error of the exact counts
    and equal those of a sketch of the whole."""
    path = scratch_path(spark, "profile-sketches")
    assigned = D.two_axis_split(_pairs(spark, sf)).withColumn("batch", F.pmod("gene_key", F.lit(N_BATCHES)))
    D.profile_sketch(assigned, ["batch"]).write.partitionBy("batch").parquet(path)
    merged = D.merged_profile(spark.read.parquet(path)).withColumnsRenamed({"n_perts": "est_perts", "n_genes": "est_genes"})
    whole = D.merged_profile(D.profile_sketch(assigned)).select("split", F.col("n_perts").alias("all_perts"), F.col("n_genes").alias("all_genes"))
    rows = D.dataset_profile(assigned).select("split", "n_perts", "n_genes").join(merged, "split").join(whole, "split")

    def close(c: str) -> Column:
        return F.abs(F.col(f"est_{c}") - F.col(f"n_{c}")) <= F.lit(SKETCH_ERROR) * F.col(f"n_{c}")

    same = (F.col("est_perts") == F.col("all_perts")) & (F.col("est_genes") == F.col("all_genes"))
    return rows.select("split", "n_perts", "n_genes", "n_rows", "n_up", "n_down", "n_none",
                       close("perts").alias("perts_close"), close("genes").alias("genes_close"), same.alias("union_is_whole"))


@query("head_rows", S.with_ctes(f"SELECT id, pert, gene, label FROM pairs ORDER BY id LIMIT {HEAD_N}", "pairs"))
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    """LIM-1: the first rows by id (an explicit order; tables have none)."""
    return D.head_rows(_pairs(spark, sf).select("id", "pert", "gene", "label"), HEAD_N)


@query("sample_rows", S.with_ctes(
    f"SELECT id, pert, gene, label FROM pairs ORDER BY md5('{SAMPLE_SEED}' || '_' || id), id LIMIT {SAMPLE_N}", "pairs"))
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """LIM-2: a seeded sample, repeatable across partitionings (hash order)."""
    return D.sample_rows(_pairs(spark, sf).select("id", "pert", "gene", "label"), SAMPLE_N, SAMPLE_SEED)
