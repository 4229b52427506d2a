"""Queries: cells and differential expression (ARR-1/2, JOI-7/8, WIN-1/2, SRC-5..7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as CE
from ..session import scratch_path
from ..sources import readers as RD
from . import standins as S
from .registry import query

TOKEN_OFFSET = 2          # token ids 0..2 are special (not in the vocabulary)
GENE_MOD = 97             # tokens per cell are a permutation of 0..96
SCAN_N = 5
DRUG = "S1"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells from ``embeddings``: sparse (token, value) arrays plus metadata."""
    return cells_of(S.table(spark, sf, "embeddings"))


def cells_of(e: DataFrame) -> DataFrame:
    """The same for any frame of that table, batch or stream."""
    genes = F.transform("embedding", lambda x, i: F.pmod(F.col("vec_id") * 7 + i * 13, F.lit(GENE_MOD)).cast("int"))
    return e.select(
        F.col("vec_id").alias("cell_id"),
        F.concat(F.lit("line"), F.col("label").cast("string")).alias("cell_line_id"),
        F.concat(F.lit("drug"), F.pmod("vec_id", F.lit(7)).cast("string")).alias("drug"),
        genes.alias("genes"), F.col("embedding").alias("expressions"),
    )


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Gene vocabulary from ``part``: token id = part key + 2, symbol = name."""
    p = S.table(spark, sf, "part")
    return p.select((F.col("p_partkey") + TOKEN_OFFSET).cast("int").alias("token_id"), F.col("p_name").alias("symbol"))


S.register("cells", None, f"""SELECT vec_id AS cell_id, 'line' || CAST(label AS VARCHAR) AS cell_line_id,
  'drug' || CAST(vec_id % 7 AS VARCHAR) AS drug,
  list_transform(embedding, lambda x, i: CAST((vec_id * 7 + (i - 1) * 13) % {GENE_MOD} AS INTEGER)) AS genes,
  embedding AS expressions FROM embeddings""", [])
S.register("vocab", None, f"SELECT CAST(p_partkey + {TOKEN_OFFSET} AS INTEGER) AS token_id, p_name AS symbol FROM part", [])
S.register("entries", None, """SELECT cell_id, unnest(genes) AS token, unnest(expressions) AS expr FROM cells""", ["cells"])
S.register("decoded", None, "SELECT e.cell_id, e.token, e.expr, v.symbol FROM entries e JOIN vocab v ON e.token = v.token_id",
           ["entries", "vocab"])


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    ent = CE.zip_sparse(cells(spark, sf), keep=["cell_id"])
    return CE.decode_tokens(ent, vocab(spark, sf))


@query("zip_sparse", S.with_ctes("SELECT cell_id, token, expr FROM entries", "entries"))
def zip_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-1: parallel arrays -> (cell, token, value) rows."""
    return CE.zip_sparse(cells(spark, sf), keep=["cell_id"])


@query("cell_summary", S.with_ctes(
    "SELECT cell_id, cell_line_id, drug, CAST(len(genes) AS INTEGER) AS n_genes, list_max(expressions) AS max_expr FROM cells", "cells"))
def cell_summary(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-2: per-cell metadata and array sizes."""
    return CE.cell_summary(cells(spark, sf), ["cell_id", "cell_line_id", "drug"])


@query("decode_tokens", S.with_ctes("SELECT cell_id, token, expr, symbol FROM decoded", "decoded"))
def decode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-7/8: known tokens only, named (one broadcast inner join)."""
    return decoded(spark, sf).select("cell_id", "token", "expr", "symbol")


@query("top_genes_per_cell", S.with_ctes(f"""SELECT cell_id, CAST(rank AS INTEGER) AS rank, token, symbol, expr FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY expr DESC, token) AS rank FROM decoded)
WHERE rank <= {CE.TOP_GENES}""", "decoded"))
def top_genes_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-1: the 10 highest expressed known genes per cell."""
    return CE.top_genes_per_cell(decoded(spark, sf)).select("cell_id", "rank", "token", "symbol", "expr")


S.register("de_table", None, "SELECT pert AS drug, gene, lfc AS log2FoldChange, fdr AS padj FROM de", ["de"])


def de_table(spark: SparkSession, sf: str) -> DataFrame:
    return S.de(spark, sf).select(F.col("pert").alias("drug"), "gene", F.col("lfc").alias("log2FoldChange"),
                                  F.col("fdr").alias("padj"))


@query("top_de_genes", S.with_ctes(f"""SELECT drug, direction, CAST(rank AS INTEGER) AS rank, gene, log2FoldChange FROM (
  SELECT drug, 'up' AS direction, gene, log2FoldChange,
    row_number() OVER (PARTITION BY drug ORDER BY log2FoldChange DESC NULLS LAST, gene) AS rank FROM de_table
  UNION ALL
  SELECT drug, 'down', gene, log2FoldChange,
    row_number() OVER (PARTITION BY drug ORDER BY log2FoldChange ASC NULLS LAST, gene) FROM de_table)
WHERE rank <= {CE.TOP_DE}""", "de_table"))
def top_de_genes(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-2 (every drug): 20 most up- and down-regulated genes per drug."""
    return CE.top_de_genes(de_table(spark, sf)).select("drug", "direction", "rank", "gene", "log2FoldChange")


@query("scan_de", S.with_ctes("SELECT drug, gene, log2FoldChange, padj FROM de_table", "de_table"))
def scan_de(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: all drugs of all DE shards."""
    path = scratch_path(spark, "de-shards")
    RD.write_de_shards(de_table(spark, sf), path)
    return RD.scan_de(spark, path).select("drug", "gene", "log2FoldChange", "padj")


@query("scan_de_drug", S.with_ctes(f"""SELECT drug, gene, log2FoldChange, padj FROM de_table WHERE drug = '{DRUG}'""", "de_table"))
def scan_de_drug(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5 for one drug: the filter reaches the scan."""
    path = scratch_path(spark, "de-shards")
    RD.write_de_shards(de_table(spark, sf), path)
    return RD.scan_de(spark, path, drug=DRUG).select("drug", "gene", "log2FoldChange", "padj")


@query("top_de_for_drug", S.with_ctes(f"""SELECT drug, gene, log2FoldChange FROM de_table WHERE drug = '{DRUG}'
ORDER BY log2FoldChange DESC NULLS LAST, gene LIMIT {CE.TOP_DE}""", "de_table"))
def top_de_for_drug(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-2 (one drug): filter + sort + limit (TakeOrderedAndProject)."""
    return CE.top_de_for_drug(de_table(spark, sf), DRUG).select("drug", "gene", "log2FoldChange")


@query("scan_vocab", S.with_ctes("SELECT token_id, symbol FROM vocab", "vocab"))
def scan_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6: the gene vocabulary as a dimension table."""
    return vocab(spark, sf)


@query("scan_cells", S.with_ctes(f"SELECT cell_id, cell_line_id, CAST(len(genes) AS INTEGER) AS n_genes FROM cells ORDER BY cell_id LIMIT {SCAN_N}", "cells"))
def scan_cells(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-7: the first cells (explicit order, then limit)."""
    c = cells(spark, sf).orderBy("cell_id").limit(SCAN_N)
    return c.select("cell_id", "cell_line_id", F.size("genes").alias("n_genes"))
