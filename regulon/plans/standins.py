"""Stand-in inputs derived from the driver's tables.

The reference ships no pair data, so each input it expects is derived, in
Spark, from the driver's parquet tables (its size grows with them), and the
same derivation is written once more as a DuckDB CTE for the oracle.

Each stand-in is registered as ``(builder, sql, deps)``: ``builder(spark, sf)``
returns the DataFrame, ``sql`` is the CTE body, ``deps`` the CTEs it reads.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_literal

SEEDS = [42, 43, 44]
LOG2_FC_MIN = math.log2(1.5)
FDR_MAX = 0.05

# Response texts of the stand-in run: clean, tagged, ambiguous, blank and
# multi-line answers, so every parse branch is exercised on every run.
CATALOGUE = [
    "A) Knockdown of the perturbed gene results in up-regulation of the gene of interest.",
    "B) down-regulation",
    "C) does not significantly affect",
    "I don't know",
    "",
    "   \n  ",
    "The gene does not significantly increase.\nAnswer: b",
    "A) yes\nAnswer:",
    "does not significantly increase",
    "<answer>A</answer>",
    "Let me think about this.\n<answer> c </answer>",
    "Reasoning about the pathway first.\nFinal Answer: B",
    "**A)** up",
    "No.",
    "No",
    "No..",
    "Final Answer : c",
    "Expression will probably decrease.\nAnswer: B) down",
    "<think>\nweighing the evidence\n</think>\n<answer>B</answer>",
    "The knockdown has no significant effect on expression.",
    "Upregulation is likely; answer: A",
    "It could increase or decrease; unclear.",
    "C",
    "Answer: A\nAnswer: C",
    "Knockdown does not result in differential expression of the target.",
]
EFFECTS = ["Up", "Down", "NoEffect", "Maybe"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dbl(x: float) -> str:
    """A DuckDB double literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


# ── de(pert_key, gene_key, pert, gene, lfc, fdr) ──────────────────────────

_MATERIALIZED: dict[tuple[str, str, str], str] = {}


def materialized(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a derived input once per process to the shared folder and read it
    back: the pair table is a stored table in a real pipeline, so queries start
    from a scan instead of re-deriving it. Its files and their number follow the
    data; later shuffles are sized at run time.
    """
    from ..session import ensure_checkpoint_dir, scratch_path

    key = (ensure_checkpoint_dir(spark), sf.rstrip("/"), name)
    if key not in _MATERIALIZED:
        path = scratch_path(spark, f"standin-{name}")
        build().write.parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(_MATERIALIZED[key])


PAIR_KEYS = ["pert_key", "gene_key"]


def de(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "de", lambda: derive_de(spark, sf))


def derive_de(spark: SparkSession, sf: str) -> DataFrame:
    """The DE stand-in: ``lineitem`` grouped by (supplier, part)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("pert_key"), F.col("l_partkey").alias("gene_key")
    ).agg(
        ((F.max("l_quantity") - F.lit(25.0)) / F.lit(12.0)).alias("lfc"),
        F.min("l_discount").alias("fdr"),
    ).select(
        "pert_key", "gene_key",
        F.concat(F.lit("S"), F.col("pert_key").cast("string")).alias("pert"),
        F.concat(F.lit("G"), F.col("gene_key").cast("string")).alias("gene"),
        "lfc", "fdr",
    )


DE_SQL = """SELECT l_suppkey AS pert_key, l_partkey AS gene_key,
  'S' || CAST(l_suppkey AS VARCHAR) AS pert, 'G' || CAST(l_partkey AS VARCHAR) AS gene,
  (max(l_quantity) - CAST(25.0 AS DOUBLE)) / CAST(12.0 AS DOUBLE) AS lfc, min(l_discount) AS fdr
FROM lineitem GROUP BY l_suppkey, l_partkey"""


# ── pairs(pert_key, gene_key, id, pert, gene, label, lfc, fdr) ────────────

def pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.datasets import ternary_label

    d = de(spark, sf)
    return d.select(
        "pert_key", "gene_key",
        F.concat_ws("_", "pert", "gene").alias("id"),
        "pert", "gene",
        ternary_label(F.col("lfc"), F.col("fdr")).alias("label"),
        "lfc", "fdr",
    )


PAIRS_SQL = f"""SELECT pert_key, gene_key, pert || '_' || gene AS id, pert, gene,
  CASE WHEN fdr < {dbl(FDR_MAX)} AND lfc >= {dbl(LOG2_FC_MIN)} THEN 'up'
       WHEN fdr < {dbl(FDR_MAX)} AND lfc <= {dbl(-LOG2_FC_MIN)} THEN 'down' ELSE 'none' END AS label,
  lfc, fdr
FROM de"""


# ── solution(pert_key, gene_key, id, label, usage) ────────────────────────

def solution(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return p.select(
        "pert_key", "gene_key", "id", "label",
        F.when(F.pmod("gene_key", F.lit(3)) == 0, "Private").otherwise("Public").alias("usage"),
    )


SOLUTION_SQL = """SELECT pert_key, gene_key, id, label,
  CASE WHEN gene_key % 3 = 0 THEN 'Private' ELSE 'Public' END AS usage FROM pairs"""


# ── catalogue(k, t) and responses(pert_key, gene_key, id, seed, k, text, total_tokens, effect)

def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as JVM literals (no Python-side RDD behind it)."""
    rows = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("t")) for i, t in enumerate(CATALOGUE)])
    return spark.range(1).select(F.inline(rows))


CATALOGUE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {sql_literal(t)})" for i, t in enumerate(CATALOGUE)
) + ") AS c(k, t)"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    n = len(CATALOGUE)
    p = pairs(spark, sf)
    x = p.select("pert_key", "gene_key", "id", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    x = x.withColumn(
        "k", F.pmod(F.col("pert_key") * 7 + F.col("gene_key") * 3 + F.col("seed") * 5, F.lit(n)).cast("int")
    )
    # the catalogue is a fixed 22-row table: a proven broadcast bound
    r = x.join(F.broadcast(catalogue(spark)), "k")
    return r.select(
        "pert_key", "gene_key", "id", "seed", "k",
        F.col("t").alias("text"),
        (F.char_length("t") + F.lit(100)).cast("long").alias("total_tokens"),
        F.element_at(F.array(*[F.lit(e) for e in EFFECTS]),
                     (F.pmod(F.col("k") + F.col("seed"), F.lit(len(EFFECTS))) + 1).cast("int")).alias("effect"),
    )


RESPONSES_SQL = f"""SELECT p.pert_key, p.gene_key, p.id, s.seed,
  CAST((p.pert_key * 7 + p.gene_key * 3 + s.seed * 5) % {len(CATALOGUE)} AS INTEGER) AS k
FROM pairs p, (VALUES {", ".join(f"({s})" for s in SEEDS)}) AS s(seed)"""

RESPONSES_FULL_SQL = f"""SELECT r.pert_key, r.gene_key, r.id, r.seed, r.k, c.t AS text,
  CAST(length(c.t) + 100 AS BIGINT) AS total_tokens,
  [{", ".join(repr(e) for e in EFFECTS)}][((r.k + r.seed) % {len(EFFECTS)}) + 1] AS effect
FROM responses_keys r JOIN catalogue c USING (k)"""


# ── registry ─────────────────────────────────────────────────────────────

STANDINS: dict[str, tuple[Callable | None, str, list[str]]] = {
    "de": (de, DE_SQL, []),
    "pairs": (pairs, PAIRS_SQL, ["de"]),
    "solution": (solution, SOLUTION_SQL, ["pairs"]),
    "catalogue": (None, CATALOGUE_SQL, []),
    "responses_keys": (None, RESPONSES_SQL, ["pairs"]),
    "responses": (responses, RESPONSES_FULL_SQL, ["responses_keys", "catalogue"]),
}


def register(name: str, builder: Callable | None, sql: str, deps: list[str]) -> None:
    STANDINS[name] = (builder, sql, deps)


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in STANDINS[n][2]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{STANDINS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
