"""Queries: prompt projections (PRJ-1..9, JOI-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions.text import sql_literal
from . import standins as S
from .registry import query

# A user template of our own: all three placeholders and literal braces.
TEMPLATE = """Cell context: {cell_desc}
Perturbation: CRISPRi knockdown of {pert}.
Target gene: {gene}.
Reply with one letter in braces, e.g. {{A}}: A = up, B = down, C = no change.
Answer:"""
N_EXAMPLES = 3
OVERRIDE_FDR = 0.02


def _pairs(spark, sf):
    return S.pairs(spark, sf)


_ZERO = PR.sql_zero_shot_prompt("pert", "gene")


@query("zero_shot_prompts", S.with_ctes(f"SELECT id, {_ZERO} AS prompt FROM pairs", "pairs"))
def zero_shot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-1 / PRJ-3: the fixed ternary question for every pair."""
    p = _pairs(spark, sf)
    return p.select("id", PR.zero_shot_prompt(F.col("pert"), F.col("gene")).alias("prompt"))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot examples: the first N pairs by id (a top-N, bounded)."""
    p = _pairs(spark, sf).select("id", "pert", "gene", "label").orderBy("id").limit(N_EXAMPLES)
    return p.withColumn("ord", F.row_number().over(Window.orderBy("id")))


_BLOCK = PR.sql_template(PR.EXAMPLE_BLOCK, {
    "pert": "pert", "gene": "gene",
    "answer": "CASE label " + " ".join(f"WHEN '{k}' THEN {sql_literal(v)}" for k, v in PR.ANSWERS.items())
              + " ELSE error('unknown example label: ' || coalesce(label, 'null')) END"}, required=("pert", "gene", "answer"))
_FEW = PR.sql_template(PR.PROMPT_FEWSHOT, {
    "pert": "p.pert", "gene": "p.gene", "cell_desc": sql_literal(PR.CELL_DESC),
    "examples_block": f"(SELECT coalesce(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY id), '') FROM (SELECT * FROM pairs ORDER BY id LIMIT {N_EXAMPLES}))"})


@query("few_shot_prompts", S.with_ctes(f"SELECT p.id, {_FEW} AS prompt FROM pairs p", "pairs"))
def few_shot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-2: example blocks (from the data) before the query, for every pair."""
    block = PR.examples_block(examples(spark, sf))
    p = _pairs(spark, sf)
    return p.select("id", PR.few_shot_prompt(F.col("pert"), F.col("gene"), block).alias("prompt"))


_TPL = PR.sql_template(TEMPLATE, {"pert": "pert", "gene": "gene", "cell_desc": sql_literal(PR.CELL_DESC)})


@query("template_prompts", S.with_ctes(f"SELECT id, {_TPL} AS prompt FROM pairs", "pairs"))
def template_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-4: a user template compiled once into a concat (braces kept literal)."""
    p = _pairs(spark, sf)
    fields = {"pert": F.col("pert"), "gene": F.col("gene"), "cell_desc": F.lit(PR.CELL_DESC)}
    return p.select("id", PR.compile_template(TEMPLATE, fields).alias("prompt"))


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row prompt overrides: pairs with a very small FDR get their own text."""
    p = _pairs(spark, sf).where(F.col("fdr") < OVERRIDE_FDR)
    return p.select("id", F.concat(F.lit("Custom question about "), F.col("id")).alias("prompt"))


_TPL_P = PR.sql_template(TEMPLATE, {"pert": "p.pert", "gene": "p.gene", "cell_desc": sql_literal(PR.CELL_DESC)})


@query("resolved_prompts", S.with_ctes(f"""SELECT p.id,
  coalesce(o.prompt, {_TPL_P}) AS prompt
FROM pairs p LEFT JOIN (SELECT id, 'Custom question about ' || id AS prompt FROM pairs WHERE fdr < {S.dbl(OVERRIDE_FDR)}) o
USING (id)""", "pairs"))
def resolved_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-5 / JOI-3: per-id override, else the template."""
    return PR.resolve_prompts(_pairs(spark, sf), overrides(spark, sf), TEMPLATE)


@query("resolved_prompts_default", S.with_ctes(f"""SELECT p.id,
  coalesce(o.prompt, {PR.sql_zero_shot_prompt('p.pert', 'p.gene')}) AS prompt
FROM pairs p LEFT JOIN (SELECT id, 'Custom question about ' || id AS prompt FROM pairs WHERE fdr < {S.dbl(OVERRIDE_FDR)}) o
USING (id)""", "pairs"))
def resolved_prompts_default(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-5: without a template the built-in prompt is the last level."""
    return PR.resolve_prompts(_pairs(spark, sf), overrides(spark, sf))


@query("tagged_prompt_tokens", S.with_ctes(f"""SELECT id, CAST(floor(length(t) / 4) AS INTEGER) AS prompt_tokens,
  CAST(length(t) AS INTEGER) AS n_chars, t AS tagged_prompt
FROM (SELECT id, {PR.sql_append_answer_tag(_ZERO)} AS t FROM pairs)""", "pairs"))
def tagged_prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-6 + PRJ-7: answer-format instruction appended; token count = chars // 4."""
    p = _pairs(spark, sf)
    t = PR.append_answer_tag(PR.zero_shot_prompt(F.col("pert"), F.col("gene")))
    x = p.select("id", t.alias("t"))
    return x.select("id", PR.prompt_tokens(F.col("t")).alias("prompt_tokens"),
                    F.char_length("t").alias("n_chars"), F.col("t").alias("tagged_prompt"))


@query("chat_examples", S.with_ctes(f"""SELECT id, 3 AS n_messages, {sql_literal(PR.CHAT_SYSTEM)} AS system,
  {_ZERO} AS user_prompt, {PR.sql_chat_assistant('pert', 'gene', 'label')} AS assistant FROM pairs""", "pairs"))
def chat_examples(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-8: system / user / assistant messages for every labelled pair."""
    p = _pairs(spark, sf).select("id", PR.chat_messages(F.col("pert"), F.col("gene"), F.col("label")).alias("m"))
    return p.select("id", F.size("m").alias("n_messages"), F.col("m")[0]["content"].alias("system"),
                    F.col("m")[1]["content"].alias("user_prompt"), F.col("m")[2]["content"].alias("assistant"))


@query("row_ids", S.with_ctes("""SELECT pert || '_' || gene AS id, split_part(pert || '_' || gene, '_', 1) AS pert_of_id,
  substr(pert || '_' || gene, strpos(pert || '_' || gene, '_') + 1) AS gene_of_id FROM de""", "de"))
def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-9: ``{pert}_{gene}`` and its inverse (split at the first ``_``)."""
    d = S.de(spark, sf).select(PR.row_id(F.col("pert"), F.col("gene")).alias("id"))
    pert, gene = PR.split_row_id(F.col("id"))
    return d.select("id", pert.alias("pert_of_id"), gene.alias("gene_of_id"))
