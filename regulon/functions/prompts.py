"""Prompt projections: templates compiled once into ``concat`` expressions.

A template is parsed on the driver with ``string.Formatter`` into literal
pieces and named fields, then turned into one ``concat(lit, col, ...)``
expression. Values are never substituted by chained ``replace`` (that would
re-expand braces inside values), and ``{{``/``}}`` stay literal braces.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rstrip, sql_literal, sql_rstrip

# ── Fixed values: prompt texts ───────────────────────────────────────────
CELL_DESC = (
    "Mouse bone marrow-derived macrophages (BMDMs) are primary immune cells "
    "differentiated from bone marrow precursors using M-CSF."
)

PROMPT_ZERO = """You are an expert molecular biologist who studies how genes are related using Perturb-seq.

Context: {cell_desc}

Question: If you knockdown {pert} using CRISPRi in mouse BMDMs, what is the effect on {gene}?

Your answer must be one of:
A) Knockdown of {pert} results in up-regulation of {gene}.
B) Knockdown of {pert} results in down-regulation of {gene}.
C) Knockdown of {pert} does not significantly affect {gene}.

Answer:"""

EXAMPLE_BLOCK = """Example:
- Perturbed gene: {pert}
- Gene of interest: {gene}
Answer: {answer}"""

PROMPT_FEWSHOT = """You are an expert molecular biologist who studies how genes are related using Perturb-seq.

You are given as Input:
- Perturbed gene: the gene that is perturbed via CRISPRi knockdown
- Gene of interest: the gene whose expression change you wish to predict

Context: {cell_desc}

Question: If you knockdown the perturbed gene using CRISPRi, what is the effect on the gene of interest?

Your answer must end with one of these three choices and nothing else.
A) Knockdown of the perturbed gene results in up-regulation of the gene of interest.
B) Knockdown of the perturbed gene results in down-regulation of the gene of interest.
C) Knockdown of the perturbed gene does not significantly affect the gene of interest.

{examples_block}

Query:
- Perturbed gene: {pert}
- Gene of interest: {gene}
Answer:"""

ANSWERS = {
    "up": "A) Knockdown of the perturbed gene results in up-regulation of the gene of interest.",
    "down": "B) Knockdown of the perturbed gene results in down-regulation of the gene of interest.",
    "none": "C) Knockdown of the perturbed gene does not significantly affect the gene of interest.",
}

ANSWER_TAG_SUFFIX = (
    "\n\n"
    "Return ONLY the final choice in this exact format:\n"
    "<answer>A</answer>, <answer>B</answer>, or <answer>C</answer>\n"
    "Do not include any other text."
)

CHAT_SYSTEM = (
    "You are an expert molecular biologist. Answer the "
    "question about gene expression with the correct choice."
)
CHAT_ANSWERS = {
    "up": "A) Knockdown of {pert} results in up-regulation of {gene}.",
    "down": "B) Knockdown of {pert} results in down-regulation of {gene}.",
    "none": "C) Knockdown of {pert} does not significantly affect {gene}.",
}
CHAT_LETTERS = {"up": "A", "down": "B", "none": "C"}
CHAT_UNKNOWN = "Label: {label}"
CHAT_UNKNOWN_LETTER = "C"
# ──────────────────────────────────────────────────────────────────────────

TEMPLATE_FIELDS = ("pert", "gene", "cell_desc")


def parse_template(template: str, allowed=TEMPLATE_FIELDS, required=("pert", "gene")) -> list[tuple[str, str | None]]:
    """Split a ``str.format`` template into (literal, field) pieces and check it."""
    pieces = []
    seen = set()
    for literal, field, spec, conv in string.Formatter().parse(template):
        if field is not None:
            if field not in allowed:
                raise ValueError(f"unknown placeholder {{{field}}} in template")
            if spec or conv:
                raise ValueError(f"format specs are not supported: {{{field}}}")
            seen.add(field)
        pieces.append((literal, field))
    for r in required:
        if r not in seen:
            raise ValueError(f"Template must contain placeholder {{{r}}}")
    return pieces


def compile_template(template: str, fields: dict[str, Column], allowed=None, required=("pert", "gene")) -> Column:
    """``template.format(**fields)`` as one native ``concat``."""
    parts: list[Column] = []
    for literal, field in parse_template(template, tuple(allowed or fields), required):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(fields[field])
    return F.concat(*parts)


def sql_template(template: str, fields: dict[str, str], allowed=None, required=("pert", "gene")) -> str:
    parts: list[str] = []
    for literal, field in parse_template(template, tuple(allowed or fields), required):
        if literal:
            parts.append(sql_literal(literal))
        if field is not None:
            parts.append(fields[field])
    return "(" + " || ".join(parts) + ")"


def zero_shot_prompt(pert: Column, gene: Column, cell_desc: str = CELL_DESC) -> Column:
    """PRJ-1."""
    return compile_template(PROMPT_ZERO, {"pert": pert, "gene": gene, "cell_desc": F.lit(cell_desc)})


def sql_zero_shot_prompt(pert: str, gene: str, cell_desc: str = CELL_DESC) -> str:
    return sql_template(PROMPT_ZERO, {"pert": pert, "gene": gene, "cell_desc": sql_literal(cell_desc)})


def answer_sentence(label: Column) -> Column:
    """Few-shot answer sentence; an unknown label is an error."""
    out = F.raise_error(F.concat(F.lit("unknown example label: "), F.coalesce(label, F.lit("null"))))
    for k, v in reversed(list(ANSWERS.items())):
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def example_block(pert: Column, gene: Column, label: Column) -> Column:
    return compile_template(EXAMPLE_BLOCK, {"pert": pert, "gene": gene, "answer": answer_sentence(label)},
                            required=("pert", "gene", "answer"))


def examples_block(examples: DataFrame, order: str = "ord") -> Column:
    """Blocks of an examples table joined by a blank line, in ``order``.

    Returned as a scalar subquery: evaluated once, bounded by the examples
    table (a handful of rows by definition), then used on every row.
    """
    blk = examples.select(
        F.struct(F.col(order).alias("o"), example_block(F.col("pert"), F.col("gene"), F.col("label")).alias("b")).alias("s")
    )
    joined = blk.agg(
        F.coalesce(
            F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n\n"),
            F.lit(""),
        )
    )
    return joined.scalar()


def few_shot_prompt(pert: Column, gene: Column, block: Column, cell_desc: str = CELL_DESC) -> Column:
    """PRJ-2: ``block`` from :func:`examples_block` (``""`` for an empty list)."""
    return compile_template(
        PROMPT_FEWSHOT,
        {"pert": pert, "gene": gene, "cell_desc": F.lit(cell_desc), "examples_block": block},
    )


def append_answer_tag(prompt: Column) -> Column:
    """PRJ-6: right-strip, then the answer-format instruction."""
    return F.concat(rstrip(prompt), F.lit(ANSWER_TAG_SUFFIX))


def sql_append_answer_tag(expr: str) -> str:
    return f"({sql_rstrip(expr)} || {sql_literal(ANSWER_TAG_SUFFIX)})"


def prompt_tokens(prompt: Column) -> Column:
    """PRJ-7 fallback count: code points // 4."""
    return F.floor(F.char_length(prompt) / F.lit(4)).cast("int")


def row_id(pert: Column, gene: Column) -> Column:
    """PRJ-9: ``{pert}_{gene}``."""
    return F.concat_ws("_", pert, gene)


def split_row_id(rid: Column) -> tuple[Column, Column]:
    """Inverse of :func:`row_id`: split at the first ``_``."""
    pos = F.instr(rid, "_")
    return (
        F.when(pos > 0, F.substring_index(rid, "_", 1)).otherwise(rid),
        F.when(pos > 0, F.substr(rid, pos + F.lit(1))),
    )


def chat_messages(pert: Column, gene: Column, label: Column, cell_desc: str = CELL_DESC) -> Column:
    """PRJ-8: array<struct<role, content>> of one training example."""
    fields = {"pert": pert, "gene": gene}
    sentence = compile_template(CHAT_UNKNOWN, {"label": F.coalesce(label, F.lit("nan"))}, required=("label",))
    letter = F.lit(CHAT_UNKNOWN_LETTER)
    for k in reversed(list(CHAT_ANSWERS)):
        sentence = F.when(label == k, compile_template(CHAT_ANSWERS[k], fields)).otherwise(sentence)
        letter = F.when(label == k, F.lit(CHAT_LETTERS[k])).otherwise(letter)
    assistant = F.concat(F.lit("<answer>"), letter, F.lit("</answer>\n"), sentence)
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(
        msg("system", F.lit(CHAT_SYSTEM)),
        msg("user", zero_shot_prompt(pert, gene, cell_desc)),
        msg("assistant", assistant),
    )


def sql_chat_assistant(pert: str, gene: str, label: str) -> str:
    fields = {"pert": pert, "gene": gene}
    arms = " ".join(
        f"WHEN {label} = '{k}' THEN '<answer>{CHAT_LETTERS[k]}</answer>' || chr(10) || {sql_template(v, fields)}"
        for k, v in CHAT_ANSWERS.items()
    )
    unk = sql_template(CHAT_UNKNOWN, {"label": f"coalesce({label}, 'nan')"}, required=("label",))
    return f"(CASE {arms} ELSE '<answer>{CHAT_UNKNOWN_LETTER}</answer>' || chr(10) || {unk} END)"


def resolve_prompts(rows: DataFrame, overrides: DataFrame | None = None, template: str | None = None) -> DataFrame:
    """PRJ-5 / JOI-3: (id, prompt) of ``rows`` (id, pert, gene): the row's own
    prompt in ``overrides`` (id, prompt; one row an id), else the user's template,
    else the built-in zero-shot prompt."""
    pert, gene = F.col("pert"), F.col("gene")
    prompt = zero_shot_prompt(pert, gene)
    if template is not None:
        prompt = compile_template(template, {"pert": pert, "gene": gene, "cell_desc": F.lit(CELL_DESC)})
    if overrides is None:
        return rows.select("id", prompt.alias("prompt"))
    own = overrides.select("id", F.struct("prompt").alias("_own"))
    return rows.join(own, "id", "left").select(
        "id", F.when(F.col("_own").isNotNull(), F.col("_own.prompt")).otherwise(prompt).alias("prompt"))
