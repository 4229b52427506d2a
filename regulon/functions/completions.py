"""Chat-completion records (JSON text) -> text, traces and token counts.

Parsed with Spark's VARIANT type: ``content`` may be a string or a list of
parts, and the variant tells the two apart without guessing from the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip

MSG = "$.choices[0].message"
PARTS = "array<struct<text:string,content:string>>"
THINK = rf"(?s)<think>{WS}*(.*?){WS}*</think>{WS}*(.*)"
MISSING_TRACE_C = "(no reasoning trace)"


def _get(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def completion_fields(json_text: Column, reasoning_content: bool = False) -> Column:
    """PRS-1: struct(reasoning, content, text, prompt_tokens, completion_tokens, total_tokens).

    ``reasoning_content`` also reads that older key (fine-tuned models). First
    choice only; list content is the parts' ``text`` (else ``content``)
    joined by newlines; ``text`` is the non-empty stripped reasoning and
    content joined by a blank line; missing usage counts are 0; no choices ->
    empty text.
    """
    v = F.try_parse_json(json_text)
    reasoning = _get(v, f"{MSG}.reasoning", "string")
    if reasoning_content:
        # only where the key itself is absent: a null or empty ``reasoning`` stays
        has_key = F.array_contains(F.coalesce(F.map_keys(_get(v, MSG, "map<string,variant>")), F.array().cast("array<string>")), "reasoning")
        reasoning = F.when(has_key, reasoning).otherwise(_get(v, f"{MSG}.reasoning_content", "string"))
    parts = _get(v, f"{MSG}.content", PARTS)
    content = F.when(
        parts.isNotNull(),
        F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], x["content"], F.lit(""))), "\n"),
    ).otherwise(F.coalesce(_get(v, f"{MSG}.content", "string"), F.lit("")))
    has_choice = _get(v, "$.choices[0]", "string").isNotNull() | F.coalesce(
        F.size(_get(v, "$.choices", "array<string>")) > 0, F.lit(False))
    r, c = strip(F.coalesce(reasoning, F.lit(""))), strip(content)
    text = F.when(has_choice, F.concat_ws("\n\n", F.filter(F.array(r, c), lambda x: x != F.lit("")))).otherwise(F.lit(""))
    usage = lambda k: F.coalesce(_get(v, f"$.usage.{k}", "double"), F.lit(0.0))
    return F.struct(
        F.when(has_choice, reasoning).alias("reasoning"),
        F.when(has_choice, content).alias("content"),
        text.alias("text"),
        usage("prompt_tokens").alias("prompt_tokens"),
        usage("completion_tokens").alias("completion_tokens"),
        usage("total_tokens").alias("total_tokens"),
    )


def split_think(content: Column, reasoning: Column) -> Column:
    """PRS-2: struct(reasoning_trace, response_trace).

    ``<think>…</think>rest`` in the stripped content (dot matches newline,
    first match); a non-empty server-side reasoning field wins.
    """
    text = strip(F.coalesce(content, F.lit("")))
    matched = text.rlike(THINK)
    server = strip(F.coalesce(reasoning, F.lit("")))
    reasoning_trace = F.when(server != "", server).when(
        matched, strip(F.regexp_extract(text, THINK, 1))).otherwise(F.lit(""))
    response = F.when(matched, strip(F.regexp_extract(text, THINK, 2))).otherwise(text)
    return F.struct(reasoning_trace.alias("reasoning_trace"), response.alias("response_trace"))


def assemble_trace(reasoning_trace: Column, response_trace: Column, missing: str = MISSING_TRACE_C) -> Column:
    """PRS-14: ``<think>\\n{r}\\n</think>\\n{resp}`` when reasoning exists, else
    the response; an empty result becomes the track's placeholder."""
    full = F.when(
        F.coalesce(reasoning_trace, F.lit("")) != "",
        F.concat(F.lit("<think>\n"), reasoning_trace, F.lit("\n</think>\n"), response_trace),
    ).otherwise(response_trace)
    return F.coalesce(F.nullif(full, F.lit("")), F.lit(missing))


def sql_split_think(content: str, reasoning: str) -> tuple[str, str]:
    """DuckDB twin of :func:`split_think`: (reasoning_trace, response_trace)."""
    from .text import sql_strip

    t = sql_strip(f"coalesce({content}, '')")
    m = f"regexp_matches({t}, '{THINK}')"
    srv = sql_strip(f"coalesce({reasoning}, '')")
    g1 = sql_strip(f"regexp_extract({t}, '{THINK}', 1)")
    g2 = sql_strip(f"regexp_extract({t}, '{THINK}', 2)")
    r = f"(CASE WHEN {srv} <> '' THEN {srv} WHEN {m} THEN {g1} ELSE '' END)"
    resp = f"(CASE WHEN {m} THEN {g2} ELSE {t} END)"
    return r, resp
