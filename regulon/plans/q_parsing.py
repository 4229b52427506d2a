"""Queries: response parsing (PRS-1..16), log-probs (PRJ-10, AGG-15), agent traces (AGG-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import completions as C
from ..functions import logprobs as L
from ..functions import parsing as P
from ..functions import traces as T
from ..functions.text import sql_strip
from . import standins as S
from .registry import query

N_CAT = len(S.CATALOGUE)


def _resp(spark, sf):
    return S.responses(spark, sf)


# ── PRS-3..9 over the run's responses ────────────────────────────────────

S.register("cat_parts", None, f"""SELECT k, t,
  {P.sql_answer_tag('t')} AS tag,
  {P.sql_answer_portion('t')} AS portion,
  {P.sql_answer_source('t')} AS source,
  {P.sql_parse_label('t')} AS parsed_label
FROM catalogue""", ["catalogue"])


@query("answer_tags", S.with_ctes(
    "SELECT r.id, r.seed, c.tag FROM responses_keys r JOIN cat_parts c USING (k)", "responses_keys", "cat_parts"))
def answer_tags(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-3: first answer-tag letter per response (null when absent)."""
    return _resp(spark, sf).select("id", "seed", P.answer_tag(F.col("text")).alias("tag"))


@query("answer_portions", S.with_ctes(
    "SELECT r.id, r.seed, c.portion FROM responses_keys r JOIN cat_parts c USING (k)", "responses_keys", "cat_parts"))
def answer_portions(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-4: final answer portion per response."""
    return _resp(spark, sf).select("id", "seed", P.answer_portion(F.col("text")).alias("portion"))


S.register("cat_flags", None, "SELECT k, " + ", ".join(
    f"regexp_matches(t, '(?im){rx}') AS f_{n}" for n, rx in P.CLASS_REGEX.items()) + " FROM catalogue", ["catalogue"])


@query("pattern_flags", S.with_ctes(
    "SELECT r.id, r.seed, c.f_up, c.f_down, c.f_none FROM responses_keys r JOIN cat_flags c USING (k)",
    "responses_keys", "cat_flags"))
def pattern_flags(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-5: which pattern classes match each response."""
    f = P.pattern_flags(F.col("text"))
    return _resp(spark, sf).select("id", "seed", *[c.alias(f"f_{k}") for k, c in f.items()])


@query("parse_answers", S.with_ctes(f"""SELECT r.id, r.seed, c.parsed_label,
  {P.sql_label_to_pred('c.parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('c.parsed_label', 'down')} AS prediction_down
FROM responses_keys r JOIN cat_parts c USING (k)""", "responses_keys", "cat_parts"))
def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-6/7/8: label and prediction pair for every raw response text."""
    return P.parse_answers(_resp(spark, sf), "text").select(
        "id", "seed", "parsed_label", "prediction_up", "prediction_down")


@query("answer_sources", S.with_ctes(
    "SELECT r.id, r.seed, c.source FROM responses_keys r JOIN cat_parts c USING (k)", "responses_keys", "cat_parts"))
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-9 (track A): tag letter if present, else the full text."""
    return _resp(spark, sf).select("id", "seed", P.answer_source(F.col("text")).alias("source"))


@query("enum_predictions", S.with_ctes(f"""SELECT id, seed, effect,
  CASE effect WHEN 'Up' THEN 'up' WHEN 'Down' THEN 'down' WHEN 'NoEffect' THEN 'none' END AS effect_label,
  {P.sql_label_to_pred("CASE effect WHEN 'Up' THEN 'up' WHEN 'Down' THEN 'down' WHEN 'NoEffect' THEN 'none' END", 'up')} AS prediction_up,
  {P.sql_label_to_pred("CASE effect WHEN 'Up' THEN 'up' WHEN 'Down' THEN 'down' WHEN 'NoEffect' THEN 'none' END", 'down')} AS prediction_down
FROM responses""", "responses"))
def enum_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-13: typed effect (Up / Down / NoEffect) -> prediction pair; others -> default."""
    r = _resp(spark, sf).withColumn("effect_label", P.enum_label(F.col("effect")))
    pred = P.label_to_pred(F.col("effect_label"))
    return r.select("id", "seed", "effect", "effect_label",
                    pred["prediction_up"].alias("prediction_up"), pred["prediction_down"].alias("prediction_down"))


# ── whole texts: assistant turns of conversations ────────────────────────

def assistant_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, whole, followed by a catalogue answer line."""
    conv = S.table(spark, sf, "conversations")
    k = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(N_CAT)).cast("int")
    c = S.catalogue(spark)
    return conv.withColumn("k", k).join(F.broadcast(c), "k").select(
        "conv_id", "turn", F.concat(F.col("text"), F.lit("\n"), F.col("t")).alias("answer_text"))


S.register("assistant_answers", None, f"""SELECT c.conv_id, c.turn, c.text || chr(10) || k.t AS answer_text
FROM conversations c JOIN catalogue k ON k.k = (c.conv_id * 3 + c.turn) % {N_CAT}""", ["catalogue"])


@query("parse_conversations", S.with_ctes(f"""SELECT conv_id, turn, parsed_label,
  {P.sql_label_to_pred('parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('parsed_label', 'down')} AS prediction_down
FROM (SELECT conv_id, turn, {P.sql_parse_label('answer_text')} AS parsed_label FROM assistant_answers)""",
    "assistant_answers"))
def parse_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-7 over whole multi-paragraph texts (every turn)."""
    return P.parse_answers(assistant_answers(spark, sf), "answer_text").select(
        "conv_id", "turn", "parsed_label", "prediction_up", "prediction_down")


@query("parse_documents", f"""SELECT doc_id, parsed_label, {P.sql_label_to_pred('parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('parsed_label', 'down')} AS prediction_down
FROM (SELECT doc_id, {P.sql_parse_label('text')} AS parsed_label FROM documents)""")
def parse_documents(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-7 over free prose: every whole document."""
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    return P.parse_answers(docs, "text").select("doc_id", "parsed_label", "prediction_up", "prediction_down")


# ── PRS-1 / PRS-2 / PRS-14: chat completions built from conversations ────

def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Chat-completion JSON per assistant turn: string or list content, optional
    reasoning field, optional ``<think>`` block, optional usage."""
    conv = S.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    think = (F.pmod("turn", F.lit(4)) == 1) & (F.pmod("conv_id", F.lit(3)) == 0)
    content = F.when(think, F.concat(F.lit("<think>\nplan for "), F.col("conv_id").cast("string"),
                                     F.lit("\n</think>\n"), F.col("text"))).otherwise(F.col("text"))
    reasoning = F.when(F.pmod("conv_id", F.lit(2)) == 1,
                       F.concat(F.lit("  thinking about "), F.col("conv_id").cast("string"), F.lit("  ")))
    n = F.char_length("text")
    usage = F.when(F.pmod("conv_id", F.lit(5)) != 0, F.struct(
        F.floor(n / 4).cast("long").alias("prompt_tokens"), n.cast("long").alias("completion_tokens"),
        (F.floor(n / 4) + n).cast("long").alias("total_tokens")))
    as_list = F.pmod("turn", F.lit(4)) == 3
    msg_str = F.struct(reasoning.alias("reasoning"), content.alias("content"))
    parts = F.array(F.struct(content.alias("text"), F.lit(None).cast("string").alias("content")),
                    F.struct(F.lit(None).cast("string").alias("text"), F.lit("(end)").alias("content")))
    msg_list = F.struct(reasoning.alias("reasoning"), parts.alias("content"))
    j_str = F.to_json(F.struct(F.array(F.struct(msg_str.alias("message"))).alias("choices"), usage.alias("usage")))
    j_list = F.to_json(F.struct(F.array(F.struct(msg_list.alias("message"))).alias("choices"), usage.alias("usage")))
    return conv.select("conv_id", "turn", F.when(as_list, j_list).otherwise(j_str).alias("json"))


S.register("completion_parts", None, f"""SELECT conv_id, turn,
  CASE WHEN conv_id % 2 = 1 THEN '  thinking about ' || CAST(conv_id AS VARCHAR) || '  ' END AS reasoning,
  CASE WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN '<think>' || chr(10) || 'plan for ' || CAST(conv_id AS VARCHAR)
       || chr(10) || '</think>' || chr(10) || text ELSE text END
  || CASE WHEN turn % 4 = 3 THEN chr(10) || '(end)' ELSE '' END AS content,
  CASE WHEN conv_id % 5 <> 0 THEN CAST(floor(length(text) / 4) AS DOUBLE) ELSE 0.0 END AS prompt_tokens,
  CASE WHEN conv_id % 5 <> 0 THEN CAST(length(text) AS DOUBLE) ELSE 0.0 END AS completion_tokens,
  CASE WHEN conv_id % 5 <> 0 THEN CAST(floor(length(text) / 4) + length(text) AS DOUBLE) ELSE 0.0 END AS total_tokens
FROM conversations WHERE role = 'assistant'""", [])

_R, _C = sql_strip("coalesce(reasoning, '')"), sql_strip("content")


@query("completion_text", S.with_ctes(f"""SELECT conv_id, turn,
  CASE WHEN {_R} <> '' AND {_C} <> '' THEN {_R} || chr(10) || chr(10) || {_C}
       WHEN {_R} <> '' THEN {_R} ELSE {_C} END AS text,
  prompt_tokens, completion_tokens, total_tokens
FROM completion_parts""", "completion_parts"))
def completion_text(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-1: normalized text and usage counts from chat-completion JSON."""
    f = C.completion_fields(F.col("json"))
    return completions(spark, sf).select(
        "conv_id", "turn", f["text"].alias("text"), f["prompt_tokens"].alias("prompt_tokens"),
        f["completion_tokens"].alias("completion_tokens"), f["total_tokens"].alias("total_tokens"))


_RT, _RESP = C.sql_split_think("content", "reasoning")


@query("think_traces", S.with_ctes(f"""SELECT conv_id, turn, reasoning_trace, response_trace,
  coalesce(nullif(CASE WHEN reasoning_trace <> '' THEN '<think>' || chr(10) || reasoning_trace || chr(10) || '</think>'
       || chr(10) || response_trace ELSE response_trace END, ''), '{C.MISSING_TRACE_C}') AS full_trace
FROM (SELECT conv_id, turn, {_RT} AS reasoning_trace, {_RESP} AS response_trace FROM completion_parts)""",
    "completion_parts"))
def think_traces(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-2 + PRS-14: reasoning / response split and the assembled trace."""
    f = C.completion_fields(F.col("json"))
    base = completions(spark, sf).select("conv_id", "turn", f.alias("f"))
    sp = C.split_think(F.col("f.content"), F.col("f.reasoning"))
    out = base.select("conv_id", "turn", sp.alias("s")).select("conv_id", "turn", "s.*")
    return out.withColumn("full_trace", C.assemble_trace(F.col("reasoning_trace"), F.col("response_trace")))


# ── PRS-10 / PRS-11 / AGG-15 / PRJ-10: token log-probabilities ───────────

def logprob_rows(spark: SparkSession, sf: str, non_finite: bool = False) -> DataFrame:
    """Token streams derived from ``lineitem``, written once to the shared
    folder (stored responses, as a scoring run would keep them)."""
    name = "logprobs-nf" if non_finite else "logprobs"
    return S.materialized(spark, sf, name, lambda: derive_logprob_rows(S.table(spark, sf, "lineitem"), non_finite))


def derive_logprob_rows(li: DataFrame, non_finite: bool = False) -> DataFrame:
    """One token stream per lineitem row: prefix tokens, a (sometimes split or
    unclosed) answer tag, an optional empty token, and top-3 candidates at the
    letter built from the row's numbers."""
    tok = lambda t, lp, top: F.struct(t.alias("token"), lp.cast("double").alias("logprob"), top.alias("top_logprobs"))
    none_top = F.array().cast("array<struct<token:string,logprob:double>>")
    letter = F.substring(F.lit("ABC"), (F.pmod("l_partkey", F.lit(3)) + 1).cast("int"), 1)
    a_lp = -F.col("l_discount") * 10
    if non_finite:
        a_lp = F.when(F.col("l_returnflag") == "R", F.lit(float("-inf"))).when(
            F.col("l_returnflag") == "A", F.lit(float("nan"))).otherwise(a_lp)
    top = F.array(
        F.struct(F.lit("A").alias("token"), a_lp.cast("double").alias("logprob")),
        F.struct(F.lit(">B").alias("token"), (-F.col("l_tax") * 10).cast("double").alias("logprob")),
        F.struct(F.when(F.col("l_quantity") > 25, F.lit(" c")).otherwise(F.lit("x")).alias("token"),
                 (-F.col("l_quantity") / 10).cast("double").alias("logprob")),
    )
    prefix = F.slice(F.array(*[tok(F.lit(w), F.lit(-0.01), none_top) for w in ("Let", " me", " think. ")]),
                     1, F.pmod("l_linenumber", F.lit(3)).cast("int"))
    open_tag = F.when(F.pmod("l_suppkey", F.lit(5)) == 0,
                      F.array(tok(F.lit("<ans"), F.lit(-0.1), none_top), tok(F.lit("wer>"), F.lit(-0.1), none_top))
                      ).otherwise(F.array(tok(F.lit("<answer>"), F.lit(-0.1), none_top)))
    empty = F.when(F.pmod("l_orderkey", F.lit(4)) == 0, F.array(tok(F.lit(""), F.lit(0.0), none_top))
                   ).otherwise(F.array().cast(L.LOGPROBS))
    letter_tok = F.when(F.pmod("l_orderkey", F.lit(7)) == 0, F.concat(F.lit(" "), letter)).otherwise(letter)
    close = F.when(F.pmod("l_suppkey", F.lit(11)) == 0, F.array().cast(L.LOGPROBS)).otherwise(
        F.array(tok(F.lit("</answer>"), F.lit(-0.2), none_top)))
    stream = F.concat(prefix, open_tag, empty, F.array(tok(letter_tok, F.lit(-0.05), top)), close)
    rid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.select(rid.alias("id"), stream.cast(L.LOGPROBS).alias("logprobs"),
                     F.concat(F.lit("Answer: "), letter).alias("text"))


def _lp_sql(non_finite: bool = False) -> str:
    e = "CAST([] AS STRUCT(token VARCHAR, logprob DOUBLE)[])"
    t = lambda tk, lp, top=e: f"{{'token': {tk}, 'logprob': CAST({lp} AS DOUBLE), 'top_logprobs': {top}}}"
    a_lp = "-l_discount * 10"
    if non_finite:
        a_lp = f"CASE WHEN l_returnflag = 'R' THEN CAST('-inf' AS DOUBLE) WHEN l_returnflag = 'A' THEN CAST('nan' AS DOUBLE) ELSE {a_lp} END"
    letter = "substr('ABC', CAST(l_partkey % 3 AS INTEGER) + 1, 1)"
    top = (f"[{{'token': 'A', 'logprob': CAST({a_lp} AS DOUBLE)}}, {{'token': '>B', 'logprob': CAST(-l_tax * 10 AS DOUBLE)}}, "
           f"{{'token': CASE WHEN l_quantity > 25 THEN ' c' ELSE 'x' END, 'logprob': CAST(-l_quantity / 10 AS DOUBLE)}}]")
    prefix = "list_slice([" + ", ".join(t(f"'{w}'", -0.01) for w in ("Let", " me", " think. ")) + "], 1, CAST(l_linenumber % 3 AS INTEGER))"
    open_tag = f"CASE WHEN l_suppkey % 5 = 0 THEN [{t(chr(39) + '<ans' + chr(39), -0.1)}, {t(chr(39) + 'wer>' + chr(39), -0.1)}] ELSE [{t(chr(39) + '<answer>' + chr(39), -0.1)}] END"
    empty = f"CASE WHEN l_orderkey % 4 = 0 THEN [{t(chr(39) * 2, 0.0)}] ELSE [] END"
    letter_tok = f"CASE WHEN l_orderkey % 7 = 0 THEN ' ' || {letter} ELSE {letter} END"
    close = f"CASE WHEN l_suppkey % 11 = 0 THEN [] ELSE [{t(chr(39) + '</answer>' + chr(39), -0.2)}] END"
    stream = f"list_concat(list_concat(list_concat(list_concat({prefix}, {open_tag}), {empty}), [{t(letter_tok, -0.05, top)}]), {close})"
    return f"""SELECT row_number() OVER () AS rk, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, {stream} AS logprobs,
  'Answer: ' || {letter} AS text FROM lineitem"""


S.register("lp_rows", None, _lp_sql(), [])
S.register("lp_rows_nf", None, _lp_sql(True), [])
_PREFIX = L.PREFIX_REGEX.replace("(?s)", "(?s)")
S.register("lp_pos", None, f"""SELECT rk, CASE WHEN regexp_matches(j, '{P.TAG_REGEX}') THEN length(regexp_extract(j, '{_PREFIX}', 1)) END AS p
FROM (SELECT rk, array_to_string(list_transform(logprobs, lambda x: coalesce(x.token, '')), '') AS j FROM lp_rows)""", ["lp_rows"])
S.register("lp_tok", None, """SELECT rk, i, t, coalesce(sum(length(coalesce(t.token, ''))) OVER (PARTITION BY rk ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
FROM (SELECT rk, unnest(logprobs) AS t, generate_subscripts(logprobs, 1) AS i FROM lp_rows)""", ["lp_rows"])


def _sql_letter(letter: str) -> str:
    return (f"list_filter(top, lambda e: e.logprob IS NOT NULL AND (upper({sql_strip('coalesce(e.token, chr(0))').replace('chr(0)', chr(39)*2)}) = '{letter}'"
            f" OR ends_with(upper({sql_strip('coalesce(e.token, chr(0))').replace('chr(0)', chr(39)*2)}), '>{letter}')))[1].logprob")


S.register("lp_hit", None, f"""SELECT rk, {_sql_letter('A')} AS a, {_sql_letter('B')} AS b, {_sql_letter('C')} AS c
FROM (SELECT t.rk, arg_min(t.t.top_logprobs, t.i) AS top FROM lp_tok t JOIN lp_pos p USING (rk)
      WHERE p.p IS NOT NULL AND p.p >= t.st AND p.p < t.st + length(coalesce(t.t.token, '')) GROUP BY t.rk)""",
           ["lp_tok", "lp_pos"])
S.register("lp_pred", None, """SELECT r.id, r.text,
  CASE WHEN h.a IS NOT NULL OR h.b IS NOT NULL OR h.c IS NOT NULL THEN
    exp(coalesce(h.a, least(h.a, h.b, h.c) - 20.0) - greatest(coalesce(h.a, least(h.a, h.b, h.c) - 20.0), coalesce(h.b, least(h.a, h.b, h.c) - 20.0), coalesce(h.c, least(h.a, h.b, h.c) - 20.0)))
  END AS ea,
  CASE WHEN h.a IS NOT NULL OR h.b IS NOT NULL OR h.c IS NOT NULL THEN
    exp(coalesce(h.b, least(h.a, h.b, h.c) - 20.0) - greatest(coalesce(h.a, least(h.a, h.b, h.c) - 20.0), coalesce(h.b, least(h.a, h.b, h.c) - 20.0), coalesce(h.c, least(h.a, h.b, h.c) - 20.0)))
  END AS eb,
  CASE WHEN h.a IS NOT NULL OR h.b IS NOT NULL OR h.c IS NOT NULL THEN
    exp(coalesce(h.c, least(h.a, h.b, h.c) - 20.0) - greatest(coalesce(h.a, least(h.a, h.b, h.c) - 20.0), coalesce(h.b, least(h.a, h.b, h.c) - 20.0), coalesce(h.c, least(h.a, h.b, h.c) - 20.0)))
  END AS ec
FROM lp_rows r LEFT JOIN lp_hit h USING (rk)""", ["lp_rows", "lp_hit"])


def lp_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = logprob_rows(spark, sf)
    return L.logprob_predictions(rows).select("id", "text", "lp_up", "lp_down")


@query("logprob_predictions", S.with_ctes(
    "SELECT id, round(ea / (ea + eb + ec), 9) AS lp_up, round(eb / (ea + eb + ec), 9) AS lp_down FROM lp_pred", "lp_pred"))
def logprob_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-10: (P(A), P(B)) at the answer token; null when no tag or candidate.
    Rounded to 9 digits (``exp`` differs in the last bit across engines)."""
    return lp_predictions(spark, sf).select("id", F.round("lp_up", 9).alias("lp_up"), F.round("lp_down", 9).alias("lp_down"))


_TXT = P.sql_parse_label("text")


@query("logprob_or_text", S.with_ctes(f"""SELECT id,
  round(CASE WHEN ea IS NOT NULL THEN ea / (ea + eb + ec) ELSE {P.sql_label_to_pred(_TXT, 'up')} END, 9) AS prediction_up,
  round(CASE WHEN ea IS NOT NULL THEN eb / (ea + eb + ec) ELSE {P.sql_label_to_pred(_TXT, 'down')} END, 9) AS prediction_down,
  ea IS NOT NULL AS used_logprobs FROM lp_pred""", "lp_pred"))
def logprob_or_text(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-11: log-prob prediction, else the text parse; flag which was used."""
    p = P.parse_answers(lp_predictions(spark, sf), "text")
    used = F.col("lp_up").isNotNull()
    return p.select(
        "id",
        F.round(F.when(used, F.col("lp_up")).otherwise(F.col("prediction_up")), 9).alias("prediction_up"),
        F.round(F.when(used, F.col("lp_down")).otherwise(F.col("prediction_down")), 9).alias("prediction_down"),
        used.alias("used_logprobs"),
    )


@query("logprob_coverage", S.with_ctes(
    "SELECT count(*) FILTER (WHERE ea IS NOT NULL) AS n_logprobs, count(*) FILTER (WHERE ea IS NULL) AS n_fallback FROM lp_pred",
    "lp_pred"))
def logprob_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15: how many rows used log-probs and how many fell back to text."""
    p = lp_predictions(spark, sf)
    return p.agg(F.count_if(F.col("lp_up").isNotNull()).alias("n_logprobs"),
                 F.count_if(F.col("lp_up").isNull()).alias("n_fallback"))


@query("sanitize_logprobs", S.with_ctes("""SELECT id,
  CAST(len(list_filter(flatten(list_transform(logprobs, lambda t: list_transform(t.top_logprobs, lambda e: e.logprob))),
      lambda x: isnan(x) OR isinf(x))) AS INTEGER) AS n_replaced,
  list_min(list_transform(flatten(list_transform(logprobs, lambda t: list_transform(t.top_logprobs, lambda e: e.logprob))),
      lambda x: CASE WHEN isnan(x) OR isinf(x) THEN CAST(-9999.0 AS DOUBLE) ELSE x END)) AS min_top_logprob
FROM lp_rows_nf""", "lp_rows_nf"))
def sanitize_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-10: non-finite log-probs replaced at every level; count and minimum."""
    rows = logprob_rows(spark, sf, non_finite=True)
    tops = F.flatten(F.transform("logprobs", lambda t: F.transform(t["top_logprobs"], lambda e: e["logprob"])))
    clean = F.flatten(F.transform(L.sanitize_logprobs(F.col("logprobs")),
                                  lambda t: F.transform(t["top_logprobs"], lambda e: e["logprob"])))
    n_bad = F.size(F.filter(tops, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return rows.select("id", n_bad.alias("n_replaced"), F.array_min(clean).alias("min_top_logprob"))


# ── PRS-12 / PRS-16 / AGG-13: agent trajectories from conversations ──────

def _tool(role):
    return F.when(role == "assistant", F.lit(T.SUBMIT_TOOL)).when(role == "user", F.lit("lookup_gene")).otherwise(F.lit("lookup_pert"))


ANSWER_VARIANTS = ["A", " b ", "C", "x"]


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """One trajectory map per conversation: turn = step, role -> tool name,
    assistant steps submit an answer. Also the final answer text (last turn)."""
    conv = S.table(spark, sf, "conversations")
    ans = F.element_at(F.array(*[F.lit(a) for a in ANSWER_VARIANTS]),
                       (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ANSWER_VARIANTS))) + 1).cast("int"))
    step = F.col("turn").cast("string")
    entries = F.array(
        F.struct(F.concat(F.lit(T.TOOL_NAME), step).alias("k"), _tool(F.col("role")).alias("v")),
        F.struct(F.concat(F.lit(T.TOOL_ARGS), step).alias("k"),
                 F.to_json(F.struct(ans.alias("answer"))).alias("v")),
        F.struct(F.concat(F.lit("observation_"), step).alias("k"), F.col("text").alias("v")),
    )
    # a conversation is a handful of turns: bounded per group
    g = conv.groupBy("conv_id").agg(
        F.flatten(F.collect_list(entries)).alias("e"),
        F.max_by("text", "turn").alias("final_text"),
        F.sum(F.char_length("text")).alias("chars"),
    )
    return g.select("conv_id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["v"]))).alias("trajectory"),
                    "final_text", (F.col("chars") / 4).cast("long").alias("tokens_used"))


S.register("traj_steps", None, f"""SELECT conv_id, turn, role, text,
  upper({sql_strip("[" + ", ".join(repr(a) for a in ANSWER_VARIANTS) + f"][((conv_id + turn) % {len(ANSWER_VARIANTS)}) + 1]")}) AS answer
FROM conversations""", [])
S.register("traj_submit", None, """SELECT conv_id,
  arg_max(answer, turn) FILTER (WHERE role = 'assistant') AS submitted,
  arg_max(answer, CAST(turn AS VARCHAR)) FILTER (WHERE role = 'assistant') AS submitted_lexical,
  arg_max(text, turn) AS final_text,
  count(*) AS num_tool_calls,
  count(DISTINCT CASE role WHEN 'assistant' THEN 'submit_answer' WHEN 'user' THEN 'lookup_gene' ELSE 'lookup_pert' END) AS num_distinct_tools,
  CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens_used
FROM traj_steps GROUP BY conv_id""", ["traj_steps"])


@query("submitted_answers", S.with_ctes(
    "SELECT conv_id, submitted, submitted_lexical FROM traj_submit", "traj_submit"))
def submitted_answers(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-12: last submitted answer per trajectory (numeric and string step order)."""
    t = trajectories(spark, sf)
    return t.select("conv_id", T.submitted_answer(F.col("trajectory")).alias("submitted"),
                    T.submitted_answer(F.col("trajectory"), lexical=True).alias("submitted_lexical"))


_SRC = P.sql_answer_source("final_text", "submitted")


@query("agent_predictions", S.with_ctes(f"""SELECT conv_id, source,
  {P.sql_label_to_pred(P.sql_parse_label('source'), 'up')} AS prediction_up,
  {P.sql_label_to_pred(P.sql_parse_label('source'), 'down')} AS prediction_down
FROM (SELECT conv_id, {_SRC} AS source FROM traj_submit)""", "traj_submit"))
def agent_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-9 (track B) + PRS-7: valid submitted letter, else tag, else final text."""
    t = trajectories(spark, sf).withColumn("submitted", T.submitted_answer(F.col("trajectory")))
    src = t.select("conv_id", P.answer_source(F.col("final_text"), F.col("submitted")).alias("source"))
    return P.parse_answers(src, "source").select("conv_id", "source", "prediction_up", "prediction_down")


@query("agent_usage", S.with_ctes(
    "SELECT conv_id, num_tool_calls, num_distinct_tools, tokens_used FROM traj_submit", "traj_submit"))
def agent_usage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13: tool calls, distinct tools and tokens per trajectory."""
    t = trajectories(spark, sf)
    return t.select("conv_id", T.tool_calls(F.col("trajectory")).cast("long").alias("num_tool_calls"),
                    T.distinct_tools(F.col("trajectory")).cast("long").alias("num_distinct_tools"), "tokens_used")


@query("history_tokens", S.with_ctes("""SELECT conv_id, CAST(coalesce(sum(total_tokens) FILTER (WHERE turn >= 2), 0) AS BIGINT) AS tokens_used
FROM completion_parts GROUP BY conv_id""", "completion_parts"))
def history_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13: tokens of the calls that a usage history gained since its second entry."""
    calls = completions(spark, sf).select("conv_id", "turn", F.get_json_object("json", "$.usage").alias("usage"))
    return T.history_tokens(calls, ["conv_id"], "turn", F.lit(2))


@query("stringify_trajectories", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS n_keys,
  CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE text END AS value FROM conversations""")
def stringify_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-16: JSON objects become maps of text, whole turns that are none become ``raw``."""
    conv = S.table(spark, sf, "conversations")
    raw = F.when(F.pmod("turn", F.lit(2)) == 0, F.to_json(F.struct("role", "turn"))).otherwise(F.col("text"))
    m = conv.select("conv_id", "turn", T.stringify_trajectory(raw).alias("m"))
    return m.select("conv_id", "turn", F.size("m").alias("n_keys"), F.coalesce(F.col("m")["turn"], F.col("m")["raw"]).alias("value"))


@query("multi_agent_usage", S.with_ctes("""SELECT conv_id,
  CAST(count(*) FILTER (WHERE role = 'system') + sum(CASE WHEN role <> 'system' THEN turn % 3 + 1 ELSE 0 END) AS BIGINT) AS total_tool_calls,
  count(*) FILTER (WHERE role <> 'system') AS n_sub_agents,
  CAST(sum(CASE WHEN role <> 'system' THEN length(text) ELSE 0 END) AS BIGINT) AS sub_agent_tokens
FROM conversations GROUP BY conv_id""", ))
def multi_agent_usage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13 (multi-agent): coordinator tool calls + sum over sub-agents."""
    conv = S.table(spark, sf, "conversations")
    sub = F.when(F.col("role") != "system", F.struct(
        F.concat(F.lit("agent_"), F.col("turn").cast("string")).alias("agent"),
        F.char_length("text").cast("long").alias("tokens"),
        (F.pmod("turn", F.lit(3)) + 1).cast("long").alias("tool_calls")))
    coord = F.when(F.col("role") == "system", F.struct(
        F.concat(F.lit("tool_name_"), F.col("turn").cast("string")).alias("k"), F.lit("delegate").alias("v")))
    g = conv.groupBy("conv_id").agg(F.collect_list(sub).alias("sub_agents"), F.collect_list(coord).alias("c"))
    g = g.withColumn("coordinator", F.map_from_entries(F.transform("c", lambda x: F.struct(x["k"], x["v"]))))
    return g.select(
        "conv_id",
        T.total_tool_calls(F.col("coordinator"), F.col("sub_agents")).alias("total_tool_calls"),
        F.size("sub_agents").cast("long").alias("n_sub_agents"),
        F.aggregate("sub_agents", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]).alias("sub_agent_tokens"),
    )
