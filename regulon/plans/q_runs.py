"""Queries: scoring runs (JOI-4..6, AGG-1/2/16, UDF-1)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import completions as C
from ..functions import parsing as P
from ..functions import prompts as PR
from ..functions.text import is_blank, sql_strip
from ..operators import runs as R
from ..session import scratch_path
from ..streaming import scoring as SCO
from . import q_parsing as QP
from . import standins as S
from .registry import query

MODEL = "stub-model"
RUN_PROMPT_TOKENS = 900
RUN_DISTINCT_TOOLS = 3
MIN_TOOL_CALLS_WITH_RESULT = 4


# ── stored results: responses with a non-blank text ──────────────────────

def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The run's cache: one row per (id, seed) that produced a text."""
    r = S.responses(spark, sf).where(~is_blank(F.col("text")))
    return P.parse_answers(r.withColumn("source", P.answer_source(F.col("text"))), "source")


S.register("stored", None, f"""SELECT r.*, pc.parsed_label,
  {P.sql_label_to_pred('pc.parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('pc.parsed_label', 'down')} AS prediction_down
FROM responses r JOIN parsed_catalogue pc USING (k) WHERE {sql_strip('r.text')} <> ''""",
           ["responses", "parsed_catalogue"])


def expected(spark: SparkSession, sf: str) -> DataFrame:
    return R.expand_seeds(S.pairs(spark, sf).select(*S.PAIR_KEYS, "id", "pert", "gene"))


@query("expand_seeds", S.with_ctes(
    "SELECT id, seed FROM pairs, (VALUES (42), (43), (44)) AS s(seed)", "pairs"))
def expand_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-5: every pair once per seed (narrow explode, no join)."""
    return expected(spark, sf).select("id", "seed")


S.register("pending", None, """SELECT p.id, p.pert, p.gene, s.seed FROM pairs p, (VALUES (42), (43), (44)) AS s(seed)
WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.id = p.id AND t.seed = s.seed)""", ["pairs", "stored"])


@query("pending_work", S.with_ctes("SELECT id, seed FROM pending", "pending"))
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-4: (id, seed) with no stored result (left anti join)."""
    return R.pending_work(expected(spark, sf), stored(spark, sf), keys=S.PAIR_KEYS + ["seed"]).select("id", "seed")


_WIDE = ",\n  ".join(f"max(CASE WHEN seed = {s} THEN prediction_{side} END) AS prediction_{side}_seed{s}"
                     for side in ("up", "down") for s in S.SEEDS)
S.register("stored_wide", None, f"SELECT id, {_WIDE} FROM stored GROUP BY id", ["stored"])


@query("seed_ensemble", S.with_ctes(f"""SELECT id, {R.sql_seed_mean('up')} AS prediction_up,
  {R.sql_seed_mean('down')} AS prediction_down, {", ".join(f"prediction_{side}_seed{s}" for side in ("up", "down") for s in S.SEEDS)}
FROM stored_wide""", "stored_wide"))
def seed_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-1: per-seed predictions and their mean (missing seed = 0.333)."""
    out = R.seed_ensemble(stored(spark, sf), keys=S.PAIR_KEYS)
    ids = S.pairs(spark, sf).select(*S.PAIR_KEYS, "id")
    return out.join(ids, S.PAIR_KEYS).drop(*S.PAIR_KEYS)


@query("row_tokens", S.with_ctes("SELECT id, CAST(sum(total_tokens) AS BIGINT) AS tokens_used FROM stored GROUP BY id", "stored"))
def row_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-2: tokens summed over a row's seeds."""
    t = R.row_tokens(stored(spark, sf), S.PAIR_KEYS + ["id"])
    return t.drop(*S.PAIR_KEYS)


def _tagged_tokens_col():
    return PR.prompt_tokens(PR.append_answer_tag(PR.zero_shot_prompt(F.col("pert"), F.col("gene"))))


_TAGGED_TOK = f"CAST(floor(length({PR.sql_append_answer_tag(PR.sql_zero_shot_prompt('pert', 'gene'))}) / 4) AS INTEGER)"


@query("prompt_tokens_max", S.with_ctes(
    f"SELECT id, max({_TAGGED_TOK} + seed - 42) AS prompt_tokens FROM pairs, (VALUES (42), (43), (44)) AS s(seed) GROUP BY id",
    "pairs"))
def prompt_tokens_max(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: the largest per-seed prompt token count (server counts differ by seed)."""
    e = expected(spark, sf).withColumn("prompt_tokens", _tagged_tokens_col() + F.col("seed") - 42)
    return R.prompt_tokens_max(e, ["id"])


# ── JOI-6: submissions ───────────────────────────────────────────────────

S.register("stored_wide_a", None, f"""SELECT id, {_WIDE},
  {", ".join(f"max(CASE WHEN seed = {s} THEN text END) AS reasoning_trace_seed{s}" for s in S.SEEDS)},
  CAST(sum(total_tokens) AS BIGINT) AS tokens_used
FROM stored GROUP BY id""", ["stored"])

_SEEDCOLS = []
for _s in S.SEEDS:
    for _side, _d in (("up", 0.333), ("down", 0.333)):
        _SEEDCOLS.append(f"coalesce(w.prediction_{_side}_seed{_s}, CAST({_d!r} AS DOUBLE)) AS prediction_{_side}_seed{_s}")


def _sql_mean(side: str) -> str:
    terms = " + ".join(f"coalesce(w.prediction_{side}_seed{s}, CAST(0.333 AS DOUBLE))" for s in S.SEEDS)
    return f"(({terms}) / CAST(3.0 AS DOUBLE))"


PAIRS_PER_TASK = 500_000  # of a submission


def _pair_tasks(spark: SparkSession, sf: str) -> int | None:
    """Parts of a submission, where the session's shuffle partitions would hold more pairs than
    that each (the stored pair table's row count is in its files' footers); else None."""
    tasks = -(-S.pairs(spark, sf).count() // PAIRS_PER_TASK)
    return tasks if tasks > _tasks(spark) else None


@query("submission_track_a", S.with_ctes(f"""SELECT p.id, {_sql_mean('up')} AS prediction_up, {_sql_mean('down')} AS prediction_down,
  {", ".join(_SEEDCOLS)},
  {", ".join(f"coalesce(nullif(w.reasoning_trace_seed{s}, ''), 'none') AS reasoning_trace_seed{s}" for s in S.SEEDS)},
  CAST(coalesce(w.tokens_used, 0) AS INTEGER) AS tokens_used,
  {_TAGGED_TOK} AS prompt_tokens, '{MODEL}' AS model_name
FROM pairs p LEFT JOIN stored_wide_a w USING (id)""", "pairs", "stored_wide_a"))
def submission_track_a(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-6 (A): every test row, per-seed columns with defaults, traces, usage."""
    keys = S.PAIR_KEYS
    test = S.pairs(spark, sf).select(*keys, "id", _tagged_tokens_col().alias("prompt_tokens"))
    out = R.assemble_track_a(test, stored(spark, sf).drop("id"), MODEL, on=keys, tasks=_pair_tasks(spark, sf))
    return out.drop(*keys)


S.register("stored_enum", None, f"""SELECT id, seed, effect,
  {P.sql_label_to_pred("CASE effect WHEN 'Up' THEN 'up' WHEN 'Down' THEN 'down' WHEN 'NoEffect' THEN 'none' END", 'up')} AS prediction_up,
  {P.sql_label_to_pred("CASE effect WHEN 'Up' THEN 'up' WHEN 'Down' THEN 'down' WHEN 'NoEffect' THEN 'none' END", 'down')} AS prediction_down
FROM stored""", ["stored"])
S.register("stored_enum_wide", None, f"""SELECT id, {_WIDE},
  {", ".join(f"max(CASE WHEN seed = {s} THEN effect END) AS effect_seed{s}" for s in S.SEEDS)}
FROM stored_enum GROUP BY id""", ["stored_enum"])


@query("submission_enum", S.with_ctes(f"""SELECT p.id, {_sql_mean('up')} AS prediction_up, {_sql_mean('down')} AS prediction_down,
  {", ".join(_SEEDCOLS)},
  {", ".join(f"coalesce(w.effect_seed{s}, 'unknown') AS effect_seed{s}" for s in S.SEEDS)}, '{MODEL}' AS model_name
FROM pairs p LEFT JOIN stored_enum_wide w USING (id)""", "pairs", "stored_enum_wide"))
def submission_enum(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-6 (enum): typed effects per seed; missing -> default and 'unknown'."""
    r = S.responses(spark, sf).where(~is_blank(F.col("text")))
    pred = P.label_to_pred(P.enum_label(F.col("effect")))
    keys = S.PAIR_KEYS
    r = r.select(*keys, "seed", "effect", pred["prediction_up"].alias("prediction_up"),
                 pred["prediction_down"].alias("prediction_down"))
    return R.assemble_enum(S.pairs(spark, sf).select(*keys, "id"), r, MODEL, on=keys, tasks=_pair_tasks(spark, sf)).drop(*keys)


S.register("agent_rows", None, f"""SELECT 'conv' || CAST(t.conv_id AS VARCHAR) AS id,
  {P.sql_label_to_pred(P.sql_parse_label(QP._SRC), 'up')} AS prediction_up,
  {P.sql_label_to_pred(P.sql_parse_label(QP._SRC), 'down')} AS prediction_down,
  t.tokens_used, t.num_tool_calls
FROM traj_submit t WHERE t.num_tool_calls >= {MIN_TOOL_CALLS_WITH_RESULT}""", ["traj_submit"])


@query("submission_track_b", S.with_ctes(f"""SELECT 'conv' || CAST(c.conv_id AS VARCHAR) AS id,
  coalesce(a.prediction_up, CAST(0.333 AS DOUBLE)) AS prediction_up,
  coalesce(a.prediction_down, CAST(0.333 AS DOUBLE)) AS prediction_down,
  CASE WHEN a.id IS NULL THEN '' ELSE 'trajectory of ' || a.id END AS reasoning_trace,
  CAST(coalesce(a.tokens_used, 0) AS INTEGER) AS tokens_used, CAST(coalesce(a.num_tool_calls, 0) AS INTEGER) AS num_tool_calls,
  {RUN_PROMPT_TOKENS} AS prompt_tokens, {RUN_DISTINCT_TOOLS} AS num_distinct_tools, '{MODEL}' AS model_name
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN agent_rows a
  ON a.id = 'conv' || CAST(c.conv_id AS VARCHAR)""", "agent_rows"))
def submission_track_b(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-6 (B): one agent result per row (trajectories with enough tool
    calls have one); run-level prompt and tool counts."""
    from ..functions import traces as T

    t = QP.trajectories(spark, sf)
    t = t.withColumn("submitted", T.submitted_answer(F.col("trajectory"))).withColumn(
        "num_tool_calls", T.tool_calls(F.col("trajectory")))
    t = t.where(F.col("num_tool_calls") >= MIN_TOOL_CALLS_WITH_RESULT)
    src = t.withColumn("source", P.answer_source(F.col("final_text"), F.col("submitted")))
    res = P.parse_answers(src, "source").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("id"),
        "prediction_up", "prediction_down", "tokens_used", "num_tool_calls",
        F.concat(F.lit("trajectory of conv"), F.col("conv_id").cast("string")).alias("reasoning_trace"))
    test = S.table(spark, sf, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("id")).distinct()
    return R.assemble_track_b(test, res.withColumn("model_name", F.lit(None).cast("string")), MODEL,
                              RUN_PROMPT_TOKENS, RUN_DISTINCT_TOOLS)


_RT, _RESP = C.sql_split_think("content", "reasoning")
_R2, _C2 = sql_strip("coalesce(reasoning, '')"), sql_strip("content")
_TEXT = f"(CASE WHEN {_R2} <> '' AND {_C2} <> '' THEN {_R2} || chr(10) || chr(10) || {_C2} WHEN {_R2} <> '' THEN {_R2} ELSE {_C2} END)"
S.register("c_rows", None, f"""SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, conv_id,
  {_TEXT} AS text, {_RT} AS reasoning_trace, {_RESP} AS response_trace, CAST(total_tokens AS BIGINT) AS tokens_used
FROM completion_parts""", ["completion_parts"])
_C_SRC = f"coalesce({P.sql_answer_tag('text')}, response_trace)"


@query("submission_track_c", S.with_ctes(f"""SELECT c.id,
  CASE WHEN c.tokens_used > 0 THEN {P.sql_label_to_pred(P.sql_parse_label(_C_SRC), 'up')} ELSE CAST(0.333 AS DOUBLE) END AS prediction_up,
  CASE WHEN c.tokens_used > 0 THEN {P.sql_label_to_pred(P.sql_parse_label(_C_SRC), 'down')} ELSE CAST(0.333 AS DOUBLE) END AS prediction_down,
  CASE WHEN c.tokens_used > 0 THEN coalesce(nullif(CASE WHEN reasoning_trace <> '' THEN '<think>' || chr(10) || reasoning_trace
       || chr(10) || '</think>' || chr(10) || response_trace ELSE response_trace END, ''), '{C.MISSING_TRACE_C}')
       ELSE '{C.MISSING_TRACE_C}' END AS reasoning_trace,
  CASE WHEN c.tokens_used > 0 THEN CAST(tokens_used AS INTEGER) ELSE 0 END AS tokens_used, '{MODEL}' AS model_name
FROM c_rows c""", "c_rows"))
def submission_track_c(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-6 (C): one completion per row; a completion that reported no token
    usage counts as a failed call, so its row gets the defaults."""
    comp = QP.completions(spark, sf)
    f = C.completion_fields(F.col("json"), reasoning_content=True)
    rows = comp.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                       "conv_id", f.alias("f"))
    sp = C.split_think(F.col("f.content"), F.col("f.reasoning"))
    rows = rows.select("id", "conv_id", F.col("f.text").alias("text"), sp.alias("s"),
                       F.col("f.total_tokens").alias("tokens_used"))
    rows = rows.withColumn("source", F.coalesce(P.answer_tag(F.col("text")), F.col("s.response_trace")))
    res = P.parse_answers(rows, "source").where(F.col("tokens_used") > 0).select(
        "id", "prediction_up", "prediction_down",
        C.assemble_trace(F.col("s.reasoning_trace"), F.col("s.response_trace")).alias("reasoning_trace"),
        "tokens_used", F.lit(None).cast("string").alias("model_name"))
    return R.assemble_track_c(rows.select("id"), res, MODEL)


# ── UDF-1: batch scoring of pending work through a callable ──────────────

@query("batch_complete", S.with_ctes(f"""SELECT id, seed,
  '<answer>' || substr('ABC', CAST((length(prompt) + seed) % 3 AS INTEGER) + 1, 1) || '</answer>' AS text,
  'ok' AS status, 1 AS attempts
FROM (SELECT id, seed, {PR.sql_append_answer_tag(PR.sql_zero_shot_prompt('pert', 'gene'))} AS prompt FROM pending)""",
    "pending"))
def batch_complete(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1: pending (id, seed) rows scored on executors through ``mapInPandas``
    with a deterministic stub scorer, retries and a status column."""
    pend = R.pending_work(expected(spark, sf), stored(spark, sf), keys=S.PAIR_KEYS + ["seed"])
    pend = pend.select("id", "seed", PR.append_answer_tag(PR.zero_shot_prompt(F.col("pert"), F.col("gene"))).alias("prompt"))
    out = R.batch_complete(pend, R.stub_scorer, max_retries=1, backoff=lambda a: 0.0, tasks=_tasks(spark))
    return out.select("id", "seed", "text", "status", "attempts")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("batch_complete_failures", S.with_ctes(f"""SELECT id, seed,
  CASE WHEN (length(prompt) + seed) % 5 = 0 THEN '' ELSE '<answer>' || substr('ABC', CAST((length(prompt) + seed) % 3 AS INTEGER) + 1, 1) || '</answer>' END AS text,
  CASE WHEN (length(prompt) + seed) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN (length(prompt) + seed) % 5 = 0 THEN 3 ELSE 1 END AS attempts
FROM (SELECT id, seed, {PR.sql_append_answer_tag(PR.sql_zero_shot_prompt('pert', 'gene'))} AS prompt FROM pending)""",
    "pending"))
def batch_complete_failures(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1: a scorer that fails for good on some prompts: retries, then ``failed``."""
    pend = R.pending_work(expected(spark, sf), stored(spark, sf), keys=S.PAIR_KEYS + ["seed"])
    pend = pend.select("id", "seed", PR.append_answer_tag(PR.zero_shot_prompt(F.col("pert"), F.col("gene"))).alias("prompt"))
    out = R.batch_complete(pend, R.failing_scorer, max_retries=2, backoff=lambda a: 0.0, tasks=_tasks(spark))
    return out.select("id", "seed", "text", "status", "attempts")


# ── UDF-1 that survives a stop ───────────────────────────────────────────

LATE = R.LATE


@query("resumable_scoring", S.with_ctes(f"""SELECT id, seed,
  '<answer>' || substr('ABC', CAST((length(prompt) + seed) % 3 AS INTEGER) + 1, 1) || '</answer>' AS text, 'ok' AS status,
  CAST(1 AS BIGINT) AS n_stored, false AS scored_again
FROM (SELECT id, seed, {PR.sql_append_answer_tag(PR.sql_zero_shot_prompt('pert', 'gene'))}
        || CASE WHEN seed % 2 = 1 THEN '{LATE}' ELSE '' END AS prompt FROM pending)""", "pending"))
def resumable_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1: pending work comes in two deliveries and is scored batch by batch. The second
    run stops in the second delivery and a third goes on from its checkpoint: every (id,
    seed) is stored once, and rows stored before the stop still lie in the files they were
    written to then (``scored_again`` is false)."""
    run = SCO.ScoringRun(spark, scratch_path(spark, "scoring"))
    pend = R.pending_work(expected(spark, sf), stored(spark, sf), keys=S.PAIR_KEYS + ["seed"])
    late = F.col("seed") % 2 == 1
    prompt = PR.append_answer_tag(PR.zero_shot_prompt(F.col("pert"), F.col("gene")))
    pend = pend.select("id", "seed", F.concat(prompt, F.when(late, LATE).otherwise("")).alias("prompt"))
    options = {"max_retries": 1, "backoff": lambda a: 0.0, "tasks": _tasks(spark)}
    run.deliver(pend.where(~late))
    run.score(R.stopping_scorer, **options)
    run.deliver(pend.where(late))
    try:
        run.score(R.stopping_scorer, **options)
    except StreamingQueryException as e:
        if "StopScoring" not in str(e):
            raise
    before = run.stored().select("batch", "file").distinct().checkpoint()
    run.score(R.stub_scorer, **options)
    rows = run.stored().join(before.withColumn("kept", F.lit(True)), ["batch", "file"], "left").join(
        before.select("batch", F.lit(True).alias("early")).distinct(), "batch", "left")
    again = F.coalesce(F.col("early") & F.col("kept").isNull(), F.lit(False))
    return rows.groupBy("id", "seed").agg(
        F.max("text").alias("text"), F.max("status").alias("status"), F.count("*").alias("n_stored"), F.max(again).alias("scored_again"))
