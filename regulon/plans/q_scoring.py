"""Queries: the flagship run score and the scoring operators (AGG-3..6, 10..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import runs as R
from ..operators import scoring as SC
from . import standins as S
from .registry import query

KEYS = ["pert_key", "gene_key"]


# ── shared plan pieces ───────────────────────────────────────────────────

def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with PRS-9 source and PRS-7 predictions (one row per id, seed)."""
    resp = S.responses(spark, sf)
    return P.parse_answers(resp.withColumn("source", P.answer_source(F.col("text"))), "source")


def run_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-1 over the stand-in run, keyed by the pair keys.

    The result stays hash-partitioned on the join keys, so the solution join
    reuses that partitioning: one shuffle of the partially aggregated responses,
    one of the solution, both sized at run time.
    """
    return R.seed_ensemble(parsed_responses(spark, sf), keys=KEYS)


def merged_run(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-1: solution LEFT JOIN the run's predictions."""
    sol = S.solution(spark, sf)
    return SC.score_join(sol, run_predictions(spark, sf), KEYS)


# DuckDB twins: the catalogue is parsed once and joined by key, which gives the
# same per-response values as parsing every response.
S.register("parsed_catalogue", None, f"""SELECT k, t,
  {P.sql_parse_label(P.sql_answer_source('t'))} AS parsed_label
FROM catalogue""", ["catalogue"])
S.register("parsed_responses", None, f"""SELECT r.pert_key, r.gene_key, r.id, r.seed, r.k, pc.parsed_label,
  {P.sql_label_to_pred('pc.parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('pc.parsed_label', 'down')} AS prediction_down
FROM responses_keys r JOIN parsed_catalogue pc USING (k)""", ["responses_keys", "parsed_catalogue"])
_PIVOT = ",\n  ".join(
    f"max(CASE WHEN seed = {s} THEN prediction_{side} END) AS prediction_{side}_seed{s}"
    for side in ("up", "down") for s in S.SEEDS
)
S.register("ens_wide", None, f"""SELECT pert_key, gene_key, id,
  {_PIVOT}
FROM parsed_responses GROUP BY pert_key, gene_key, id""", ["parsed_responses"])
S.register("ensemble", None, f"""SELECT *, {R.sql_seed_mean('up')} AS prediction_up,
  {R.sql_seed_mean('down')} AS prediction_down FROM ens_wide""", ["ens_wide"])
S.register("merged", None, """SELECT s.pert_key, s.gene_key, s.id, s.label, s.usage,
  e.prediction_up, e.prediction_down
FROM solution s LEFT JOIN ensemble e USING (pert_key, gene_key)""", ["solution", "ensemble"])


def _sql_components(src: str, keys: str = "") -> str:
    k = (keys + ", ") if keys else ""
    return f"""SELECT {k}'de' AS component, CASE WHEN label IS DISTINCT FROM 'none' THEN 1 ELSE 0 END AS y,
  prediction_up + prediction_down AS s FROM {src}
UNION ALL
SELECT {k}'dir' AS component, CASE WHEN label IS NOT DISTINCT FROM 'up' THEN 1 ELSE 0 END AS y,
  prediction_up / (CASE WHEN prediction_up + prediction_down = 0 THEN CAST(1.0 AS DOUBLE)
                   ELSE prediction_up + prediction_down END) AS s
FROM {src} WHERE label IS DISTINCT FROM 'none'"""


S.register("components", None, _sql_components("merged"), ["merged"])
S.register("components_usage", None, _sql_components("merged", "usage"), ["merged"])


def _sql_score(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return f"""SELECT {kc}max(CASE WHEN component = 'de' THEN auroc END) AS de_auroc,
  max(CASE WHEN component = 'dir' THEN auroc END) AS dir_auroc,
  (max(CASE WHEN component = 'de' THEN auroc END) + max(CASE WHEN component = 'dir' THEN auroc END)) / CAST(2.0 AS DOUBLE) AS score
FROM {SC.sql_auroc(src, 'y', 's', keys + ['component'])} AS a
{"GROUP BY " + k if keys else ""}"""


# ── flagship ─────────────────────────────────────────────────────────────

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What does this run score? pairs x seeds -> parse -> ensemble -> join -> AUROC."""
    return SC.de_dir_score(merged_run(spark, sf))


query("flagship_run_score", S.with_ctes(_sql_score("components", []), "components"))(flagship)


@query("score_by_usage", S.with_ctes(_sql_score("components_usage", ["usage"]), "components_usage"))
def score_by_usage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4 grouped by the solution's usage split (Public / Private)."""
    return SC.de_dir_score(merged_run(spark, sf), keys=["usage"])


# ── AGG-3: AUROC on documents x labels ───────────────────────────────────

S.register("scored_docs", None, """SELECT l.quality AS y, CAST(d.n_chars % 17 AS DOUBLE) / CAST(17.0 AS DOUBLE) AS s
FROM labels l JOIN documents d USING (doc_id)""", [])


@query("auroc_docs", S.with_ctes(f"SELECT auroc, n_pos, n_neg FROM {SC.sql_auroc('scored_docs', 'y', 's')} AS a", "scored_docs"))
def auroc_docs(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3: exact tie-aware AUROC of a score against a 0/1 label."""
    labels = S.table(spark, sf, "labels")
    docs = S.table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = labels.join(docs, "doc_id").select(
        F.col("quality").alias("y"), ((F.col("n_chars") % 17).cast("double") / F.lit(17.0)).alias("s")
    )
    return SC.auroc(scored, "y", "s")


@query("auroc_prices", f"SELECT auroc, n_pos, n_neg FROM "
       f"{SC.sql_auroc('lineitem', """(l_returnflag = 'R')""", 'l_extendedprice')} AS a")
def auroc_prices(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3 over many distinct scores: returned items ranked by price, all rows."""
    li = S.table(spark, sf, "lineitem")
    return SC.auroc(li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("s")), "y", "s")


@query("auroc_run_components", S.with_ctes(
    f"SELECT component, auroc, n_pos, n_neg FROM {SC.sql_auroc('components', 'y', 's', ['component'])} AS a", "components"))
def auroc_run_components(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3 on the run's long (component, y, s) table (many tied scores)."""
    return SC.auroc(SC.score_components(merged_run(spark, sf)), "y", "s", ["component"])


# ── AGG-5 / AGG-6 / PRS-15 ───────────────────────────────────────────────

S.register("argmax", None, f"""SELECT m.*, {P.sql_argmax_label('prediction_up', 'prediction_down')} AS pred
FROM merged m WHERE prediction_up IS NOT NULL""", ["merged"])


def argmax_table(spark: SparkSession, sf: str) -> DataFrame:
    sol = S.solution(spark, sf)
    j = SC.eval_join(run_predictions(spark, sf), sol, KEYS)
    return j.withColumn("pred", P.argmax_label(F.col("prediction_up"), F.col("prediction_down")))


@query("argmax_labels", S.with_ctes("SELECT id, pred FROM argmax", "argmax"))
def argmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    """PRS-15 + JOI-2: argmax label per evaluated row."""
    return argmax_table(spark, sf).select("id", "pred")


@query("label_distribution", S.with_ctes("""SELECT kind, label, count(*) AS n FROM (
  SELECT 'truth' AS kind, label FROM argmax UNION ALL SELECT 'pred' AS kind, pred AS label FROM argmax)
GROUP BY kind, label""", "argmax"))
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-5: counts per true and per predicted label."""
    return SC.label_distribution(argmax_table(spark, sf))


@query("argmax_accuracy", S.with_ctes("""SELECT CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS DOUBLE)
  / CAST(count(*) AS DOUBLE) AS accuracy, count(*) AS n_rows FROM argmax""", "argmax"))
def argmax_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-6: share of argmax predictions equal to the truth."""
    return SC.argmax_accuracy(argmax_table(spark, sf))


# ── AGG-10 / AGG-11 / AGG-12 ─────────────────────────────────────────────

@query("validate_submission", S.with_ctes("""SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE prediction_up IS NULL OR isnan(prediction_up)) AS n_missing_prediction_up,
  count(*) FILTER (WHERE isinf(prediction_up)) AS n_inf_prediction_up,
  count(*) FILTER (WHERE prediction_down IS NULL OR isnan(prediction_down)) AS n_missing_prediction_down,
  count(*) FILTER (WHERE isinf(prediction_down)) AS n_inf_prediction_down,
  (SELECT count(*) FROM (SELECT id FROM ensemble GROUP BY id HAVING count(*) > 1)) AS n_duplicate_ids
FROM merged""", "merged"))
def validate_submission(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10: missing (null or NaN) / infinite counts and duplicate ids.

    The ensemble is stored once: the merge and the duplicate check both read it.
    """
    sub = run_predictions(spark, sf).checkpoint(eager=True)
    merged = SC.score_join(S.solution(spark, sf), sub, KEYS)
    return SC.validation_counts(merged, submission=sub, on=KEYS)


S.register("track_b_rows", None, """SELECT s.id,
  CAST(length(s.id) * 30 AS VARCHAR) AS num_tool_calls,
  CASE WHEN s.gene_key % 7 = 0 THEN 'n/a' ELSE CAST(s.pert_key * 50 AS VARCHAR) END AS prompt_tokens,
  CAST(s.pert_key % 120 AS VARCHAR) AS num_distinct_tools
FROM solution s""", ["solution"])


def track_b_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row usage columns as text (so non-numeric values occur)."""
    sol = S.solution(spark, sf)
    return sol.select(
        "id",
        (F.char_length("id") * 30).cast("string").alias("num_tool_calls"),
        F.when(F.pmod("gene_key", F.lit(7)) == 0, F.lit("n/a"))
        .otherwise((F.col("pert_key") * 50).cast("string")).alias("prompt_tokens"),
        F.pmod("pert_key", F.lit(120)).cast("string").alias("num_distinct_tools"),
    )


S.register("limit_values", None, """SELECT id,
  coalesce(TRY_CAST(num_tool_calls AS DOUBLE), 0) AS tc,
  coalesce(TRY_CAST(prompt_tokens AS DOUBLE), 0) AS pt,
  coalesce(TRY_CAST(num_distinct_tools AS DOUBLE), 0) AS dt FROM track_b_rows""", ["track_b_rows"])


@query("check_limits", S.with_ctes("""SELECT *, CASE
  WHEN max_tool_calls > 250 THEN 'Tool-call limit exceeded: max 250 per row, but found ' || CAST(CAST(max_tool_calls AS BIGINT) AS VARCHAR)
    || ' (rows: ' || first_ids || '). Reduce the number of tool calls per question.'
  WHEN max_prompt_tokens > 16384 THEN 'Prompt-token limit exceeded: max 16,384, but submission reports ' || format('{:,}', CAST(max_prompt_tokens AS BIGINT))
    || '. Shorten your system prompt or tool definitions.'
  WHEN max_distinct_tools > 100 THEN 'Distinct-tools limit exceeded: max 100, but submission reports ' || CAST(CAST(max_distinct_tools AS BIGINT) AS VARCHAR)
    || '. Reduce the number of tool definitions.' END AS error
FROM (SELECT max(tc) AS max_tool_calls, max(pt) AS max_prompt_tokens,
  max(dt) AS max_distinct_tools, count(*) FILTER (WHERE tc > 250) AS n_tool_call_violations,
  (SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM limit_values WHERE tc > 250 ORDER BY id LIMIT 5)) AS first_ids
FROM limit_values)""", "limit_values"))
def check_limits(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 (track B): per-row caps (tool calls, prompt tokens, distinct tools) and the message."""
    return SC.check_limits(track_b_rows(spark, sf), on="id", track="b")


@query("check_limits_a", S.with_ctes("""SELECT max(pt) AS max_prompt_tokens, count(*) FILTER (WHERE pt > 4096) AS n_prompt_violations,
  CASE WHEN max(pt) > 4096 THEN 'Prompt-token limit exceeded: max 4,096, but submission reports ' || format('{:,}', CAST(max(pt) AS BIGINT))
    || '. Shorten your prompt template.' END AS error FROM limit_values""", "limit_values"))
def check_limits_a(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 (track A): the prompt-token cap and its message."""
    return SC.check_limits(track_b_rows(spark, sf), on="id", track="a")


ODD_GENE = 97  # rows of every so many genes are spoilt
ROWS_PER_TASK = 500_000  # of a stored submission


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """The run's predictions by id."""
    return run_predictions(spark, sf).join(S.pairs(spark, sf).select(*KEYS, "id"), KEYS)


def _spoilt(whole: DataFrame, value: float | None) -> DataFrame:
    """``whole`` with some ``prediction_up`` replaced, and all tracks' other columns."""
    up = F.when(F.pmod("gene_key", F.lit(ODD_GENE)) == 0, F.lit(value).cast("double")).otherwise(F.col("prediction_up"))
    sub = whole.withColumn("prediction_up", up)
    for c in dict.fromkeys([*SC.REQUIRED_TRACK_A, *SC.REQUIRED_TRACK_B, *SC.REQUIRED_TRACK_C]):
        if c not in sub.columns and c != "id":
            sub = sub.withColumn(c, F.lit("1"))
    return sub.drop(*KEYS)


def _stored_by_id(df: DataFrame, tasks: int) -> DataFrame:
    """A checkpoint of ``df``, dealt out over ``tasks`` parts by id and sorted, which joins on the id make use of.

    A plan made with adaptive execution doesn't tell how its result is partitioned, so it is off meanwhile.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    old = conf.get(key)
    conf.set(key, "false")
    try:
        return df.repartition(tasks, "id").sortWithinPartitions("id").checkpoint(eager=True)
    finally:
        conf.set(key, old)


_MISSING = f"(SELECT 'Submission is missing prediction_up values for ' || CAST(count(*) AS VARCHAR) || ' rows.' FROM pairs WHERE gene_key % {ODD_GENE} = 0)"


_INF = {q: f"(SELECT CASE WHEN count(*) > 0 THEN 'Submission contains NaN or Inf in {q}.' END FROM pairs WHERE gene_key % {ODD_GENE} = 0)"
        for q in ("prediction_up", "''prediction_up''")}


@query("submission_errors", S.with_ctes(f"""SELECT * FROM (VALUES
  ('a', 'nan', {_MISSING}), ('b', 'nan', {_MISSING}), ('c', 'nan', {_MISSING}), ('a', 'null', {_MISSING}), ('generic', 'nan', {_MISSING}),
  ('a', 'inf', {_INF["prediction_up"]}), ('b', 'inf', {_INF["prediction_up"]}), ('c', 'inf', {_INF["prediction_up"]}),
  ('generic', 'inf', {_INF["''prediction_up''"]}),
  ('a', 'column', 'Submission is missing required column(s): model_name. See the sample submission file for the expected format.'),
  ('b', 'column', 'Submission is missing required column(s): model_name. See the sample submission file for the expected format.'),
  ('c', 'column', 'Submission is missing required column(s): model_name. See the sample submission file for the expected format.')
) AS t(track, spoilt, error)""", "pairs"))
def submission_errors(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10 / AGG-11 / SET-1: what each track's check says of whole spoilt submissions.

    The run's submission is stored once and spoilt as it is read; a check is an
    aggregate or two over the merged table, and its message is one row here. Submission
    and solution are stored by id, so no check shuffles or sorts them again.
    """
    out = []
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-S.pairs(spark, sf).count() // ROWS_PER_TASK))
    whole, sol = (_stored_by_id(df, tasks) for df in (_whole(spark, sf), S.solution(spark, sf).select("id", "label")))
    for spoilt, value, tracks in (("nan", float("nan"), ("generic", "a", "b", "c")), ("inf", float("inf"), ("generic", "a", "b", "c")),
                                  ("null", None, ("a",)), ("column", 0.5, ("a", "b", "c"))):
        sub = _spoilt(whole, value)
        if spoilt == "column":
            sub = sub.drop("model_name")
        for track in tracks:
            try:
                SC.check_submission(sol, sub, track=track)
                out.append((track, spoilt, None))
            except SC.SubmissionError as e:
                out.append((track, spoilt, str(e)))
    return spark.createDataFrame(out, "track string, spoilt string, error string")


S.register("usage_events", None, """SELECT event_id, user_id, event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events""", [])


@query("usage_totals", S.with_ctes("""SELECT event_type, CAST(sum(tokens) AS BIGINT) AS tokens_used,
  count(*) AS n_calls FROM usage_events GROUP BY event_type""", "usage_events"))
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12: leaderboard totals (tokens and calls) per event type."""
    ev = S.table(spark, sf, "events")
    tok = F.get_json_object("props", "$.k").cast("long")
    return ev.groupBy("event_type").agg(F.sum(tok).cast("long").alias("tokens_used"),
                                        F.count(F.lit(1)).alias("n_calls"))
