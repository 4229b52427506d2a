"""Scoring: exact tie-aware AUROC, the DE/DIR metric, validation and limits.

AUROC design (a distributed ranking, no global sort on one task):
  1. ``groupBy(keys, score)`` -> positives ``p`` and negatives ``n`` per
     distinct score (map-side combine, ties collapse here).
  2. The distinct scores are sorted into range partitions of (keys, score), as
     many as the shuffle gives. Ties are one row by now, so they cannot be torn.
  3. Inside each partition a window gives every score the negatives below it
     there; one aggregate leaves a row per (keys, partition): its sums.
  4. A prefix sum over these rows, one a partition, adds the negatives of all
     partitions before.
  5. ``U2 = sum(p * (2 * neg_below + n))`` as an exact decimal;
     ``AUROC = U2 / (2 * P * N)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import range_parts

DEC = "decimal(38,0)"

# ── Fixed values: required columns and per-row limits ────────────────────
REQUIRED_MINIMAL = ["id", "prediction_up", "prediction_down"]
REQUIRED_TRACK_A = [
    "id", "prediction_up", "prediction_down",
    "prediction_up_seed42", "prediction_down_seed42",
    "prediction_up_seed43", "prediction_down_seed43",
    "prediction_up_seed44", "prediction_down_seed44",
    "reasoning_trace_seed42", "reasoning_trace_seed43", "reasoning_trace_seed44",
    "tokens_used", "prompt_tokens", "model_name",
]
REQUIRED_TRACK_B = [
    "reasoning_trace", "tokens_used", "num_tool_calls",
    "prompt_tokens", "num_distinct_tools", "model_name",
]
REQUIRED_TRACK_C = ["reasoning_trace", "tokens_used", "model_name"]
MAX_PROMPT_TOKENS_A = 4096
MAX_TOOL_CALLS_PER_ROW = 250
MAX_PROMPT_TOKENS_B = 16384
MAX_DISTINCT_TOOLS = 100
CAPS = {"a": {"prompt_tokens": MAX_PROMPT_TOKENS_A},
        "b": {"num_tool_calls": MAX_TOOL_CALLS_PER_ROW, "prompt_tokens": MAX_PROMPT_TOKENS_B, "num_distinct_tools": MAX_DISTINCT_TOOLS}}
# ──────────────────────────────────────────────────────────────────────────


class SubmissionError(ValueError):
    """A submission the metric rejects (message shown to participants)."""


def auroc(df: DataFrame, label_col: str, score_col: str, keys: list[str] | None = None) -> DataFrame:
    """Exact tie-aware ROC area per group of ``keys``.

    ``label_col`` is 1 for positives and 0 for negatives; a null score is below all
    others. Work is spread by (keys, score), so one key may hold nearly all rows and
    there may be many keys. Returns ``keys + [auroc, n_pos, n_neg]``.
    """
    keys = list(keys or [])
    y = F.col(label_col).cast("long")
    g = df.groupBy(*keys, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("p"), F.sum(F.lit(1) - y).alias("n")
    )
    below = Window.partitionBy(*keys, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = range_parts(g, [*keys, "score"]).withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    inside = F.col("p").cast(DEC) * (F.lit(2).cast(DEC) * F.col("below").cast(DEC) + F.col("n").cast(DEC))
    # the window has brought a partition's rows of a key together, so this needs no shuffle
    parts = ranked.groupBy(*keys, "part").agg(F.sum(inside).alias("inside"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    # one row a partition and key
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    u2 = F.col("inside") + F.lit(2).cast(DEC) * F.col("p").cast(DEC) * F.col("before").cast(DEC)
    agg = parts.groupBy(*keys).agg(F.sum(u2).alias("u2"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    denom = F.lit(2).cast(DEC) * F.col("n_pos").cast(DEC) * F.col("n_neg").cast(DEC)
    return agg.select(
        *keys,
        F.when(denom != 0, F.col("u2").cast("double") / denom.cast("double")).alias("auroc"),
        F.col("n_pos").cast("long").alias("n_pos"),
        F.col("n_neg").cast("long").alias("n_neg"),
    )


def sql_auroc(table: str, label: str, score: str, keys: list[str] | None = None) -> str:
    """DuckDB oracle: the same exact U statistic, computed with one window."""
    keys = list(keys or [])
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return f"""(SELECT {kc}CAST(sum(p * (2 * nb + n)) AS DOUBLE) / CAST(2 * sum(p) * sum(n) AS DOUBLE) AS auroc,
       CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg
FROM (SELECT {kc}p, n, coalesce(sum(n) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT {kc}{score} AS score, sum(CAST({label} AS BIGINT)) AS p, sum(1 - CAST({label} AS BIGINT)) AS n
            FROM {table} GROUP BY ALL))
{"GROUP BY " + k if keys else ""})"""


def not_none(label: Column) -> Column:
    """``label != 'none'`` with pandas semantics: null counts as DE-positive."""
    return ~label.eqNullSafe("none")


def score_components(merged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long (component, y, s) table for the DE and DIR AUROCs in one pass."""
    keys = list(keys or [])
    up, down, label = F.col("prediction_up"), F.col("prediction_down"), F.col("label")
    denom = up + down
    de = F.struct(
        F.lit("de").alias("component"),
        F.when(not_none(label), 1).otherwise(0).alias("y"),
        (up + down).alias("s"),
    )
    dr = F.struct(
        F.lit("dir").alias("component"),
        F.when(label.eqNullSafe("up"), 1).otherwise(0).alias("y"),
        (up / F.when(denom == 0, F.lit(1.0)).otherwise(denom)).alias("s"),
    )
    comps = F.when(not_none(label), F.array(de, dr)).otherwise(F.array(de))
    return merged.select(*keys, F.inline(comps))


def de_dir_score(merged: DataFrame, keys: list[str] | None = None, track: str = "generic") -> DataFrame:
    """AGG-4: DE and DIR AUROC and their mean, per group of ``keys``.

    ``merged`` holds ``label, prediction_up, prediction_down`` (after JOI-1).
    A group with one class only raises, as the metric does.
    """
    keys = list(keys or [])
    a = auroc(score_components(merged, keys), "y", "s", keys + ["component"])
    r = a.groupBy(*keys).agg(
        F.max(F.when(F.col("component") == "de", F.col("auroc"))).alias("de_auroc"),
        F.max(F.when(F.col("component") == "dir", F.col("auroc"))).alias("dir_auroc"),
        F.min(F.when(F.col("component") == "de", F.least("n_pos", "n_neg"))).alias("_de_min"),
        F.min(F.when(F.col("component") == "dir", F.least("n_pos", "n_neg"))).alias("_dir_min"),
    )
    de = F.when(F.coalesce(F.col("_de_min"), F.lit(0)) == 0,
                F.raise_error(F.lit(ONE_CLASS_DE["generic" if track == "generic" else "track"]))
                ).otherwise(F.col("de_auroc"))
    dr = F.when(F.coalesce(F.col("_dir_min"), F.lit(0)) == 0,
                F.raise_error(F.lit(ONE_CLASS_DIR["generic" if track == "generic" else "track"]))
                ).otherwise(F.col("dir_auroc"))
    return r.select(*keys, de.cast("double").alias("de_auroc"), dr.cast("double").alias("dir_auroc")).withColumn(
        "score", (F.col("de_auroc") + F.col("dir_auroc")) / F.lit(2.0)
    )


def score_join(solution: DataFrame, submission: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """JOI-1: solution LEFT JOIN submission (extra submission ids drop)."""
    return solution.join(submission, on, "left")


def eval_join(predictions: DataFrame, truth: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """JOI-2: predictions INNER JOIN truth."""
    return predictions.join(truth, on, "inner")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """SET-1: required minus present columns, in the required order."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def _count_aggs(cols: tuple[str, ...] | list[str]) -> list[Column]:
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"n_missing_{c}"),
            F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"n_inf_{c}"),
        ]
    return aggs


def validation_counts(merged: DataFrame, submission: DataFrame | None = None, on: str | list[str] = "id",
                      cols: tuple[str, ...] | list[str] = ("prediction_up", "prediction_down")) -> DataFrame:
    """AGG-10: one row of counts (one action) for the prediction checks.

    ``merged`` is the solution LEFT JOIN submission. NaN counts as missing, so
    only infinities are left for the second check. Duplicate submission ids
    (ours) are counted with a separate aggregate on ``submission``.
    """
    out = merged.agg(F.count(F.lit(1)).alias("n_rows"), *_count_aggs(cols))
    if submission is not None:
        dups = submission.groupBy(*([on] if isinstance(on, str) else on)).count().where(F.col("count") > 1).agg(F.count(F.lit(1)))
        out = out.withColumn("n_duplicate_ids", dups.scalar())
    return out


# Messages whose wording differs between the generic metric
# and the three track metrics.
NAN_MSG = {"generic": "Submission contains NaN or Inf in '{col}'.",
           "track": "Submission contains NaN or Inf in {col}."}
ONE_CLASS_DE = {"generic": "All rows have the same DE label. Cannot compute DE AUROC.",
                "track": "All rows have the same DE label."}
ONE_CLASS_DIR = {"generic": "All DE-positive rows have the same direction label. Cannot compute DIR AUROC.",
                 "track": "All DE-positive rows have the same direction."}
TRACK_REQUIRED = {"generic": [], "a": REQUIRED_TRACK_A, "b": REQUIRED_TRACK_B, "c": REQUIRED_TRACK_C}


def check_submission(
    solution: DataFrame,
    submission: DataFrame,
    on: str = "id",
    track: str = "generic",
    required: list[str] | None = None,
) -> DataFrame:
    """Run the metric's checks in the metric's order; return the merged table.

    generic: left join, then per prediction column: present, no nulls, no
    NaN/inf. Tracks a/b/c: required columns before the join, then the track's
    per-row caps (a: prompt tokens; b: tool calls, prompt tokens, distinct
    tools), then presence and nulls per column, then NaN/inf per column.
    The caps and the counts are one aggregate each over the join, which reads only the
    columns that a check asks for. A merged table that passed is stored when it is first read (reliable
    checkpoint); class checks happen lazily in :func:`de_dir_score`.
    """
    req = list(required) if required is not None else TRACK_REQUIRED[track]
    miss = missing_columns(submission, req)
    if miss:
        raise SubmissionError(
            f"Submission is missing required column(s): {', '.join(miss)}. "
            "See the sample submission file for the expected format."
        )
    merged = score_join(solution, submission, on)
    cols = ("prediction_up", "prediction_down")
    present = [c for c in cols if c in merged.columns]
    if caps := CAPS.get(track):
        most = merged.agg(*[F.max(numeric_or_zero(F.col(c))).alias(c) for c in caps]).first()
        if any((most[c] or 0) > cap for c, cap in caps.items()):
            raise SubmissionError(check_limits(merged, on=on, track=track).first()["error"])
    v = merged.agg(*_count_aggs(present)).first() if present else None
    style = "generic" if track == "generic" else "track"
    for c in cols:
        if c not in merged.columns:
            raise SubmissionError(f"Submission is missing required column '{c}'.")
        if v[f"n_missing_{c}"]:
            raise SubmissionError(f"Submission is missing {c} values for {v[f'n_missing_{c}']} rows.")
        if style == "generic" and v[f"n_inf_{c}"]:
            raise SubmissionError(NAN_MSG[style].format(col=c))
    for c in cols if style == "track" else ():
        if v[f"n_inf_{c}"]:
            raise SubmissionError(NAN_MSG[style].format(col=c))
    return merged.checkpoint(eager=False)


def numeric_or_zero(c: Column) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(0)``."""
    x = c.cast("string").try_cast("double")
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def check_limits(merged: DataFrame, on: str = "id", track: str = "b", first_n: int = 5) -> DataFrame:
    """AGG-11: per-row caps in one aggregate; the first offending ids are a bounded top-n.

    Returns one row: maxima, violation counts, ``first_ids`` (at most
    ``first_n`` smallest offending ids) and ``error`` (the first failing check's
    message, or null).
    """
    if track == "a":
        pt = numeric_or_zero(F.col("prompt_tokens"))
        base = merged.select(on, pt.alias("pt"))
        agg = base.agg(F.max("pt").alias("max_prompt_tokens"),
                       F.count_if(F.col("pt") > MAX_PROMPT_TOKENS_A).alias("n_prompt_violations"))
        err = F.when(F.col("max_prompt_tokens") > MAX_PROMPT_TOKENS_A, F.format_string(
            "Prompt-token limit exceeded: max %,d, but submission reports %,d. Shorten your prompt template.",
            F.lit(MAX_PROMPT_TOKENS_A), F.col("max_prompt_tokens").cast("long")))
        return agg.withColumn("error", err)
    tc = numeric_or_zero(F.col("num_tool_calls"))
    pt = numeric_or_zero(F.col("prompt_tokens"))
    dt = numeric_or_zero(F.col("num_distinct_tools"))
    base = merged.select(F.col(on).cast("string").alias("rid"), tc.alias("tc"), pt.alias("pt"), dt.alias("dt"))
    agg = base.agg(
        F.max("tc").alias("max_tool_calls"),
        F.max("pt").alias("max_prompt_tokens"),
        F.max("dt").alias("max_distinct_tools"),
        F.count_if(F.col("tc") > MAX_TOOL_CALLS_PER_ROW).alias("n_tool_call_violations"),
    )
    first_ids = (
        base.where(F.col("tc") > MAX_TOOL_CALLS_PER_ROW).select("rid").orderBy("rid").limit(first_n)
        .agg(F.nullif(F.array_join(F.array_sort(F.collect_list("rid")), ", "), F.lit("")))
    )
    agg = agg.withColumn("first_ids", first_ids.scalar())
    err = (
        F.when(F.col("max_tool_calls") > MAX_TOOL_CALLS_PER_ROW, F.format_string(
            "Tool-call limit exceeded: max %d per row, but found %d (rows: %s). "
            "Reduce the number of tool calls per question.",
            F.lit(MAX_TOOL_CALLS_PER_ROW), F.col("max_tool_calls").cast("long"), F.col("first_ids")))
        .when(F.col("max_prompt_tokens") > MAX_PROMPT_TOKENS_B, F.format_string(
            "Prompt-token limit exceeded: max %,d, but submission reports %,d. "
            "Shorten your system prompt or tool definitions.",
            F.lit(MAX_PROMPT_TOKENS_B), F.col("max_prompt_tokens").cast("long")))
        .when(F.col("max_distinct_tools") > MAX_DISTINCT_TOOLS, F.format_string(
            "Distinct-tools limit exceeded: max %d, but submission reports %d. "
            "Reduce the number of tool definitions.",
            F.lit(MAX_DISTINCT_TOOLS), F.col("max_distinct_tools").cast("long")))
    )
    return agg.withColumn("error", err)


def label_distribution(df: DataFrame, truth_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """AGG-5: counts per true and per predicted label, as (kind, label, n)."""
    both = df.select(F.inline(F.array(
        F.struct(F.lit("truth").alias("kind"), F.col(truth_col).alias("label")),
        F.struct(F.lit("pred").alias("kind"), F.col(pred_col).alias("label")),
    )))
    return both.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


def argmax_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG-6: share of rows whose argmax label equals the truth."""
    keys = list(keys or [])
    hit = F.when(F.col("pred") == F.col("label"), 1).otherwise(0)
    return df.groupBy(*keys).agg(
        (F.sum(hit).cast("double") / F.count(F.lit(1)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_rows"),
    )
