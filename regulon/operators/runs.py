"""Scoring runs: seeds, pending work, ensembles, submissions, batch scoring.

Responses are kept in a long table ``(id, seed, ...)``; the wide submission is
a pivot of it. All steps are joins and aggregates on the row key, so the
planner can reuse one hash partitioning across them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import DEFAULT_DOWN, DEFAULT_UP

# ── Fixed values ─────────────────────────────────────────────────────────
SEEDS = [42, 43, 44]
MISSING_TRACE = {"a": "none", "b": "", "c": "(no reasoning trace)"}
# ──────────────────────────────────────────────────────────────────────────


def expand_seeds(df: DataFrame, seeds: list[int] = SEEDS) -> DataFrame:
    """JOI-5: every row once per seed (a narrow ``explode``, no join)."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def pending_work(expected: DataFrame, stored: DataFrame, keys: list[str] = ["id", "seed"]) -> DataFrame:
    """JOI-4: expected work with no stored result (left anti join on the key)."""
    return expected.join(stored.select(*keys), keys, "left_anti")


def _pivot(long: DataFrame, keys: list[str], values: dict[str, str], seeds: list[int],
           extra_aggs: list | None = None) -> DataFrame:
    """One column per (value, seed) via conditional aggregation.

    ``max(when(seed = s, v))`` is ``pivot(seed, seeds)`` written out, so it needs
    no distinct-values pass and keeps a missing seed null. (key, seed) is unique
    in a response store read with ``latest_responses``; if it is not, ``max``
    still gives the same value in every run.
    """
    aggs = [
        F.max(F.when(F.col("seed") == s, F.col(src))).alias(f"{dst}_seed{s}")
        for dst, src in values.items()
        for s in seeds
    ]
    return long.groupBy(*keys).agg(*aggs, *(extra_aggs or []))


def seed_ensemble(
    parsed: DataFrame,
    keys: list[str] = ["id"],
    seeds: list[int] = SEEDS,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """AGG-1: per-seed predictions and their mean over ``seeds``.

    A missing seed counts as the default 0.333; the mean adds the seed columns
    left to right in seed order (exact float ties matter to AUROC). The values
    are numbers, so this is a hash aggregate; its output stays partitioned on
    exactly ``keys`` for a following join.
    """
    values = {"prediction_up": "prediction_up", "prediction_down": "prediction_down"}
    values.update(extra or {})
    wide = _pivot(parsed, keys, values, seeds)
    for side, default in (("up", DEFAULT_UP), ("down", DEFAULT_DOWN)):
        cols = [F.coalesce(F.col(f"prediction_{side}_seed{s}"), F.lit(default)) for s in seeds]
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        wide = wide.withColumn(f"prediction_{side}", total / F.lit(float(len(seeds))))
    return wide


def sql_seed_mean(side: str, seeds: list[int] = SEEDS) -> str:
    d = DEFAULT_UP if side == "up" else DEFAULT_DOWN
    terms = " + ".join(f"coalesce(prediction_{side}_seed{s}, CAST({d!r} AS DOUBLE))" for s in seeds)
    return f"(({terms}) / CAST({float(len(seeds))!r} AS DOUBLE))"


def row_tokens(long: DataFrame, keys: list[str] = ["id"], col: str = "total_tokens") -> DataFrame:
    """AGG-2: tokens summed over seeds, as a long (missing -> 0)."""
    return long.groupBy(*keys).agg(F.coalesce(F.sum(F.col(col).cast("long")), F.lit(0)).alias("tokens_used"))


def prompt_tokens_max(long: DataFrame, keys: list[str] = ["id"], col: str = "prompt_tokens") -> DataFrame:
    """AGG-16: largest prompt token count over seeds."""
    return long.groupBy(*keys).agg(F.max(col).alias("prompt_tokens"))


def trace_or_default(c: Column, track: str) -> Column:
    """Missing or empty trace -> the track's placeholder."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING_TRACE[track]))


def _spread(test: DataFrame, results: DataFrame, on: list[str], tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """Both tables in ``tasks`` parts of the key. Texts are pivoted by sorting, and a part is sorted
    once, for the pivot and the join; with more parts for more rows a task holds as much as before."""
    return (test.repartition(tasks, *on), results.repartition(tasks, *on)) if tasks else (test, results)


def assemble_track_a(test: DataFrame, results: DataFrame, model_name: str, seeds: list[int] = SEEDS,
                     on: list[str] = ["id"], tasks: int | None = None) -> DataFrame:
    """JOI-6 (A): every test row, per-seed columns with defaults, mean, usage.

    ``test`` holds ``on`` + ``prompt_tokens`` (+ any columns to keep, such as
    the row id); ``results`` is the long table ``on + [seed, prediction_up,
    prediction_down, text, total_tokens]``. The pivot and the join share one
    partitioning on the keys, of ``tasks`` parts if given.
    """
    test, results = _spread(test, results, on, tasks)
    tokens = F.coalesce(F.sum(F.col("total_tokens").cast("long")), F.lit(0)).alias("tokens_used")
    wide = _pivot(results, on, {"prediction_up": "prediction_up", "prediction_down": "prediction_down",
                                "reasoning_trace": "text"}, seeds, extra_aggs=[tokens])
    j = test.join(wide, on, "left")
    cols = [c for c in test.columns if c != "prompt_tokens"]
    for side, d in (("up", DEFAULT_UP), ("down", DEFAULT_DOWN)):
        for s in seeds:
            j = j.withColumn(f"prediction_{side}_seed{s}", F.coalesce(F.col(f"prediction_{side}_seed{s}"), F.lit(d)))
        total = F.col(f"prediction_{side}_seed{seeds[0]}")
        for s in seeds[1:]:
            total = total + F.col(f"prediction_{side}_seed{s}")
        j = j.withColumn(f"prediction_{side}", total / F.lit(float(len(seeds))))
    cols += ["prediction_up", "prediction_down"]
    cols += [f"prediction_{side}_seed{s}" for s in seeds for side in ("up", "down")]
    out = j.select(
        *cols,
        *[trace_or_default(F.col(f"reasoning_trace_seed{s}"), "a").alias(f"reasoning_trace_seed{s}") for s in seeds],
        F.coalesce(F.col("tokens_used"), F.lit(0)).cast("int").alias("tokens_used"),
        F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("int").alias("prompt_tokens"),
        F.lit(model_name).alias("model_name"),
    )
    return out


def assemble_track_b(test: DataFrame, results: DataFrame, model_name: str, prompt_tokens: int,
                     num_distinct_tools: int, on: list[str] = ["id"]) -> DataFrame:
    """JOI-6 (B): one agent result per row; run-level prompt and tool counts."""
    j = test.join(results, on, "left")
    return j.select(
        *on,
        F.coalesce("prediction_up", F.lit(DEFAULT_UP)).alias("prediction_up"),
        F.coalesce("prediction_down", F.lit(DEFAULT_DOWN)).alias("prediction_down"),
        F.coalesce(F.col("reasoning_trace"), F.lit(MISSING_TRACE["b"])).alias("reasoning_trace"),
        F.coalesce(F.col("tokens_used"), F.lit(0)).cast("int").alias("tokens_used"),
        F.coalesce(F.col("num_tool_calls"), F.lit(0)).cast("int").alias("num_tool_calls"),
        F.lit(prompt_tokens).cast("int").alias("prompt_tokens"),
        F.lit(num_distinct_tools).cast("int").alias("num_distinct_tools"),
        F.coalesce(F.col("model_name"), F.lit(model_name)).alias("model_name"),
    )


def assemble_track_c(test: DataFrame, results: DataFrame, model_name: str, on: list[str] = ["id"]) -> DataFrame:
    """JOI-6 (C): one completion per row; empty trace -> placeholder."""
    j = test.join(results, on, "left")
    return j.select(
        *on,
        F.coalesce("prediction_up", F.lit(DEFAULT_UP)).alias("prediction_up"),
        F.coalesce("prediction_down", F.lit(DEFAULT_DOWN)).alias("prediction_down"),
        trace_or_default(F.col("reasoning_trace"), "c").alias("reasoning_trace"),
        F.coalesce(F.col("tokens_used"), F.lit(0)).cast("int").alias("tokens_used"),
        F.coalesce(F.col("model_name"), F.lit(model_name)).alias("model_name"),
    )


def assemble_enum(test: DataFrame, results: DataFrame, model_name: str, seeds: list[int] = SEEDS,
                  on: list[str] = ["id"], tasks: int | None = None) -> DataFrame:
    """JOI-6 (enum): per-seed effect names; failed parses count as ``unknown``. ``tasks`` as for track A."""
    test, results = _spread(test, results, on, tasks)
    wide = _pivot(results, on, {"prediction_up": "prediction_up", "prediction_down": "prediction_down",
                                "effect": "effect"}, seeds)
    j = test.join(wide, on, "left")
    sel = list(test.columns)
    for side, d in (("up", DEFAULT_UP), ("down", DEFAULT_DOWN)):
        parts = [F.coalesce(F.col(f"prediction_{side}_seed{s}"), F.lit(d)) for s in seeds]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        sel.append((total / F.lit(float(len(seeds)))).alias(f"prediction_{side}"))
    for s in seeds:
        for side, d in (("up", DEFAULT_UP), ("down", DEFAULT_DOWN)):
            sel.append(F.coalesce(F.col(f"prediction_{side}_seed{s}"), F.lit(d)).alias(f"prediction_{side}_seed{s}"))
    for s in seeds:
        sel.append(F.coalesce(F.col(f"effect_seed{s}"), F.lit("unknown")).alias(f"effect_seed{s}"))
    sel.append(F.lit(model_name).alias("model_name"))
    return j.select(*sel)


# ── UDF-1: batch scoring through a user callable ─────────────────────────

CALL_ROWS = 256  # rows of one step: their calls are all back before the first of them leaves


class StopScoring(Exception):
    """Raised by a scorer when no call can succeed (the server is gone, the quota is spent).

    It is not retried and marks no row as failed: the task fails, and with it the
    job, once Spark has tried the task again as often as it may.
    """


def batch_complete(
    pending: DataFrame,
    scorer: Callable[[str, int], str],
    max_retries: int = 2,
    backoff: Callable[[int], float] = lambda attempt: 2.0 ** attempt,
    concurrency: int = 8,
    tasks: int | None = None,
) -> DataFrame:
    """UDF-1: call ``scorer(prompt, seed)`` for every pending row.

    Runs on executors through ``mapInPandas`` (Arrow batches). A task keeps at
    most ``concurrency`` calls in flight (a bounded thread pool: the calls wait
    for a server), and ``tasks`` spreads the rows over so many tasks, so
    ``tasks * concurrency`` calls run at once whatever partitions the rows came
    in. Each call is tried ``1 + max_retries`` times; only the call that failed
    waits. After the last failure the row is kept with empty text and
    ``status='failed'`` so a later run can retry it (the default prediction
    applies meanwhile); ``StopScoring`` ends the job instead. Rows leave a task
    ``CALL_ROWS`` at a time. Input: ``id, seed, prompt``; output adds ``text, status,
    attempts``. A job that stops loses what it has scored: ``streaming.scoring`` stores
    batch after batch.
    """
    schema = T.StructType([*pending.schema.fields, T.StructField("text", T.StringType()),
                           T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def call(prompt: str, seed: int) -> tuple[str, str, int]:
        for attempt in range(max_retries + 1):
            try:
                return scorer(prompt, seed), "ok", attempt + 1
            except StopScoring:
                raise
            except Exception:  # noqa: BLE001 - any scorer failure is retried
                if attempt < max_retries:
                    time.sleep(backoff(attempt))
        return "", "failed", max_retries + 1

    def run(batches: Iterator) -> Iterator:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in (batch.iloc[k : k + CALL_ROWS] for batch in batches for k in range(0, len(batch), CALL_ROWS)):
                out = list(pool.map(call, pdf["prompt"], map(int, pdf["seed"])))
                texts, status, attempts = zip(*out)
                yield pdf.assign(text=list(texts), status=list(status), attempts=list(attempts))

    spread = pending.repartition(tasks) if tasks else pending
    return spread.mapInPandas(run, schema)


def failing_scorer(prompt: str, seed: int) -> str:
    """A stand-in that fails for good on every fifth prompt length, and else answers."""
    if (len(prompt) + seed) % 5 == 0:
        raise RuntimeError("no answer")
    return stub_scorer(prompt, seed)


LATE = "\n\n(second delivery)"


def stopping_scorer(prompt: str, seed: int) -> str:
    """A stand-in whose server is gone when the second delivery comes."""
    if prompt.endswith(LATE):
        raise StopScoring("the server is gone")
    return stub_scorer(prompt, seed)


def stub_scorer(prompt: str, seed: int) -> str:
    """Deterministic stand-in for a model: a tagged letter from the prompt."""
    letter = "ABC"[(len(prompt) + seed) % 3]
    return f"<answer>{letter}</answer>"
