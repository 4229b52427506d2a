"""Queries: streaming jobs (STR-1..3) run to completion with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logprobs as L
from ..functions import parsing as P
from ..session import scratch_path
from ..streaming import jobs as J
from . import q_cells as QC
from . import q_parsing as QP
from . import standins as S
from .registry import query

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's own files as a stream: no staging copy. A table may be a folder
    or one file; only a glob pattern takes either."""
    return J.stream_parquet(spark, f"{sf}/{name}.parque[t]", S.table(spark, sf, name).schema)


@query("stream_cells", S.with_ctes(f"""SELECT cell_id, CAST(rank AS INTEGER) AS rank, token, symbol, expr FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY expr DESC, token) AS rank FROM decoded)
WHERE rank <= {QC.CE.TOP_GENES}""", "decoded"))
def stream_cells(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: cells arrive as a file stream; each batch keeps the tokens of the
    vocabulary, names them and takes every cell's top 10."""
    out, ck = (scratch_path(spark, n) for n in ("cells-out", "cells-ck"))
    cells = QC.cells_of(_stream(spark, sf, "embeddings"))
    J.run_batches(cells, J.top_genes_of_batch(QC.vocab(spark, sf), out), ck)
    return spark.read.parquet(out).select("cell_id", "rank", "token", "symbol", "expr")


S.register("conv_parsed", None, f"""SELECT conv_id, turn, {P.sql_parse_label(P.sql_answer_source('text'))} AS parsed_label
FROM conversations""", [])


@query("ingest_responses", S.with_ctes(f"""SELECT conv_id, turn, parsed_label,
  {P.sql_label_to_pred('parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('parsed_label', 'down')} AS prediction_down FROM conv_parsed""", "conv_parsed"))
def ingest_responses(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: conversation turns that all arrive twice are parsed and stored
    once per (conv_id, turn)."""
    out, ck = (scratch_path(spark, n) for n in ("conv-out", "conv-ck"))
    twice = _stream(spark, sf, "conversations").unionByName(_stream(spark, sf, "conversations"))
    J.run_to_parquet(J.ingest_responses(twice), out, ck)
    return spark.read.parquet(out)


# ── STR-2 with bounded state: events that arrive in deliveries ───────────

N_DELIVERIES = 4
DELAY_HOURS = 24
_US = "epoch_us(ts)"
S.register("event_quarters", None, f"""SELECT event_id, ts, event_id % {len(S.CATALOGUE)} AS k,
  event_id % 10 = 3 AS held, ({_US} - min({_US}) OVER ()) * {N_DELIVERIES} // (max({_US}) OVER () - min({_US}) OVER () + 1) AS quarter FROM events""", [])
# held back to the next delivery; what is older than the watermark by then is dropped
S.register("event_marks", None, f"""SELECT quarter, max(max(ts) FILTER (WHERE NOT held)) OVER (ORDER BY quarter) AS seen
FROM event_quarters GROUP BY quarter""", ["event_quarters"])
S.register("events_in_time", None, f"""SELECT e.event_id, e.k FROM event_quarters e JOIN event_marks m USING (quarter)
WHERE NOT held OR e.ts > date_trunc('millisecond', m.seen) - INTERVAL {DELAY_HOURS} HOUR""", ["event_quarters", "event_marks"])


def event_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that arrive: every event has a text of the catalogue and its time of arrival;
    ``quarter`` is the delivery that it belongs to, ``held`` marks those that come one later."""
    ev = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    low, high = ev.agg(F.min(us), F.max(us)).first()
    quarter = F.expr(f"(unix_micros(ts) - {low}) * {N_DELIVERIES} div {high - low + 1}").cast("int")
    rows = ev.select("event_id", "ts", F.pmod("event_id", F.lit(len(S.CATALOGUE))).cast("int").alias("k"),
                     (F.pmod("event_id", F.lit(10)) == 3).alias("held"), quarter.alias("quarter"))
    return rows.join(F.broadcast(S.catalogue(spark)), "k").select("event_id", "ts", F.col("t").alias("text"), "quarter", "held")


def deliver(rows: DataFrame, k: int, path: str) -> None:
    """Delivery ``k``: its own rows twice, those held back from the one before, and that whole one again."""
    own = rows.where((F.col("quarter") == k) & ~F.col("held"))
    before = rows.where(F.col("quarter") == k - 1)
    own.unionByName(own).unionByName(before).select("event_id", "ts", "text").write.mode("append").parquet(path)


@query("ingest_events", S.with_ctes(f"""SELECT e.event_id, c.parsed_label,
  {P.sql_label_to_pred('c.parsed_label', 'up')} AS prediction_up,
  {P.sql_label_to_pred('c.parsed_label', 'down')} AS prediction_down
FROM events_in_time e JOIN parsed_catalogue c USING (k)""", "events_in_time", "parsed_catalogue"))
def ingest_events(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2 with bounded state: five deliveries with replays and rows that come late, each
    read by a run of its own from the last one's checkpoint. State keeps the keys of one day;
    replays are dropped, and late rows too if they are older than the watermark."""
    path, out, ck = (scratch_path(spark, n) for n in ("events-in", "events-out", "events-ck"))
    rows = event_responses(spark, sf)
    for k in range(N_DELIVERIES + 1):
        deliver(rows, k, path)
        stream = J.stream_parquet(spark, path, "event_id long, ts timestamp, text string")
        J.run_to_parquet(J.ingest_responses(stream, ["event_id"], event_time="ts", delay=f"{DELAY_HOURS} hours"), out, ck)
    return spark.read.parquet(out)


@query("stream_progress", S.with_ctes("""SELECT count(*) AS n_total, count(*) FILTER (WHERE ea IS NOT NULL OR text <> '') AS n_new,
  count(*) FILTER (WHERE ea IS NOT NULL) AS n_hit, count(*) FILTER (WHERE ea IS NULL) AS n_fallback FROM lp_pred""", "lp_pred"))
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: running counters of a log-prob run over the stream (complete mode,
    final state): rows, rows with a result, hits, text fall-backs."""
    out, ck = (scratch_path(spark, n) for n in ("prog-out", "prog-ck"))
    rows = L.logprob_predictions(QP.derive_logprob_rows(_stream(spark, sf, "lineitem")))
    hit = F.col("lp_up").isNotNull()
    J.run_to_parquet(J.progress_counts(rows, hit | (F.col("text") != ""), hit, ~hit), out, ck, mode="complete")
    return spark.read.parquet(out)
