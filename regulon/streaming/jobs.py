"""Structured Streaming jobs (STR-1..3).

Each job reads a directory of Parquet files as a stream, applies the same
native operators as the batch path, and writes through a checkpoint in the
shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parsing as P
from ..operators import cells as CE


BYTES_PER_TRIGGER = 64 << 30


def stream_parquet(spark: SparkSession, path: str, schema, max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """A file stream whose micro-batches are sized by bytes, not by files."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(path)


def top_genes_of_batch(vocab: DataFrame, out: str, k: int = CE.TOP_GENES):
    """STR-1: a ``foreachBatch`` function: known tokens of each arriving cell, named,
    top ``k`` per cell.

    A cell is one row and so lies whole in one batch; the batch operators do the
    rest. Each batch replaces its own folder, so a batch that runs twice after a
    failure is stored once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        decoded = CE.decode_tokens(CE.zip_sparse(batch, keep=["cell_id"]), vocab)
        CE.top_genes_per_cell(decoded, k=k).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run


def ingest_responses(stream: DataFrame, keys=("conv_id", "turn"), text: str = "text",
                     event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """STR-2: drop replays of a key, then parse what is new.

    Without ``event_time`` the dedup state holds every key seen (exact, grows
    with keys; keep it in RocksDB, see ``cluster_settings``). With an arrival-time
    column the state is bounded by the watermark
    (``dropDuplicatesWithinWatermark``): replays later than ``delay`` are no
    longer recognised.
    """
    if event_time is None:
        fresh = stream.dropDuplicates(list(keys))
    else:
        fresh = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    parsed = P.parse_answers(fresh.withColumn("source", P.answer_source(F.col(text))), "source")
    return parsed.select(*keys, "parsed_label", "prediction_up", "prediction_down")


def progress_counts(stream: DataFrame, total: Column, hit: Column, fallback: Column, by: list[str] | None = None) -> DataFrame:
    """STR-3: running counters (complete output mode): rows seen, new ones with a
    result, log-probability hits and text fall-backs."""
    return stream.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(total).alias("n_new"),
        F.count_if(hit).alias("n_hit"),
        F.count_if(fallback).alias("n_fallback"),
    )


def run_batches(df: DataFrame, each, checkpoint: str) -> None:
    """Run a stream over all available input through a batch function, then stop."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all available input, then stop (``availableNow``). Returns the ended
    query, for its progress (rows read, rows of state)."""
    if mode == "complete":
        def sink(batch: DataFrame, _id: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = df.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint)
    else:
        q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    done = q.trigger(availableNow=True).start()
    done.awaitTermination()
    return done
