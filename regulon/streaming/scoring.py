"""UDF-1 that survives a stop: pending work scored batch by batch, each stored once.

Work is delivered as Parquet files of a bounded number of rows. A stream reads a
few files a micro-batch, scores them on the executors and writes them to a folder
of their own; then a one-row mark says that the batch is whole. The checkpoint
remembers which files belong to which batch, so

* a stopped run goes on with the batch that was running, and with the same files;
* a batch that runs twice replaces its own folder, so nothing is stored twice;
* calls of marked batches are never repeated: a stop costs at most one batch.

A batch has a cost of its own (a job, two writes, the log), so its files grow with what is
delivered: ``FILES_PER_BATCH``, or a ``MAX_BATCHES``-th of all files if that is more.

All folders lie in the shared folder (or any store that Spark reaches). Work that
arrives later is simply delivered to the same folder and scored by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from .jobs import run_batches

ROWS_PER_FILE = 20_000
FILES_PER_BATCH = 8
MAX_BATCHES = 32


class ScoringRun:
    """The folders of one scoring run under ``root``: ``work``, ``rows``, ``done`` and ``checkpoint``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.work, self.rows, self.done, self.checkpoint = (f"{root.rstrip('/')}/{n}" for n in ("work", "rows", "done", "checkpoint"))

    def deliver(self, pending: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Add pending work ``(id, seed, prompt, ...)``; a file holds at most ``rows_per_file`` rows."""
        pending.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(self.work)

    def score(self, scorer: Callable[[str, int], str], files_per_batch: int | None = None, **options) -> None:
        """Score all delivered work that no finished batch holds; ``options`` are those of ``batch_complete``.

        Run again after a failure, it takes up where the last run stopped.
        """
        work = self.spark.read.parquet(self.work)
        if files_per_batch is None:
            files_per_batch = max(FILES_PER_BATCH, -(-len(work.inputFiles()) // MAX_BATCHES))

        def each(batch: DataFrame, batch_id: int) -> None:
            scored = R.batch_complete(batch, scorer, **options)
            scored.write.mode("overwrite").parquet(f"{self.rows}/batch={batch_id}")
            mark = batch.sparkSession.range(1).select(F.lit(batch_id).cast("int").alias("batch"))
            mark.write.mode("overwrite").parquet(f"{self.done}/mark-{batch_id}")

        stream = self.spark.readStream.schema(work.schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.work)
        run_batches(stream, each, self.checkpoint)

    def finished(self) -> DataFrame | None:
        """Numbers of the batches that are stored whole; None before the first."""
        try:
            return self.spark.read.option("recursiveFileLookup", True).parquet(self.done)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def stored(self) -> DataFrame | None:
        """Rows of the finished batches with their ``batch`` and ``file``; None before the first. A
        batch that was stopped while it wrote has no mark, so its rows do not show."""
        done = self.finished()
        if done is None:
            return None
        rows = self.spark.read.option("basePath", self.rows).parquet(self.rows).withColumn("file", F.col("_metadata.file_name"))
        return rows.join(done, "batch", "left_semi")
