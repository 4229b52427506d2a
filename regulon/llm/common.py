"""Shared helpers of the training-data operators.

Text conventions used by several operators:

* *space words*: maximal runs of ``[^\\x20\\x09-\\x0D]`` (split on the six ASCII
  white-space characters), optionally with A-Z lower-cased;
* *plain words*: maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z
  is lower-cased, that is digits, a-z and every character above U+007F.

Both are computed on UTF-8 bytes with one ``bytes.translate`` and one
``bytes.split``. The translation keeps the length, so byte offsets in the
translated text are byte offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def position(df: DataFrame, name: str) -> int:
    """Index of the column of that exact name, else of that name ignoring case."""
    hits = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
    if not hits:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return hits[0]


def plain(df: DataFrame) -> DataFrame:
    """The same columns under the names ``_c0``, ``_c1``, ...: unambiguous whatever they were called."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Select columns by name, cast them, and drop the rest.

    Columns are addressed by position, so extra columns whose names repeat or
    differ only in case cannot make a reference ambiguous.
    """
    return plain(df).select(*(F.col(f"_c{position(df, n)}").cast(kind).alias(n) for n, kind in types.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs only its running tasks.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_offsets(df: DataFrame, part: str, size: str, start: str) -> DataFrame:
    """``df`` with ``start``, counted inside its ``part``, counted over all parts in ascending order.

    The totals are one number a part, and parts are the partitions of the job that
    wrote ``df``: a few hundred thousand rows at most, summed up in one window and
    broadcast.
    """
    totals = df.groupBy(F.col(part).alias("_part")).agg(F.sum(size).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = df.join(F.broadcast(totals), F.col(part) == F.col("_part"))
    return joined.withColumn(start, F.col(start) + F.col("_before")).drop("_part", "_before")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: sized by the user with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The batch's rows as tuples of Python values, in column order ``names``."""
    return zip(*(batch.column(n).to_pylist() for n in names))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for steps whose own output is as large as their input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranges_of(flags: np.ndarray) -> np.ndarray:
    """``[[start, end), ...]`` of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, touching spans merged, ascending."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate((first[1:] - 1, [len(ends) - 1]))]
