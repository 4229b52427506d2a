"""Concatenate and cut: packing by two-pass prefix sums.

Pass one encodes every document once, appends the end id, and writes the ids with
the running start of each document inside its partition, and so the partition's
token total. The totals, one number a partition, are summed up to give each
partition's global offset. Pass two reads the ids back and cuts the endless
stream into windows of ``length`` tokens: a document's global start is its
partition's offset plus its start there, so every document is cut on its own,
and window ``w`` is the same whichever task meets it. There is no shuffle of ids
and no window holds padding but the very last.

Boundary records (one a piece) say which document lies where in which window.

Defined cases: null and empty texts have the end id only; repeated documents are
packed once a row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1

IDS_SCHEMA = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
PIECE_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(part, start, doc_id, n_tokens, ids): ids are unsigned 32-bit little-endian."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokens.vocabulary(vocabulary))
        part, at = TaskContext.get().partitionId(), 0
        for batch in common.slices(batches):
            ids = [x + end for x in encode(batch.column("text").to_pylist())]
            sizes = [len(x) // 4 for x in ids]
            starts = list(accumulate(sizes, initial=at))
            at = starts.pop()
            yield common.batch_of(IDS_SCHEMA, [[part] * len(ids), starts, batch.column("doc_id"), sizes, ids])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, ddl(IDS_SCHEMA))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row a piece, with its ids: where each run of a document's tokens lies."""
    spark = docs.sparkSession
    ids = common.stored(spark, encoded(docs, vocabulary, end_id), "packed-ids")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    offsets = dict(zip((r["part"] for r in totals), accumulate((r["n"] for r in totals), initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for part, start, doc_id, n, data in common.rows_of(batch, "part", "start", "doc_id", "n_tokens", "ids"):
                first, at = offsets[part] + start, 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    size = min(length - offset, n - at)
                    piece = data[4 * at : 4 * (at + size)]
                    out.append((doc_id, at, size, zlib.crc32(piece), n, sequence, offset, piece))
                    at += size
            yield common.batch_of(PIECE_SCHEMA, [list(c) for c in zip(*out)] or [[]] * len(PIECE_SCHEMA))

    return ids.mapInArrow(run, ddl(PIECE_SCHEMA))


def pieces(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of ``pack``: the boundary records without ids."""
    return pack(docs, **options).drop("ids")


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): each window's ids from its pieces.

    A window that is not full is padded to ``length`` unless its size is a power
    of two. A window has at most ``length`` pieces, so the group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
    )
    exact = F.bit_count("n_tokens") == 1
    fill = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({length} - n_tokens as int))"))
    return joined.withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", fill)))
