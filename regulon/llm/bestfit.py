"""Best-fit packing with large-item matching.

Documents become token ids with an end id. One of more than ``length`` ids is cut
into pieces of ``length``, the first of which may be shorter. Every piece has a
size from 1 to ``length``, so how all of them are packed depends only on how many
there are of each size, a histogram of at most ``length`` numbers, however many
documents there are. Best fit is run over that histogram, many equal pieces at a
time:

1. Pieces of ``length`` fill a sequence each.
2. *Large* pieces, above a third of ``length``, fit at most twice into a sequence.
   They are matched greedily, the largest first, each with the largest other one
   that fits, which makes as many pairs as can be.
3. The rest go, in falling size, each into the sequence with the smallest gap that
   takes it; a new sequence is begun only if there is none. A sequence with gap
   ``g`` takes ``g // size`` equal pieces before the next one is touched, so one
   step places a whole run of them.

The result is a table of runs: the pieces of one size with ranks ``rank .. rank +
count`` go, ``each`` to a sequence, to the sequences from ``sequence`` on, at
``offset``. Its number of rows is bounded by ``length`` alone. A piece's rank among
all pieces of its size is its rank inside its partition plus the number of such
pieces in the partitions before, a prefix sum over counts for each partition and
size. Then every piece finds its run by itself: no group of pieces ever meets in
one task, and the ids are not shuffled.

Defined cases: null and empty texts have the end id only; repeated documents are
packed once a row; a null ``doc_id`` stays null; columns other than ``doc_id`` and
``text`` are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

IDS_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("first", pa.int64()),  # size of piece 0
        ("rank", pa.int64()),  # its rank among the partition's pieces of that size
        ("full", pa.int64()),  # number of pieces after it, all of the full length
        ("full_rank", pa.int64()),
        ("crcs", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)
IDS_DDL = "part int, doc_id long, first long, rank long, full long, full_rank long, crcs array<long>, ids binary"


class Run(NamedTuple):
    """Where the pieces of ``size`` with ranks from ``rank`` on lie, ``count`` of them."""

    size: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], length: int) -> list[Run]:
    """Runs for ``histogram`` (size -> number of pieces)."""
    left = {s: n for s, n in histogram.items() if n > 0}
    placed = dict.fromkeys(left, 0)
    runs: list[Run] = []
    sequences = 0
    gaps: list[int] = []  # ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, number)

    def begin(n: int) -> int:
        nonlocal sequences
        sequences += n
        return sequences - n

    def place(size: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(size, placed[size], n, sequence, each, offset))
        placed[size] += n
        left[size] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in ranges:
                insort(gaps, gap)
            ranges.setdefault(gap, []).append((sequence, n))

    if left.get(length):
        place(length, left[length], begin(left[length]), 1, 0)
    large = sorted(s for s in left if s < length and 3 * s > length)
    for size in reversed(large):
        top = bisect_left(large, min(size, length - size) + 1) - 1  # the largest partner that fits
        while left[size]:
            while top >= 0 and left[large[top]] < (2 if large[top] == size else 1):
                top -= 1
            if top < 0:
                n = left[size]
                at = begin(n)
                place(size, n, at, 1, 0)
                leave(length - size, at, n)
            elif (other := large[top]) == size:
                n = left[size] // 2
                at = begin(n)
                place(size, 2 * n, at, 2, 0)
                leave(length - 2 * size, at, n)
            else:
                n = min(left[size], left[other])
                at = begin(n)
                place(size, n, at, 1, 0)
                place(other, n, at, 1, size)
                leave(length - size - other, at, n)
    for size in sorted((s for s in left if 3 * s <= length), reverse=True):
        while left[size]:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                at, n = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap], gaps[k]
            else:
                gap, n = length, -(-left[size] // (length // size))
                at = begin(n)
            each = gap // size
            count = min(left[size], n * each)
            whole, rest = divmod(count, each)
            place(size, count, at, each, length - gap)
            leave(gap - each * size, at, whole)
            if rest:
                leave(gap - rest * size, at + whole, 1)
            used = whole + (rest > 0)
            leave(gap, at + used, n - used)
    return runs


def encoded(docs: DataFrame, length: int, vocabulary: str, end_id: int) -> DataFrame:
    """One row a document: ids, the sizes of its pieces and their ranks inside the partition."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokens.vocabulary(vocabulary))
        part, ranks = TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in common.slices(batches):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                full, first = divmod(len(ids) // 4 - 1, length)
                first += 1
                rank = ranks[first]
                ranks[first] += 1
                full_rank = ranks[length]
                ranks[length] += full
                cuts = [0, *range(4 * first, len(ids) + 1, 4 * length)]
                out.append((part, doc_id, first, rank, full, full_rank, [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])], ids))
            yield common.batch_of(IDS_SCHEMA, [list(c) for c in zip(*out)] or [[]] * len(IDS_SCHEMA))

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, IDS_DDL)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) and, if asked for, its ``ids``."""
    spark = docs.sparkSession
    done = common.stored(spark, encoded(docs, length, vocabulary, end_id), "bestfit-ids")
    whole, one = F.lit(length).cast("long"), F.lit(1).cast("long")
    # piece 0, and the full pieces after it
    items = F.array(
        *(
            F.struct(F.lit(k).alias("piece"), size.alias("size"), F.col(rank).alias("rank"), n.alias("n"))
            for k, size, rank, n in ((0, F.col("first"), "rank", one), (1, whole, "full_rank", F.col("full")))
        )
    )
    counts = done.select("part", F.inline(items)).where("n > 0").groupBy("part", "size").agg(F.sum("n").alias("n"))
    counts = common.stored(spark, counts, "bestfit-counts")
    # one window row for each partition of the job above, and at most ``length`` windows
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    runs = np.array(sorted(plan(histogram, length)), np.int64).reshape(-1, len(Run._fields)).T

    ids = ["ids"] if with_ids else []
    rows = done.select("part", "doc_id", "first", "crcs", *ids, F.inline(items)).where("n > 0").join(offsets, ["part", "size"])
    steps = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    start = F.when(F.col("piece") + F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.col("first") + F.col("k") * length)
    pieces = steps.select(
        "doc_id", (F.col("piece") + F.col("k")).cast("int").alias("piece"), start.alias("start"), F.col("size").alias("length"),
        F.get("crcs", (F.col("piece") + F.col("k")).cast("int")).alias("ids_crc32"),
        (F.col("before") + F.col("rank") + F.col("k")).alias("rank"),
        *(F.substring(c, (4 * start + 1).cast("int"), (4 * F.col("size")).cast("int")).alias(c) for c in ids),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, _, sequence, each, offset = runs
        for batch in batches:
            s, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            low, high = np.searchsorted(size, s, "left"), np.searchsorted(size, s, "right")
            k = last_run(rank, r, low, high)
            sequence_id, place = sequence[k] + (r - rank[k]) // each[k], offset[k] + (r - rank[k]) % each[k] * s
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence_id), pa.array(place)], names=names)

    names = [c for c in pieces.columns if c != "rank"] + ["sequence_id", "offset"]
    kinds = {"piece": "int", "ids": "binary"}
    return pieces.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def last_run(rank: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each ``wanted`` the last place in ``[low, high)`` whose rank is not above it, by halving all at once."""
    while ((high - low) > 1).any():
        middle = (low + high) // 2
        right = (high - low > 1) & (rank[np.minimum(middle, len(rank) - 1)] <= wanted)
        low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
    return low


def pieces(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of ``pack``: the pieces without ids."""
    return pack(docs, with_ids=False, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from ``pack`` with ids. A sequence has at most ``length`` pieces, so the group is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
    )
