"""Vector codes by part-wise k-means, with LAESA pivots that save distance evaluations.

Vectors become integers, ``floor(scale * x)``, and are cut into ``parts`` equal
consecutive parts (if the length does not divide, the first parts are one longer).
Every part position has a codebook, first that part of the vectors with the
smallest ids. A round assigns every part to its nearest entry and moves each entry
to the floored mean of its parts.

A few entries of each first codebook, far from each other, are its *pivots*, and
stay so in all rounds. The distance of every part to its pivots is computed once
and stored beside the vector. In a round the distances of pivots to the present
entries are known too, so for a part x and an entry e the triangle inequality gives

    d(x, e) >= max over pivots p of |d(x, p) - d(p, e)|

Entries are taken in the order of this bound, and the exact integer distance is
evaluated only while the bound's square does not exceed the least distance so far.
Stored distances are integer square roots, rounded down, and the bound is one less,
so no rounding can rule an entry out: codes, ties (to the lower entry) and errors
are those of the full search.

Each task adds up its parts by entry and sends these sums on, ``entries * length``
numbers; Spark adds them, and the driver holds one set of codebooks.

Defined cases: vectors that are null or hold null or non-finite components are
dropped, and so are vectors whose length is not that of the smallest kept id; with
fewer ids than entries there are so many entries; of rows equal in id the smallest
vector begins an entry, and every row gets a code; a null id comes last; null labels
count as one label; an empty table gives no rows; columns other than the three are
not read, whatever their names. Components must stay below ``LIMIT`` after
scaling, as squared distances are 64-bit integers: others raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 24
STEP_ROWS = 4096
HOT = 1000  # a label of over one in HOT rows; there are fewer than HOT of them


@dataclass(frozen=True)
class Shape:
    """Scale of the integers, parts of a vector, entries (256 at most) and pivots of a codebook, and rounds."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    pivots: int = 4
    rounds: int = 6


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors * float(scale))
    if len(scaled) and np.abs(scaled).max(initial=0) >= LIMIT:
        raise ValueError(f"components times {scale} must stay below {LIMIT}")
    return scaled.astype(np.int64)


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(length), parts)]).tolist()
    return list(zip([0, *ends], ends))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the rows of ``y`` (one each, or one for all)."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    nearest = squared(entries, entries[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rooted distances of each row to each pivot."""
    return np.stack([roots(squared(x, p)) for p in pivots], axis=1)


def assign(x: np.ndarray, near: np.ndarray, entries: np.ndarray, entry_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry of each row, squared distance to it, number of distances evaluated).

    ``near``, ``entry_near``: rooted distances of rows and entries to the pivots.
    """
    bound = np.zeros((len(x), len(entries)), np.int64)
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - entry_near[None, :, p]) - 1, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(len(x), np.iinfo(np.int64).max)
    code = np.zeros(len(x), np.int64)
    rows, evaluated = np.arange(len(x)), 0
    for k in range(len(entries)):
        low = bound[rows, k]
        rows = rows[low * low <= best[rows]]  # the bounds rise, so a row that is out stays out
        if not len(rows):
            break
        entry = order[rows, k]
        found = squared(x[rows], entries[entry])
        evaluated += len(rows)
        least = best[rows]
        nearer = (found < least) | ((found == least) & (entry < code[rows]))
        best[rows[nearer]], code[rows[nearer]] = found[nearer], entry[nearer]
    return code, best, evaluated


class Codebooks:
    """The entries of every part position, and its pivots."""

    def __init__(self, seeds: np.ndarray, shape: Shape):
        self.shape, self.length = shape, seeds.shape[1]
        self.bounds = part_bounds(self.length, shape.parts)
        self.entries = [seeds[:, a:b] for a, b in self.bounds]
        self.pivots = [choose_pivots(e, shape.pivots) for e in self.entries]
        self.near = [distances(e, p) for e, p in zip(self.entries, self.pivots)]

    def moved(self, sums: dict[tuple[int, int], dict[int, int]]) -> None:
        """Entries become floored means. ``sums``: (part, entry) -> component -> sum, the count under -1."""
        for part, entries in enumerate(self.entries):
            entries = entries.copy()
            for entry in range(len(entries)):
                if found := sums.get((part, entry)):
                    entries[entry] = [found[c] // found[-1] for c in range(entries.shape[1])]
            self.entries[part] = entries
            self.near[part] = distances(entries, self.pivots[part])

    def sha256(self) -> str:
        numbers = (str(v) for entries in self.entries for v in entries.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors without null and non-finite components."""
    rows = common.plain(embeddings).select(
        F.col(f"_c{common.position(embeddings, 'vec_id')}").cast("long").alias("vec_id"),
        F.col(f"_c{common.position(embeddings, 'label')}").alias("label"),
        F.col(f"_c{common.position(embeddings, 'embedding')}").cast("array<double>").alias("embedding"),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~bad)


def first_vectors(kept: DataFrame, entries: int) -> np.ndarray | None:
    """The vectors of the smallest ids, ascending; None if there is none."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    if first is None:
        return None
    alike = kept.where(F.size("embedding") == first[0])
    ids = [r[0] for r in alike.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    among = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        among = F.coalesce(among, F.lit(False)) | F.col("vec_id").isNull()
    rows = alike.where(among).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = rows.orderBy(F.col("vec_id").asc_nulls_last()).collect()  # at most ``entries`` vectors
    return np.array([r["embedding"] for r in found], np.float64).reshape(len(found), first[0])


def with_pivot_distances(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, ints, near): components as 32-bit integers and each part's distances to its pivots, part by part."""
    scale, length, bounds, pivots = books.shape.scale, books.length, books.bounds, books.pivots
    names = ["vec_id", "label", "ints", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, STEP_ROWS):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = integers(flat.reshape(batch.num_rows, length), scale)
            near = np.concatenate([distances(x[:, a:b], p) for (a, b), p in zip(bounds, pivots)], axis=1)
            columns = [binaries(x.astype("<i4")), binaries(near.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], names=names)

    rows = kept.where(F.size("embedding") == length)
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, ints binary, near binary")


def binaries(rows: np.ndarray) -> pa.Array:
    width, data = rows.itemsize * rows.shape[1], np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def assigned(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Part by part: (part, its components, codes, squared distances, distances evaluated)."""
    x, near = (
        np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(np.int64) for c in ("ints", "near")
    )
    at = 0
    for part, (a, b) in enumerate(books.bounds):
        n = len(books.pivots[part])
        yield part, x[:, a:b], *assign(x[:, a:b], near[:, at : at + n], books.entries[part], books.near[part])
        at += n


def part_sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], dict[int, int]]:
    """The sums that move the entries: see ``Codebooks.moved``."""
    width = max(b - a for a, b in books.bounds)
    entries = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books.bounds), entries, width + 1), np.int64)  # the count is last
        for batch in common.slices(batches, STEP_ROWS):
            for part, x, code, _, _ in assigned(batch, books):
                for c in range(x.shape[1]):
                    sums[part, :, c] += whole_sums(code, x[:, c], entries)
                sums[part, :, width] += np.bincount(code, minlength=entries)
        part, entry, c = np.nonzero(sums[:, :, width:] > 0)
        part, entry = np.repeat(part, width + 1), np.repeat(entry, width + 1)
        c = np.tile(np.arange(width + 1), len(c))
        total = sums[part, entry, c]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, entry, np.where(c == width, -1, c), total)], names=["part", "entry", "c", "total"])

    found: dict[tuple[int, int], dict[int, int]] = {}
    totals = rows.mapInArrow(run, "part long, entry long, c long, total long").groupBy("part", "entry", "c").agg(F.sum("total").alias("total"))
    for r in totals.collect():  # as many numbers as the codebooks have
        found.setdefault((r["part"], r["entry"]), {})[r["c"]] = r["total"]
    return found


def whole_sums(code: np.ndarray, values: np.ndarray, entries: int) -> np.ndarray:
    """Exact sums by code: a step of ``STEP_ROWS`` values below ``LIMIT`` stays far below 2**53."""
    return np.bincount(code, weights=values, minlength=entries).astype(np.int64)


def fitted(rows: DataFrame, books: Codebooks) -> Codebooks:
    for _ in range(books.shape.rounds):
        books.moved(part_sums(rows, books))
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, evaluated): entry numbers in hexadecimal, summed squared distances, and how many were evaluated."""
    names = ["vec_id", "label", "code", "error", "evaluated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, STEP_ROWS):
            codes, error, evaluated = [], np.zeros(batch.num_rows, np.int64), 0
            for _, _, code, square, n in assigned(batch, books):
                codes.append(code.astype(np.uint8))
                error += square
                evaluated += n
            text, width = np.stack(codes, axis=1).tobytes().hex(), 2 * len(codes)
            digits = pa.array([text[k : k + width] for k in range(0, len(text), width)], pa.string())
            per_row = np.full(batch.num_rows, evaluated / max(batch.num_rows, 1))
            columns = [batch.column("vec_id"), batch.column("label"), digits, pa.array(error), pa.array(per_row)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long, evaluated double")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the error summed over equal labels.

    Labels of more than one in ``HOT`` rows are fewer than ``HOT`` and are broadcast,
    so no task of the join by label gets more than such a share of all rows.
    """
    spark = rows.sparkSession
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    totals = common.stored(spark, totals, "label-errors")
    n = totals.agg(F.sum("_n")).first()[0] or 0
    hot, rest = (totals.where(test).drop("_n") for test in (F.col("_n") * HOT > n, F.col("_n") * HOT <= n))
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = rows.join(F.broadcast(hot), same)
    seldom = rows.join(F.broadcast(hot.select("_label")), same, "left_anti").join(rest, same)
    return often.unionByName(seldom).drop("_label")


def encode(embeddings: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, Codebooks | None]:
    """(``coded`` rows, the fitted codebooks; None for a table without usable vectors)."""
    spark = embeddings.sparkSession
    kept = usable(embeddings)
    seeds = first_vectors(kept, shape.entries)
    if seeds is None:
        return kept.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0.0).alias("evaluated")), None
    books = Codebooks(integers(seeds, shape.scale), shape)
    rows = common.stored(spark, with_pivot_distances(kept, books), "pivot-distances")
    return common.stored(spark, coded(rows, fitted(rows, books)), "vector-codes"), books


def vector_codes(embeddings: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The contract's digest: (vec_id, code, error, label_error, codebooks_sha256)."""
    rows, books = encode(embeddings, shape)
    sha = F.lit(books.sha256() if books else "")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
