"""SimHash near-duplicates by pigeonhole blocks.

1. Fingerprint: every ``shingle``-word shingle (repeats included) is hashed with
   XXH64; bit i is 1 if it is set in over half of the hashes.
2. Equal fingerprints collapse to one row, so a group of copies costs one row
   however large it is.
3. The 64 bits are cut into ``blocks`` blocks. Two fingerprints at ``distance``
   or fewer differing bits agree on at least ``blocks - distance`` blocks, so
   they meet under one of the C(blocks, distance) choices of that many blocks.
   Fingerprints are joined on each choice and every candidate pair is verified
   by its Hamming distance.
4. In a bucket of at most ``SMALL`` fingerprints all pairs are compared. A larger
   one is walked breadth first: each step compares one fingerprint with all that
   are not reached yet. That gives the bucket's exact components without writing
   its pairs; only edges to each component's smallest member leave.
   A bucket of more than ``bucket_rows`` fingerprints is dealt out over all pairs
   of salted parts, so that any two members still meet, each task's share is
   bounded, and no case is dropped.
5. Components of the edges by alternating large-star and small-star steps, each
   written to the shared folder.

Defined cases: null or blank text has no words and fingerprint zero, which links
like any other; repeated rows each get a row; null ids never become a
component's id unless the component has no other (then it is null); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
BUCKET_ROWS = 4096
SEED = 42
CHUNK = 1 << 15
SMALL = 8

FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGE_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().translate(common.LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        parts = (words[at + k : min(at + CHUNK, n) + k] for k in range(shingle))
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*parts)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(doc_id, fp): the SimHash as a signed long; on demand a hash of the text as ``digest``."""
    rows = common.pick(docs, doc_id="long", text="string")
    schema = FP_SCHEMA
    if digest:
        rows, schema = rows.withColumn("digest", F.xxhash64("text")), FP_SCHEMA.append(pa.field("digest", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            rest = [batch.column("digest")] if digest else []
            yield common.batch_of(schema, [batch.column("doc_id"), pa.array(fps.view(np.int64)), *rest])

    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest long" * digest)


def masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of ``blocks - distance`` blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def bucket_edges(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Star edges (member, smallest member) of the components of one bucket."""
    fp = np.unique(fp)
    out: list[tuple[int, int]] = []
    bits = fp.view(np.uint64)
    left = np.ones(len(fp), bool)
    for k in range(len(fp)):
        if not left[k]:
            continue
        left[k] = False
        todo = [k]
        while todo and left.any():
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(bits[rest] ^ bits[todo.pop()]) <= distance]
            left[near] = False
            todo.extend(near.tolist())
            out.extend((int(fp[j]), int(fp[k])) for j in near)
    return out


def edges_of(rows: np.ndarray, distance: int) -> np.ndarray:
    """Edges (u, v), u > v, of rows ``(t, key, a, b, fp)`` sorted by bucket (all but fp)."""
    if len(rows) < 2:
        return np.empty((0, 2), np.int64)
    new = np.concatenate(([True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(rows)])))
    fp, bucket = rows[:, 4], np.cumsum(new) - 1
    bits, out = fp.view(np.uint64), []
    few = size[bucket] <= SMALL
    for shift in range(1, min(SMALL, size.max())):
        same = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & few[shift:])
        near = same[np.bitwise_count(bits[same] ^ bits[same + shift]) <= distance]
        out.append(np.stack([fp[near], fp[near + shift]], axis=1))
    for k in np.flatnonzero(size > SMALL):
        out.append(np.array(bucket_edges(fp[first[k] : first[k] + size[k]], distance), np.int64).reshape(-1, 2))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    pairs = np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1) if len(pairs) else pairs
    return pairs[pairs[:, 0] != pairs[:, 1]]


def candidate_edges(distinct: DataFrame, distance: int, blocks: int, bucket_rows: int) -> DataFrame:
    """Verified star edges (u, v), u > v as signed longs, over all buckets."""
    spark = distinct.sparkSession
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(blocks, distance)]
    keys = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"),
    )
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # parts of a large bucket; a member goes to every pair of parts that holds its own
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keys.join(sizes, ["t", "key"])
        .select("fp", "t", "key", parts.alias("parts"))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "fp", "t", "key",
            F.least("mine", "other").alias("a"),
            F.greatest("mine", "other").alias("b"),
        )
    )
    group = ["t", "key", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the bucket at the end of a batch may go on in the next
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in (*group, "fp")], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if (held[0][0, :4] == rows[-1, :4]).all():
                continue
            rows = np.concatenate(held)
            last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1
            held = [rows[last:]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, edges_of(rows[:last], distance).T)), schema=EDGE_SCHEMA)
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, edges_of(np.concatenate(held), distance).T)), schema=EDGE_SCHEMA)

    n = common.partitions(spark)
    typed = dealt.select(*(F.col(c).cast("long").alias(c) for c in (*group, "fp")))
    return (
        typed.repartition(n, *group)
        .sortWithinPartitions(*group)
        .mapInArrow(run, "u long, v long")
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over undirected edges (u, v).

    Alternates large-star and small-star until the edge set stands still; nodes
    without an edge do not appear. Every step is written to the shared folder; its
    smallest neighbours too, so that the join with them has a shuffle on both
    sides and Spark can split a node with very many edges.
    """
    spark = edges.sparkSession
    edges = common.stored(spark, edges, "cc")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = common.stored(spark, low, "cc")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(spark, large.where("u != v").distinct(), "cc")
        low = common.stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = common.stored(spark, small, "cc")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labels(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, component_id) per fingerprint of stored ``fingerprints``; ``root`` names the component."""
    spark = fps.sparkSession
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(candidate_edges(distinct.select("fp"), distance, blocks, bucket_rows))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    labelled = common.stored(spark, labelled, "cc")
    ids = common.stored(spark, labelled.groupBy("root").agg(F.min("first").alias("component_id")), "cc")
    return labelled.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """(doc_id, fp, component_id) per document row."""
    fps = common.stored(docs.sparkSession, fingerprints(docs, shingle), "fp")
    return fps.join(labels(fps, **options).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest of ``near_duplicates``."""
    return near_duplicates(docs, **options).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row of each component, the one with the smallest id; all columns.

    A null id stays only where the component has no other. Of rows in one component
    that share the kept id the one whose text has the smallest hash stays, and of
    rows equal in id and text any one. The rows are found by id and text, since an
    id may occur in other components too.
    """
    spark = docs.sparkSession
    fps = common.stored(spark, fingerprints(docs, shingle, digest=True), "fp")
    first = fps.join(labels(fps, **options), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = first.groupBy("root", "doc_id").agg(F.min(F.struct("digest", "n")).alias("x"))
    kept = common.stored(spark, first.select(F.col("doc_id").alias("_kept"), F.col("x.digest").alias("_digest"), F.col("x.n").alias("_n")), "cc")
    rows, ident, text = common.plain(docs), f"_c{common.position(docs, 'doc_id')}", f"_c{common.position(docs, 'text')}"
    same = F.col(ident).cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_digest"))
    out = rows.join(kept.where("_n = 1"), same, "left_semi")
    if not kept.where("_n > 1").isEmpty():  # only such rows are shuffled whole
        out = out.unionByName(rows.join(kept.where("_n > 1"), same, "left_semi").dropDuplicates([ident, text]))
    return out.toDF(*docs.columns)
