"""Token-id files compressed with Re-Pair grammars.

Documents are dealt out by ranges of ``doc_id`` and sorted, so shard after shard
holds them in ascending order. A shard is written as blocks of about
``BLOCK_IDS`` ids (a longer document is a block of its own). Each block has its
own grammar: frequent pairs of neighbouring symbols are replaced by new
nonterminals, round after round, until no pair occurs ``MIN_COUNT`` times. Where
occurrences overlap, the more frequent pair is replaced first, so copies of a
passage are cut alike wherever they stand. A rarer pair stays as it is: its rule
takes 12 bytes and each replacement saves one symbol of 2 or 4. A block stores its
rules and each rule's expansion length; prefix sums over the expansion lengths
of its symbols find any range of ids, and only the symbols that cover the range
are expanded.

File format: Parquet rows, written and read by Spark alone, so any store that
Spark reaches will do: ``shard``, ``block``, ``start`` (ids of the shard before the
block), ``n_ids``, ``doc_ids`` and ``sizes`` (ids of each document, end id included)
and ``grammar``, a binary value with

    b"RPG1" | base u4 | n_rules u4 | n_symbols u4 | width u4
    left u4[n_rules] | right u4[n_rules] | expansion u4[n_rules]
    symbols u2 or u4 [n_symbols]            (width 2 or 4), all little-endian

Symbols below ``base`` are token ids, ``base + k`` is rule ``k``; a rule names
only ids and earlier rules.

Defined cases: null and empty texts have the end id only; documents with equal
ids follow each other by text; a null ``doc_id`` comes first; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import common, tokens

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 20
MIN_COUNT = 24
HASH_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("grammar", pa.binary()),
    ]
)
BLOCK_DDL = "shard int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, grammar binary"


def frequent_pairs(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the frequent pairs, ascending; the rank of each; positions of ``at`` that start one; which each starts).

    Ranks follow the counts, equal counts a hash of the pair. Of many positions a
    table of hashed counts first sorts out those whose pair cannot be frequent;
    the rest are counted exactly.
    """
    code = pair_codes(seq, at)
    if len(at) >= 1 << HASH_BITS - 4:
        slot = ((code * MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        often = np.flatnonzero((np.bincount(slot, minlength=1 << HASH_BITS) >= least)[slot])
        at, code = at[often], code[often]
    codes, counts = np.unique(code, return_counts=True)
    codes, counts = codes[counts >= least], counts[counts >= least]
    rank = np.empty(len(codes), np.int64)
    rank[np.lexsort((codes * MIX, counts))] = np.arange(len(codes))
    if not len(codes):
        return codes, rank, at[:0], at[:0]
    # a pair's number by the hash of its code; those that share a slot with another are searched for
    table = np.zeros(1 << HASH_BITS, np.int32)
    table[((codes * MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = np.arange(len(codes))
    pair = table[((code * MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int64)].astype(np.int64)
    other = np.flatnonzero(codes[pair] != code)
    pair[other] = np.minimum(np.searchsorted(codes, code[other]), len(codes) - 1)
    hit = np.ones(len(code), bool)
    hit[other] = codes[pair[other]] == code[other]
    return codes, rank, at[hit], pair[hit]


def pair_codes(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]


def chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending positions: those whose pair ranks above the pairs that overlap it; of a
    pair that overlaps itself (a run of one symbol) every second, from the left."""
    linked = np.diff(at) == 1
    new = np.concatenate(([True], ~linked | (np.diff(rank) != 0)))
    first = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    r = rank[first]
    joined = linked[first[1:] - 1]  # to the stretch before
    top = np.ones(len(first), bool)
    top[1:] &= ~joined | (r[1:] > r[:-1])
    top[:-1] &= ~joined | (r[:-1] > r[1:])
    return top[stretch] & ((np.arange(len(at)) - first[stretch]) % 2 == 0)


def compress(ids: np.ndarray, rounds: int | None = None, min_count: int = MIN_COUNT) -> bytes:
    """The grammar of one block of ids, as bytes.

    The pair of the highest rank is replaced in every round, so the rounds end;
    ``rounds`` ends them sooner. The first round counts all pairs. A later one
    counts only where a frequent pair stood or a symbol is new: no other pair can
    have become frequent, as a replacement adds no occurrence of an older pair.
    """
    seq = ids.astype(np.uint32)
    open_at = np.arange(max(len(seq) - 1, 0))  # positions whose pair may be frequent
    base = int(seq.max()) + 1 if len(seq) else 0
    left, right, size = [], [], np.ones(0, np.uint32)
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        codes, rank, open_at, pair = frequent_pairs(seq, open_at, min_count)
        if not len(codes):
            break
        take = chosen(open_at, rank[pair])
        # a pair that mostly lost to others waits for a later round (half: it may overlap itself)
        rules = 2 * np.bincount(pair[take], minlength=len(codes)) >= min_count
        take &= rules[pair]
        at, first = open_at[take], base + len(size)
        seq[at] = first + (np.cumsum(rules) - 1)[pair[take]]
        codes = codes[rules]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        changed = np.zeros(len(seq), bool)
        changed[open_at] = changed[at] = True
        changed = changed[stay]
        seq = seq[stay]
        new = at - np.arange(len(at))  # where the new symbols stand now
        changed[new[new > 0] - 1] = True
        open_at = np.flatnonzero(changed[:-1])
        a, b = (codes >> np.uint64(32)).astype(np.uint32), codes.astype(np.uint32)
        left.append(a), right.append(b)
        lengths = lambda s: np.where(s < base, 1, size[np.maximum(s, base) - base] if len(size) else 1)
        size = np.concatenate((size, (lengths(a) + lengths(b)).astype(np.uint32)))
    width = 2 if base + len(size) <= 1 << 16 else 4
    head = np.array([base, len(size), len(seq), width], "<u4")
    rules = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in (left, right)]
    return b"".join([b"RPG1", head.tobytes(), *(r.astype("<u4").tobytes() for r in (*rules, size)), seq.astype(f"<u{width}").tobytes()])


class Grammar:
    """Random access to the ids of one block."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a grammar block")
        self.base, n, m, width = np.frombuffer(data, "<u4", 4, 4).tolist()
        self.left, self.right, self.size = (np.frombuffer(data, "<u4", n, 20 + 4 * n * k) for k in range(3))
        self.symbols = np.frombuffer(data, f"<u{width}", m, 20 + 12 * n).astype(np.int64)
        rule = self.symbols >= self.base
        lengths = np.ones(m, np.int64)
        lengths[rule] = self.size[self.symbols[rule] - self.base]
        self.ends = np.cumsum(lengths)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def _expansions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rules that ``symbols`` need, ascending; their expansions one after the other; where each starts."""
        needed = np.zeros(len(self.size), bool)
        while len(symbols):
            named = np.zeros(len(self.size), bool)
            named[symbols[symbols >= self.base] - self.base] = True
            front = np.flatnonzero(named & ~needed)
            needed[front] = True
            symbols = np.concatenate((self.left[front], self.right[front])).astype(np.int64)
        rules = np.flatnonzero(needed)
        starts = np.concatenate(([0], np.cumsum(self.size[rules], dtype=np.int64)))
        flat = np.empty(starts[-1], np.uint32)
        place = np.zeros(len(self.size), np.int64)
        place[rules] = starts[:-1]
        # a rule's height is one more than that of the higher of its two symbols; rules of one height at a time
        height = np.zeros(len(self.size) + 1, np.int64)
        sides = [np.where(x[rules] >= self.base, x[rules].astype(np.int64) - self.base, len(self.size)) for x in (self.left, self.right)]
        while True:
            higher = 1 + np.maximum(height[sides[0]], height[sides[1]])
            if (higher == height[rules]).all():
                break
            height[rules] = higher
        sizes = np.concatenate((self.size, [1])).astype(np.int64)
        for level in range(1, int(height.max(initial=0)) + 1):
            at = np.flatnonzero(height[rules] == level)
            to = starts[at]
            for side, symbol in zip(sides, (self.left, self.right)):
                child = side[at]
                ids = child == len(self.size)
                flat[to[ids]] = symbol[rules[at[ids]]]
                n = np.where(ids, 0, sizes[child])
                shift = np.repeat(np.cumsum(n) - n, n)
                step = np.arange(len(shift)) - shift
                flat[np.repeat(to, n) + step] = flat[np.repeat(place[np.where(ids, 0, child)], n) + step]
                to = to + sizes[child]
        return rules, flat, starts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``[start, stop)`` of the block; only the symbols that cover them, and the rules that those need, are expanded."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a = int(np.searchsorted(self.ends, start, "right"))
        b = int(np.searchsorted(self.ends, stop, "left")) + 1
        part = self.symbols[a:b]
        before = int(self.ends[a - 1]) if a else 0
        lengths = np.diff(np.concatenate(([before], self.ends[a:b])))
        rules, flat, starts = self._expansions(part)
        source = np.concatenate((flat, part.astype(np.uint32)))  # ids stand for themselves
        origin = len(flat) + np.arange(len(part))
        rule = np.flatnonzero(part >= self.base)
        origin[rule] = starts[np.searchsorted(rules, part[rule] - self.base)]
        at = np.cumsum(lengths) - lengths
        out = source[np.repeat(origin - at, lengths) + np.arange(int(lengths.sum()))]
        return out[start - before : stop - before]


def blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The compressed blocks of all documents, shards in ascending ``doc_id`` order."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokens.vocabulary(vocabulary))
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[int] = []
        data: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            return common.batch_of(BLOCK_SCHEMA, [[shard], [block], [start], [len(ids)], [names], [sizes], [compress(ids)]])

        held = 0
        for batch in common.slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                if held and held + len(ids) // 4 > block_ids:
                    yield flush()
                    names, sizes, data, held, block, start = [], [], [], 0, block + 1, start + held
                names.append(doc_id), sizes.append(len(ids) // 4), data.append(ids)
                held += len(ids) // 4
        if names:
            yield flush()

    rows = common.pick(docs, doc_id="long", text="string")
    dealt = rows.repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, BLOCK_DDL)


def write_ids(docs: DataFrame, path: str, **options) -> None:
    blocks(docs, **options).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``start`` counts all ids before."""
    return _read(spark, path, "ids", pa.binary(), bytes)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read_ids``, with the crc32 of the ids that were read in their place."""
    return _read(spark, path, "ids_crc32", pa.int64(), zlib.crc32)


def _read(spark: SparkSession, path: str, name: str, kind: pa.DataType, value: Callable[[bytes], object]) -> DataFrame:
    files = spark.read.schema(BLOCK_DDL).parquet(path)
    placed = common.with_offsets(files, "shard", "n_ids", "start")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):  # a block may hold a million documents
            for first, names, sizes, data in common.rows_of(batch, "start", "doc_ids", "sizes", "grammar"):
                grammar, at = Grammar(data), list(accumulate(sizes, initial=0))
                ids = memoryview(grammar.ids(0, len(grammar)).astype("<u4").tobytes())  # all documents of the block are asked for
                for a in range(0, len(names), 1000):
                    cut = at[a : a + 1001]
                    values = [value(ids[4 * x : 4 * y]) for x, y in zip(cut, cut[1:])]
                    yield common.batch_of(schema, [names[a : a + 1000], [first + x for x in cut[:-1]], sizes[a : a + 1000], values])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if kind == pa.int64() else 'binary'}")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest: write the files, read them back, one row per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, **options)
    return read_checksums(spark, path)
