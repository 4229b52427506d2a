"""Suffix-array dedup with a logarithmic family of indexes.

Removes every byte that lies in a ``WINDOW``-byte string which also starts earlier
(smaller ``doc_id``, or the same document and an earlier start).

**Sparse suffix array.** Not every suffix need be indexed to find all matches of
100 bytes. Of the 69 suffixes that start a 32-byte string inside a window, the
window names the one whose 32 bytes hash lowest (the leftmost of equals) its
anchor. Equal windows have equal anchors at equal distances, so every match is
met at a pair of anchors. An entry of the array is an anchor: the hash of its 32
bytes (its sort key), a 48-bit hash of the whole text its windows cover (its
*context*), and where it is. About one suffix in 35 is an anchor.

**Family.** Entries are dealt out by their key to buckets; a bucket holds whole
runs of the sorted array. Inside a bucket each new batch of documents (ranges of
``doc_id``) is sorted and merge-scanned against itself and every existing level;
then it becomes a level, and levels of equal size merge, so there are at most
log2(batches) + 1. ``SuffixIndex`` stores the levels and takes up later batches.

* Equal key and context earlier: all windows of the anchor match, its whole run
  is removed, and the entry need not enter the index.
* Equal key, other context: some windows may match. The few such anchors of both
  sides are in doubt and are settled window by window: the text of each doubtful
  run goes to its key's bucket, all its windows are hashed (128 bits), and all but
  the first of equal ones are removed.

**Skew.** Each task first combines its own entries: of equal key and context only
the first goes on, the others are removed at once. So a text in a third of all
documents sends one entry a task. A key with more than ``CONTEXTS`` contexts in a
task or a bucket is hot (say, where a common passage begins): its further contexts
do not enter the index but are in doubt at once, and all its doubtful runs are
dealt out window by window, by the windows' own hashes, instead of by key.

Defined cases: null text is empty; texts under 100 bytes keep all; a null
``doc_id`` counts as the largest; rows equal in ``doc_id`` and text are one
document and get equal results; rows with equal ids and different texts are
ordered by the texts' CRC-32; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import Prefix, mixed

WINDOW = 100
ANCHOR = 32
BATCHES = 4
CONTEXTS = 32  # 2 at least: a key is known to be in doubt by its second context
CHUNK = 1 << 20  # bytes hashed at once
PIECE = 1 << 22  # longer texts are hashed in overlapping pieces
TASK_ENTRIES = 400_000  # entries a task holds before it combines and sends them
TASK_BYTES = 1 << 24  # doubtful windows a task holds before it sends them
LAST = (1 << 63) - 1

# kinds of rows between the steps
ENTRY, CLAIM, DOUBT, HOT, KEYS, LEVEL = range(6)
ENTRY_TYPE = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("sub", "<u4"), ("off", "<u4"), ("lo", "u1"), ("hi", "u1")])
WINDOW_TYPE = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("sub", "<u4"), ("off", "<u4")])
RUN_TYPE = np.dtype([("h", "<u8"), ("d", "<i8"), ("sub", "<u4"), ("off", "<u4"), ("n", "u1")])
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
SENT_DDL = "bucket int, kind int, data binary"
FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("d", pa.int64()), ("sub", pa.int64()), ("spans", pa.binary())])
FOUND_DDL = "kind int, d long, sub long, spans binary"

def anchors(data: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that start at ``starts`` in ``data`` and fill it.

    Returns (text, anchor position, first window, last window, key, context),
    positions in ``data``; windows that cross two texts do not count.
    """
    n, wide = len(data), window - anchor + 1
    if n < window:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    prefix = Prefix(data)
    hashes = prefix.all(anchor)
    low = np.uint64((1 << 24) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if wide > size:
        best = np.minimum(best[: len(best) - (wide - size)], best[wide - size :])
    at = (best & low).astype(np.int64)  # of each window
    ends = np.concatenate((starts[1:], [n]))
    valid = np.ones(len(at), bool)
    new = np.zeros(len(at) + 1, bool)
    for end in ends[:-1].tolist():  # windows that reach over a text's end
        valid[max(0, end - window + 1) : end] = False
    new[np.minimum(starts, len(at))] = True
    new = new[:-1]
    new[0] = True
    new[1:] |= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = new | ~valid  # a run ends before the next start or invalid window
    edges = np.flatnonzero(np.concatenate((stop[1:], [True])) & valid)
    pos = at[first]
    key = hashes[pos]
    text = np.searchsorted(starts, first, side="right") - 1
    context = prefix.of(first, edges + window) ^ mixed((edges - first + 256 * (pos - first) + 1).astype(np.uint64) << np.uint64(40))
    return text, pos, first, edges, key, context


def planes(rows: np.ndarray) -> bytes:
    """Columns, each by byte planes: equal and zero bytes then lie together."""
    out = [len(rows).to_bytes(8, "little")]
    for name in rows.dtype.names:
        column = np.ascontiguousarray(rows[name])
        width = 6 if name == "c" and "lo" in rows.dtype.names else column.dtype.itemsize
        out.append(column.view(np.uint8).reshape(len(rows), -1)[:, :width].T.tobytes())
    return b"".join(out)


def unplanes(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(data[:8], "little"), 8
    rows = np.zeros(n, kind)
    for name in kind.names:
        size = kind[name].itemsize
        width = 6 if name == "c" and "lo" in kind.names else size
        column = np.zeros((n, size), np.uint8)
        column[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        rows[name] = column.reshape(-1).view(kind[name])
        at += n * width
    return rows


def once(rows: np.ndarray) -> np.ndarray:
    """Rows in order without those equal to the one before: a repeated table row is one document."""
    if len(rows) < 2:
        return rows
    new = np.zeros(len(rows) - 1, bool)
    for name in ("off", "d", "sub", "h", "c"):
        new |= rows[name][1:] != rows[name][:-1]
    return rows[np.concatenate(([True], new))]


def by_key(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in the order of key, context, place; first of its key?; first of its key and context?)."""
    rows = once(rows[np.lexsort((rows["off"], rows["sub"], rows["d"], rows["c"], rows["h"]))])
    if not len(rows):
        return rows, np.empty(0, bool), np.empty(0, bool)
    new_h = np.concatenate(([True], rows["h"][1:] != rows["h"][:-1]))
    return rows, new_h, new_h | np.concatenate(([True], rows["c"][1:] != rows["c"][:-1]))


def combined(rows: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A task's entries -> (entries for the index, removed entries, entries of hot keys past ``contexts``)."""
    rows, new_h, new_c = by_key(rows)
    kept, new_h = rows[new_c], new_h[new_c]
    number = np.arange(len(kept))
    rank = number - np.maximum.accumulate(np.where(new_h, number, 0))  # of the context in its key
    return kept[rank < contexts], rows[~new_c], kept[rank >= contexts]


def sent(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple]:
    """(bucket, kind, planes) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() + [len(rows)] if len(rows) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), kind, planes(rows[a:b])


def dealt(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (rows["h"] % np.uint64(buckets)).astype(np.int64)


def claim_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by a hash of the document: ids may share a factor with the number of buckets, or be null."""
    key = mixed(mixed(rows["d"].astype(np.uint64)) ^ rows["sub"].astype(np.uint64))
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def extract(batches: Iterator[pa.RecordBatch], window: int, anchor: int, buckets: int, contexts: int) -> Iterator[pa.RecordBatch]:
    """Documents (d, sub, text) -> rows for the buckets."""
    held: list[np.ndarray] = []
    n_held = 0
    pieces: list[tuple[int, int, int, bytes]] = []
    size = 0

    def hashed() -> np.ndarray:
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        lens = np.array([len(p[3]) for p in pieces])
        starts = np.cumsum(lens) - lens
        text, pos, first, last, key, context = anchors(data, starts, window, anchor)
        rows = np.empty(len(pos), ENTRY_TYPE)
        rows["h"], rows["c"] = key, context & np.uint64((1 << 48) - 1)
        for name, k in (("d", 0), ("sub", 1)):
            rows[name] = np.array([p[k] for p in pieces], ENTRY_TYPE[name])[text]
        rows["off"] = pos - starts[text] + np.array([p[2] for p in pieces], np.int64)[text]
        rows["lo"], rows["hi"] = pos - last, pos - first
        return rows

    def flush() -> pa.RecordBatch:
        kept, removed, hot = combined(np.concatenate(held), contexts)
        out = [*sent(kept, dealt(kept, buckets), ENTRY)]
        for rows, kind in ((removed, CLAIM), (hot, HOT)):
            out += sent(rows, claim_bucket(rows, buckets), kind)
        keys = np.unique(hot["h"])
        out += [(int(k % np.uint64(buckets)), KEYS, k.tobytes()) for k in keys]
        return common.batch_of(SENT_SCHEMA, [list(c) for c in zip(*out)] or [[]] * 3)

    for batch in common.slices(batches):
        for d, sub, text in common.rows_of(batch, "d", "sub", "text"):
            raw = text.encode()
            for at in range(0, max(1, len(raw) - window + 1), PIECE):
                part = raw[at : at + PIECE + window - 1]
                if len(part) >= window:
                    pieces.append((d, sub, at, part))
                    size += len(part)
                if size >= CHUNK:
                    held.append(hashed())
                    n_held += len(held[-1])
                    pieces, size = [], 0
            if n_held >= TASK_ENTRIES:
                yield flush()
                held, n_held = [], 0
    if pieces:
        held.append(hashed())
    if held:
        yield flush()


class Family:
    """The levels of one bucket: sorted runs of entries, equal sizes merged."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels  # (size class, entries in order of key and context), falling classes
        self.claims: list[np.ndarray] = []
        self.doubts: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> None:
        """Scan a new batch against itself and each level, then index it."""
        rows, new_h, new_c = by_key(rows)
        self.claims.append(rows[~new_c])
        rows, new_h = rows[new_c], new_h[new_c]
        several = new_h & np.concatenate((~new_h[1:], [False])) if len(rows) else new_h
        doubt = several[np.maximum.accumulate(np.where(new_h, np.arange(len(rows)), 0))]
        stay = np.ones(len(rows), bool)
        for _, level in self.levels:
            # merge scan: where each entry's key stands in the sorted level
            a, b = (np.searchsorted(level["h"], rows["h"], side) for side in ("left", "right"))
            met = np.flatnonzero(b > a)
            lens = b[met] - a[met]
            mine = np.repeat(met, lens)
            other = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(a[met], lens)
            equal = level["c"][other] == rows["c"][mine]
            stay[mine[equal]] = False
            doubt[mine[~equal]] = True
            self.doubts.append(level[np.unique(other[~equal])])
        self.claims.append(rows[~stay])
        self.doubts.append(rows[doubt & stay])
        self.levels.append((0, rows[stay]))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, x), (_, y) = self.levels[-2:]
            self.levels[-2:] = [(k + 1, by_key(np.concatenate((x, y)))[0])]


def few_contexts(rows: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's entries of the first ``contexts`` contexts of each key, and the others."""
    rows, new_h, new_c = by_key(rows)
    number = np.cumsum(new_c)
    first = number[np.maximum.accumulate(np.where(new_h, np.arange(len(rows)), 0))] if len(rows) else number
    few = number - first < contexts
    return rows[few], rows[~few]


def split_hot(rows: np.ndarray, keys: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Doubtful entries -> (those of ordinary keys, those of hot keys), each once."""
    rows = np.unique(rows)
    values, at, counts = np.unique(rows["h"], return_inverse=True, return_counts=True)
    hot = ((counts > contexts) | np.isin(values, keys))[at]
    return rows[~hot], rows[hot]


def by_document(rows: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(d, sub, its rows of ``values`` by their first column)."""
    order = np.lexsort((values[:, 0], rows["sub"], rows["d"]))
    d, sub, values = rows["d"][order], rows["sub"][order], values[order]
    cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (sub[1:] != sub[:-1])))).tolist() + [len(d)] if len(d) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(d[a]), int(sub[a]), values[a:b]


def claims_of(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """Removed spans by document, united: (CLAIM, d, sub, pairs of u4)."""
    for d, sub, spans in by_document(rows, np.stack([start, end], axis=1)):
        yield CLAIM, d, sub, np.stack(common.union_spans(spans[:, 0], spans[:, 1]), axis=1).astype("<u4").tobytes()


def doubts_of(rows: np.ndarray, kind: int) -> Iterator[tuple]:
    """Doubtful anchors by document: (kind, d, sub, triples of u4: place, lo, hi)."""
    values = np.stack([rows[c].astype(np.int64) for c in ("off", "lo", "hi")], axis=1)
    for d, sub, part in by_document(rows, values):
        yield kind, d, sub, part.astype("<u4").tobytes()


def found_table(out: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([common.batch_of(FOUND_SCHEMA, [list(c) for c in zip(*out)] or [[]] * 4)])


def scan_bucket(table: pa.Table, window: int, bounds: list[int], contexts: int, keep_levels: bool) -> pa.Table:
    """One bucket: stored levels and new entries -> removed and doubtful runs (and levels)."""
    blobs: dict[int, list[np.ndarray]] = {ENTRY: [], CLAIM: [], HOT: []}
    levels: list[tuple[int, np.ndarray]] = []
    keys: list[bytes] = []
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
        if kind >= LEVEL:
            levels.append((kind - LEVEL, unplanes(data, ENTRY_TYPE)))
        elif kind == KEYS:
            keys.append(data)
        else:
            blobs[kind].append(unplanes(data, ENTRY_TYPE))
    none = np.empty(0, ENTRY_TYPE)
    family = Family(sorted(levels, key=lambda x: -x[0]))
    entries, rest = few_contexts(np.concatenate([none, *blobs[ENTRY]]), contexts)
    batch = np.searchsorted(np.array(bounds, np.int64), entries["d"], side="right")
    for k in np.unique(batch):
        family.add(entries[batch == k])
    hot_keys = np.frombuffer(b"".join(keys), np.uint64)
    # a key that is hot elsewhere has other contexts there, even if it has one here
    known = [level[np.isin(level["h"], hot_keys)] for _, level in family.levels] if len(hot_keys) else []
    doubt, hot = split_hot(np.concatenate([none, rest, *family.doubts, *known]), hot_keys, contexts)
    claims = np.concatenate([none, *blobs[CLAIM], *family.claims])
    place = claims["off"].astype(np.int64)
    out = [
        *claims_of(claims, place - claims["hi"], place - claims["lo"] + window),
        *doubts_of(doubt, DOUBT),
        *doubts_of(np.concatenate([hot, *blobs[HOT]]), HOT),
    ]
    if keep_levels:
        bucket = table["bucket"][0].as_py()
        out += [(LEVEL + k, bucket, 0, planes(rows)) for k, rows in family.levels]
    return found_table(out)


def runs_of(data: np.ndarray, triples: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, key) of a document's doubtful anchors."""
    place, lo, hi = np.frombuffer(b"".join(triples), "<u4").reshape(-1, 3).astype(np.int64).T
    near = np.concatenate([data[p : p + anchor] for p in place.tolist()])
    at = np.arange(len(place)) * anchor
    return place - hi, hi - lo + 1, Prefix(near).of(at, at + anchor)


def window_rows(text: np.ndarray, start: np.ndarray, count: np.ndarray, d, sub, first: np.ndarray, window: int) -> np.ndarray:
    """A row for each window of runs: run k holds ``count[k]`` windows from ``start[k]`` in
    ``text`` and from ``first[k]`` in its document."""
    run = np.repeat(np.arange(len(start)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = start[run] + step
    rows = np.empty(len(run), WINDOW_TYPE)
    for name, which in (("h", 0), ("c", 1)):
        rows[name] = Prefix(text, which).of(at, at + window)
    rows["d"], rows["sub"], rows["off"] = d[run], sub[run], first[run] + step
    return rows


def firsts(rows: np.ndarray) -> np.ndarray:
    """Marks the first of equal windows; returns (rows in hash order, mark)."""
    rows = rows[np.lexsort((rows["off"], rows["sub"], rows["d"]))] if len(rows) else rows
    order = np.lexsort((rows["c"], rows["h"]))  # stable: places stay in order
    rows = once(rows[order])
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    return rows, new


def extract_doubts(batches: Iterator[pa.RecordBatch], window: int, anchor: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents with doubtful anchors -> the text of their runs by key; windows of hot keys by window."""
    runs: list[np.ndarray] = []
    texts: list[bytes] = []
    windows: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out: list[tuple] = []
        if runs:
            rows = np.concatenate(runs)
            bucket = dealt(rows, buckets)
            for k in np.unique(bucket):
                at = np.flatnonzero(bucket == k)
                out.append((int(k), DOUBT, planes(rows[at]) + b"".join(texts[i] for i in at.tolist())))
        if windows:
            rows, new = firsts(np.concatenate(windows))
            out += sent(rows[new], dealt(rows[new], buckets), ENTRY)
            rest = rows[~new]
            out += sent(rest, claim_bucket(rest, buckets), CLAIM)
        return common.batch_of(SENT_SCHEMA, [list(c) for c in zip(*out)] or [[]] * 3)

    for batch in common.slices(batches):
        for d, sub, text, doubt, hot in common.rows_of(batch, "d", "sub", "text", "doubt", "hot"):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            if doubt:
                first, count, key = runs_of(data, doubt, window, anchor)
                rows = np.zeros(len(first), RUN_TYPE)
                rows["h"], rows["d"], rows["sub"], rows["off"], rows["n"] = key, d, sub, first, count
                runs.append(rows)
                texts.extend(raw[a : a + n + window - 1] for a, n in zip(first.tolist(), count.tolist()))
                size += len(first) * window
            if hot:
                first, count, _ = runs_of(data, hot, window, anchor)
                lens = count + window - 1
                near = np.concatenate([data[a : a + n] for a, n in zip(first.tolist(), lens.tolist())])
                same = np.full(len(first), d), np.full(len(first), sub)
                windows.append(window_rows(near, np.cumsum(lens) - lens, count, *same, first, window))
                size += windows[-1].nbytes
            if size >= TASK_BYTES:
                yield flush()
                runs, texts, windows, size = [], [], [], 0
    if size:
        yield flush()


def settle(table: pa.Table, window: int) -> pa.Table:
    """One bucket of doubtful runs or windows: all but the first of equal windows are removed."""
    rows, claims = [np.empty(0, WINDOW_TYPE)], [np.empty(0, WINDOW_TYPE)]
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
        if kind == DOUBT:
            runs = unplanes(data, RUN_TYPE)
            text = np.frombuffer(data, np.uint8)[8 + len(runs) * RUN_TYPE.itemsize :]
            count = runs["n"].astype(np.int64)
            lens = count + window - 1
            rows.append(window_rows(text, np.cumsum(lens) - lens, count, runs["d"], runs["sub"], runs["off"].astype(np.int64), window))
        else:
            (rows if kind == ENTRY else claims).append(unplanes(data, WINDOW_TYPE))
    ordered, new = firsts(np.concatenate(rows))
    gone = np.concatenate([ordered[~new], *claims])
    start = gone["off"].astype(np.int64)
    return found_table(list(claims_of(gone, start, start + window)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, d, sub): the document's place in the order of documents."""
    rows = common.pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("sub", F.crc32("text"))


def bucket_count(spark: SparkSession) -> int:
    """Two buckets a shuffle partition, so that partitions come out more even."""
    return 2 * common.partitions(spark)


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """First ``doc_id`` of each batch but the first: ``batches`` even ranges."""
    low, high = common.pick(docs, doc_id="long").agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    return sorted({low + (high - low + 1) * k // batches for k in range(1, batches)} - {low})


def duplicate_spans(
    docs: DataFrame,
    earlier: DataFrame | None = None,
    levels: DataFrame | None = None,
    batches: int = BATCHES,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    keep_levels: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """((d, sub, spans): removed spans; the scan's stored rows with the new levels).

    ``levels`` (bucket, kind, data): stored levels to scan against; ``earlier``:
    the documents indexed there, whose texts settle doubtful runs.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    if levels is not None:
        buckets = levels.select(F.max("buckets")).first()[0] or buckets
    rows, bounds = keyed(docs), batch_bounds(docs, batches)
    contexts = (1 << 31) if keep_levels else CONTEXTS  # a stored family has to know every context
    entries = rows.select("d", "sub", "text").mapInArrow(lambda it: extract(it, window, anchor, buckets, contexts), SENT_DDL)
    if levels is not None:
        entries = entries.unionByName(levels.select("bucket", "kind", "data"))
    scan = entries.groupBy("bucket").applyInArrow(lambda t: scan_bucket(t, window, bounds, contexts, keep_levels), FOUND_DDL)
    scan = common.stored(spark, scan, "suffix-scan")

    def lists(kind: int) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.col("spans")))

    doubts = scan.where(F.col("kind").isin(DOUBT, HOT)).groupBy("d", "sub").agg(lists(DOUBT).alias("doubt"), lists(HOT).alias("hot"))
    texts = rows if earlier is None else rows.unionByName(keyed(earlier))
    # rows equal in id and text are one document
    texts = texts.select("d", "sub", "text").join(doubts, ["d", "sub"])
    runs = texts.mapInArrow(lambda it: extract_doubts(it, window, anchor, buckets), SENT_DDL)
    settled = runs.groupBy("bucket").applyInArrow(lambda t: settle(t, window), FOUND_DDL)
    claims = scan.where(F.col("kind") == CLAIM).unionByName(settled)
    spans = claims.groupBy("d", "sub").agg(F.collect_list("spans").alias("spans"))
    return spans, scan


def merged(spans: list[bytes] | None) -> list[tuple[int, int]]:
    runs = np.frombuffer(b"".join(spans or ()), "<u4").reshape(-1, 2).astype(np.int64)
    return list(zip(*(x.tolist() for x in common.union_spans(runs[:, 0], runs[:, 1]))))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)]))


RESULT_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)


def removed_bytes(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest: bytes, removed bytes and runs, hash of the rest."""
    spans, _ = duplicate_spans(docs, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for doc_id, text, parts in common.rows_of(batch, "doc_id", "text", "spans"):
                raw, cut = text.encode(), merged(parts)
                kept = without(raw, cut)
                out.append((doc_id, len(raw), len(raw) - len(kept), len(cut), common.sha256_hex(kept)))
            yield common.batch_of(RESULT_SCHEMA, [list(c) for c in zip(*out)] or [[]] * 5)

    return keyed(docs).join(spans, ["d", "sub"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def cut_text(text: str | None, parts: list[bytes] | None) -> str | None:
    """The text without its removed spans, each shrunk to whole characters."""
    if text is None or not parts:
        return text
    raw, spans = text.encode(), []
    for a, b in merged(parts):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        spans.append((a, b))
    return without(raw, spans).decode()


def cut(docs: DataFrame, length_column: str | None = None, **options) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all columns, all rows.

    ``length_column``: a column that holds the text's length in characters and follows it.
    """
    spans, _ = duplicate_spans(docs, **options)
    at, ident, width = common.position(docs, "text"), common.position(docs, "doc_id"), len(docs.columns)
    length = None if length_column is None else common.position(docs, length_column)
    plain = common.plain(docs)
    text = F.coalesce(F.col(f"_c{at}").cast("string"), F.lit(""))
    placed = plain.withColumns({"d": F.coalesce(F.col(f"_c{ident}").cast("long"), F.lit(LAST)), "sub": F.crc32(text)})
    joined = placed.join(spans, ["d", "sub"], "left").select(*plain.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [cut_text(t, p) for t, p in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist())]
            columns = batch.columns[:width]
            columns[at] = pa.array(texts, type=columns[at].type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([n if t is None else len(t) for t, n in zip(texts, old)], type=columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"_c{i}" for i in range(width)])

    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)


class SuffixIndex:
    """A stored family: ``add`` takes batches in ascending ``doc_id`` order.

    The folder holds one generation of levels for each batch added; only the
    newest is read. The number of buckets is set by the first batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.generation = spark, path.rstrip("/"), 0

    def add(self, docs: DataFrame, earlier: DataFrame | None = None, **options) -> DataFrame:
        """(d, sub, spans) removed from ``docs``; ``earlier``: all documents added before."""
        levels = self.spark.read.parquet(f"{self.path}/{self.generation}") if self.generation else None
        spans, scan = duplicate_spans(docs, earlier, levels, batches=1, keep_levels=True, **options)
        buckets = bucket_count(self.spark) if levels is None else levels.select(F.max("buckets")).first()[0]
        kept = scan.where(F.col("kind") >= LEVEL).select(
            F.col("d").cast("int").alias("bucket"), "kind", F.col("spans").alias("data"), F.lit(buckets).alias("buckets")
        )
        self.generation += 1
        kept.write.parquet(f"{self.path}/{self.generation}")
        new = keyed(docs).select("d", "sub").distinct()
        return spans.join(new, ["d", "sub"], "left_semi")
