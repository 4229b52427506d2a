"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item is normalised to plain words (see ``common``). Its windows
are all runs of ``window`` consecutive words; an item with fewer words, but not
none, is one window. All windows of a block of items go into one automaton,
each document is normalised the same way and scanned once, and every hit is
mapped back to word numbers and to byte offsets of the original text.

The automaton is the one thing sent to all tasks. Its size is bounded by
``block_words`` benchmark words, that is about as many windows: measured, 20,000
windows take 53 MB of a worker, so the default of 100,000 takes about 270. A larger
benchmark is scanned in several blocks (a stated query set against all rows), one
after the other: the driver holds one block, a worker one automaton, and what a pass
found is written to the shared folder before the next. A long item is cut into
pieces that share ``window`` - 1 words, so that no window is lost.

Defined cases: null text has no words; an item with a null id or null text is
ignored, as is an item without words; items with equal ids count as one id;
repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BLOCK_WORDS = 100_000

SPAN = pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("hit_spans", pa.list_(SPAN)),
    ]
)
SPARK_SCHEMA = (
    "doc_id long, n_words long, n_hit long, item_ids array<string>, "
    "hit_spans array<struct<word: long, n_words: long, start: long, end: long>>"
)


def normalise(text: str | None) -> bytes:
    """Plain words joined by single spaces, with a space at both ends."""
    return b" " + b" ".join((text or "").encode().translate(common.PLAIN).split()) + b" "


def windows_of(text: str | None, window: int) -> set[bytes]:
    """The item's windows as normalised byte strings with outer spaces."""
    words = normalise(text).split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def automaton_of(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Windows -> (number of words, ids of the items that hold the window)."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item_id, text in items:
        for w in windows_of(text, window):
            owners[w].add(item_id)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(sorted(ids))))
    if owners:
        found.make_automaton()
    return found


def hits_of(norm: bytes, found: ahocorasick.Automaton) -> tuple[set[str], np.ndarray, np.ndarray]:
    """Item ids and [start, end) word numbers of all hits in a normalised text."""
    hits = list(found.iter(norm.decode("latin-1"))) if len(found) else []
    ids: set[str] = set()
    for _, value in hits:
        ids.update(value[2])
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) if hits else np.empty(0, np.int64)
    # a hit's last byte is the space after its last word
    last = np.searchsorted(spaces, np.fromiter((end for end, _ in hits), np.int64, len(hits)))
    lens = np.fromiter((value[1] for _, value in hits), np.int64, len(hits))
    return ids, last - lens, last


def scan(text: str | None, found: ahocorasick.Automaton, known: tuple = ((), ())) -> tuple[int, int, list[str], list[dict]]:
    """(words, hit words, item ids, hit spans) of one document.

    ``known``: item ids and spans that an earlier block of items gave.
    """
    norm = normalise(text)
    n_words = norm.count(b" ") - 1 if len(norm) > 2 else 0
    ids, starts, ends = hits_of(norm, found) if n_words else (set(), [], [])
    if not len(starts) and not known[1]:
        return n_words, 0, [], []
    ids.update(known[0])
    starts = np.concatenate((starts, [s["word"] for s in known[1]])).astype(np.int64)
    ends = np.concatenate((ends, [s["word"] + s["n_words"] for s in known[1]])).astype(np.int64)
    starts, ends = common.union_spans(starts, ends)
    plain = np.frombuffer(text.encode().translate(common.PLAIN), np.uint8) != 32
    words = common.ranges_of(plain)  # byte ranges of the words in the original text
    spans = [
        {"word": int(a), "n_words": int(b - a), "start": int(words[a, 0]), "end": int(words[b - 1, 1])}
        for a, b in zip(starts, ends)
    ]
    return n_words, int((ends - starts).sum()), sorted(ids), spans


def item_pieces(text: str, window: int, most: int) -> Iterator[tuple[int, str]]:
    """(number of words, normalised text) of pieces that have all windows of the item, about ``most`` words each."""
    words = normalise(text).decode().split()
    step = max(most - window + 1, 1)
    for at in range(0, max(len(words) - window + 1, 1) if words else 0, step):
        piece = words[at : at + step + window - 1]
        yield len(piece), " ".join(piece)


def item_blocks(benchmark: DataFrame, block_words: int, window: int = WINDOW) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """(items in blocks of about ``block_words`` words, whether the block is the last)."""
    rows = common.pick(benchmark, item_id="string", text="string").dropna()
    block: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        for n, piece in item_pieces(row["text"], window, block_words):
            if block and size + n > block_words:
                yield block, False
                block, size = [], 0
            block.append((row["item_id"], piece))
            size += n
    yield block, True


def scanner(items: list[tuple[str, str]], window: int, first: bool, last: bool):
    """A pass of one automaton over batches of documents; all but the last hand on the text."""
    schema = SCHEMA if last else SCHEMA.append(pa.field("text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton_of(items, window)
        for batch in batches:
            texts = batch.column("text")
            known = [((), ())] * len(texts) if first else common.rows_of(batch, "item_ids", "hit_spans")
            out = [scan(t, found, k) for t, k in zip(texts.to_pylist(), known)]
            columns = [list(x) for x in zip(*out)] or [[]] * 4
            yield common.batch_of(schema, [batch.column("doc_id"), *columns, *([] if last else [texts])])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, item ids and merged hit spans.

    ``hit_spans`` holds word numbers and byte offsets into the UTF-8 original.
    Passes over several blocks of items hand on the rows with what they found, so there
    is no shuffle; all but the last are written to the shared folder.
    """
    out = common.pick(docs, doc_id="long", text="string")
    for k, (items, last) in enumerate(item_blocks(benchmark, block_words, window)):
        out = out.mapInArrow(scanner(items, window, k == 0, last), SPARK_SCHEMA + ", text string" * (not last))
        if not last:
            out = common.stored(docs.sparkSession, out, "decontam-pass")
    return out


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's digest of ``decontaminate``: one row per document."""
    return decontaminate(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window."""
    at = common.position(docs, "text")

    def keep(items: list[tuple[str, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton_of(items, window)
            for batch in batches:
                norms = map(normalise, batch.column(at).to_pylist())
                yield batch.filter(pa.array([not len(hits_of(n, found)[1]) for n in norms], pa.bool_()))

        return run

    out = common.plain(docs)
    for items, last in item_blocks(benchmark, block_words, window):
        out = out.mapInArrow(keep(items), out.schema)
        if not last:
            out = common.stored(docs.sparkSession, out, "decontam-pass")
    return out.toDF(*docs.columns)
