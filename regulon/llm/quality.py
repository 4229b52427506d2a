"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and repeated 3-word windows. The
method builds the suffix array of each text's words by prefix doubling, takes
the longest common prefix of neighbouring suffixes, and from the LCP intervals
the maximal repeated substrings: a suffix's longest repeat has the length of the
deepest interval that holds it, the larger of its two neighbouring LCPs. The
spans of all repeats of at least ``min_repeat`` words are united. A text is
rejected if they cover more than ``max_covered`` of its words or if one repeat
is longer than ``max_longest`` words.

Many texts share one pass of vectorised steps: word numbers are unique to a
text, so suffixes of different texts never compare equal. A pass holds about
``PASS_WORDS`` words or one longer text; after a step only suffixes that still
tie with another go on.

Defined cases: a null, empty or blank text has no words and fails the base
rules; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = b"#*$%&|<>"
PASS_WORDS = 200_000


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the repetition verdict."""

    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.3
    max_longest: int = 200


COLUMNS = {
    "doc_id": pa.int64(),
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
    "kept": pa.bool_(),
}
SCHEMA = pa.schema(list(COLUMNS.items()))
SPARK_SCHEMA = ", ".join(f"{k} {'boolean' if v == pa.bool_() else 'long'}" for k, v in COLUMNS.items())


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest repeated substring that starts there.

    ``ids``: word numbers from 0, none shared by two documents; ``doc``: the
    document of each position, in runs. Repeats may overlap, and end with their text.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    end = np.searchsorted(doc, doc, side="right")  # end of each position's document
    # ranks by the first 2^k words: the number of suffixes that sort before the group
    counts = np.bincount(ids)
    starts = np.cumsum(counts) - counts
    ranks = [starts[ids]]
    active = np.flatnonzero(counts[ids] > 1)
    width = 1
    while len(active):
        rank = ranks[-1]
        ahead = active + width
        tail = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        head = rank[active]
        order = np.lexsort((tail, head))
        h, t = head[order], tail[order]
        new_head = np.concatenate(([True], h[1:] != h[:-1]))
        new_pair = new_head | np.concatenate(([True], t[1:] != t[:-1]))
        at = np.arange(len(order))
        group = np.maximum.accumulate(np.where(new_head, at, 0))
        first = np.maximum.accumulate(np.where(new_pair, at, 0))
        following = rank.copy()
        following[active[order]] = h + (first - group)
        ranks.append(following)
        single = new_pair & np.concatenate((new_pair[1:], [True]))
        active = np.sort(active[order[~single]])
        width *= 2
    # neighbours in suffix order; the LCP from the ranks of falling widths
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    tied = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b = a[tied], b[tied]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (x < end[a]) & (y < end[b])
        rank = ranks[k]
        same &= rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        lcp += same.astype(np.int64) << k
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(length: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """Words of each document inside the union of the spans of at least ``least`` words."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return words, chars, symbols, len(lines) - len(set(lines))


def judge(texts: list[str | None], rules: Rules) -> Iterator[tuple]:
    """The result columns after ``doc_id``, text by text."""
    held: list[tuple] = []
    ids: list[np.ndarray] = []
    known = 0

    def flush() -> Iterator[tuple]:
        doc = np.repeat(np.arange(len(held)), [len(x) for x in ids])
        length = longest_repeats(np.concatenate(ids), doc)
        windows = covered(length, doc, len(held), rules.window)
        long_ones = covered(length, doc, len(held), rules.min_repeat)
        longest = np.zeros(len(held), np.int64)
        np.maximum.at(longest, doc, length)
        for (n, chars, symbols, dup), w, c, m in zip(held, windows.tolist(), long_ones.tolist(), longest.tolist()):
            failed = n < rules.min_words or 100 * w > rules.max_window_percent * n
            kept = not failed and c <= rules.max_covered * n and m <= rules.max_longest
            yield n, chars, symbols, dup, w, failed, c, m, kept

    size = 0
    for text in texts:
        words, chars, symbols, dup = base_counts(text)
        numbers: dict[bytes, int] = {}
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) + known)
        known += len(numbers)
        held.append((len(words), chars, symbols, dup))
        size += len(words)
        if size >= PASS_WORDS:
            yield from flush()
            held, ids, known, size = [], [], 0, 0
    if held:
        yield from flush()


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, ``base_failed``, repetition figures and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = list(judge(batch.column("text").to_pylist(), rules))
            columns = [list(c) for c in zip(*out)] or [[]] * (len(SCHEMA) - 1)
            yield common.batch_of(SCHEMA, [batch.column("doc_id"), *columns])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, SPARK_SCHEMA)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    at = common.position(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            verdicts = [row[-1] for row in judge(batch.column(at).to_pylist(), rules)]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    rows = common.plain(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
