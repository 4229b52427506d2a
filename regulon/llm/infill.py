"""Fill-in-middle transformation by displacement scatter.

Every text is cut into units (a word with the white space before it; white space
at the end is a unit of its own), two unit boundaries are drawn from a hash of
the document's id, and the three parts are written in another order between
sentinels. No string is assembled part by part: many texts lie in one array of
bytes, a difference array holds how far the bytes of each part move more than
those before them, its cumulative sum is every byte's shift, and one scatter
puts all bytes in place. ``restore`` reads the sentinels out of the output, builds
the same shifts and gathers the bytes back.

Both directions work in steps of about ``STEP_BYTES`` of text, or one longer text,
and within a step move ``CHUNK_BYTES`` at a time, the shift carried on from chunk
to chunk, so a very long text needs a few bytes of memory a byte.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle).

Defined cases: a null text is an empty one, and empty texts and texts that hold a
sentinel stay plain; a null ``doc_id`` is hashed as the empty string; rows equal in
id are cut alike; a text of white space is one unit; an empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

STEP_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
PREFIX, SUFFIX, MIDDLE = (np.frombuffer(s, np.uint8) for s in (b"<P>", b"<S>", b"<M>"))
MARK = 3  # bytes of a sentinel
PLAIN, PSM, SPM = "plain", "psm", "spm"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Seed of the draws, percentage of texts that are transformed and, of these, of the ``spm`` form."""

    seed: int = 42
    transformed: int = 50
    spm: int = 80


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers from the hash of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def moved(data: np.ndarray, at: np.ndarray, change: np.ndarray, out: np.ndarray, back: bool = False) -> None:
    """Scatter ``data`` into ``out`` (``back``: gather it from there).

    From byte ``at[k]`` on (ascending) every byte lies ``change[k]`` further than
    the bytes before.
    """
    carry = 0
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(data))
        x, y = np.searchsorted(at, (a, b))
        shift = np.zeros(b - a, np.int64)
        np.add.at(shift, at[x:y] - a, change[x:y])
        shift[0] += carry
        shift = np.cumsum(shift, out=shift)
        carry = int(shift[-1])
        shift += np.arange(a, b)
        if back:
            data[a:b] = out[shift]
        else:
            out[shift] = data[a:b]


def shifts(start: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, end: np.ndarray, out: np.ndarray, psm: np.ndarray, spm: np.ndarray):
    """Where each text's parts begin (ascending) and how much further than the bytes before each goes."""
    p, m, s = cut1 - start, cut2 - cut1, end - cut2
    to = np.stack((out, out, out))  # places of prefix, middle and suffix in the output
    to[1], to[2] = out + p, out + p + m
    for form, first, second, third in ((psm, (0, p), (2, s), (1, m)), (spm, (2, s), (0, p), (1, m))):
        at = out + MARK
        for part, size in (first, second, third):
            to[part] = np.where(form, at, to[part])
            at = at + size + MARK
    at = np.stack((start, cut1, cut2)).T.ravel()
    shift = (to - np.stack((start, cut1, cut2))).T.ravel()
    change = np.diff(np.concatenate(([0], shift)))
    return at, change


def sentinels(data: np.ndarray) -> np.ndarray:
    """Positions of all sentinels."""
    if len(data) < MARK:
        return np.empty(0, np.int64)
    at = np.flatnonzero(data[:-2] == PREFIX[0])
    letter = data[at + 1]
    return at[(data[at + 2] == PREFIX[2]) & ((letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1]))]


def transformed(ids: list[int | None], texts: list[bytes], rates: Rates) -> list[pa.Array]:
    """The result columns of some texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(sizes)
    start = end - sizes
    # units end where a word does, and with their text
    word = ~SPACE[data]
    unit = word.copy()
    unit[:-1] &= ~word[1:]
    unit[end[sizes > 0] - 1] = True
    last = np.flatnonzero(unit)  # last byte of every unit
    # a word that goes on into the next text ends at the text's last byte, which is set above
    low = np.searchsorted(last, start)
    n = np.searchsorted(last, end) - low
    drawn = np.array([draws(i, rates.seed) for i in ids], np.int64).reshape(-1, 4)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    bounds = np.concatenate((last, [len(data)]))  # one more, never read for its value

    def cut(units: np.ndarray) -> np.ndarray:
        return np.where(units > 0, bounds[np.maximum(low + units - 1, 0)] + 1, start)

    cut1, cut2 = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    marked = np.zeros(len(texts), bool)
    found = sentinels(data)
    owner = np.searchsorted(end, found, side="right")
    marked[owner[found + MARK <= end[owner]]] = True
    plain = (sizes == 0) | marked | (drawn[:, 2] % 100 >= rates.transformed)
    spm = ~plain & (drawn[:, 3] % 100 < rates.spm)
    psm = ~plain & ~spm

    out_sizes = sizes + np.where(plain, 0, 3 * MARK)
    out_end = np.cumsum(out_sizes)
    out_start = out_end - out_sizes
    out = np.empty(int(out_end[-1]) if len(out_end) else 0, np.uint8)
    moved(data, *shifts(start, cut1, cut2, end, out_start, psm, spm), out)
    p, m, s = cut1 - start, cut2 - cut1, end - cut2
    for form, first, a, second, b in ((psm, PREFIX, p, SUFFIX, s), (spm, SUFFIX, s, PREFIX, p)):
        at = out_start[form]
        for mark, size in ((first, a), (second, b), (MIDDLE, m)):
            out[at[:, None] + np.arange(MARK)] = mark
            at = at + MARK + size[form]

    # code points of the parts: their bytes less those that continue a character
    at = np.stack((start, cut1, cut2)).T.ravel()
    inside, more = at < len(data), np.zeros(len(at), np.int64)
    if inside.any():
        more[inside] = np.add.reduceat((data & 0xC0) == 0x80, at[inside], dtype=np.int64)
    more[np.diff(at, append=len(data)) == 0] = 0
    points = np.stack((p, m, s)).T - more.reshape(-1, 3)
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    return [
        pa.array(n),
        pa.array(form.tolist(), pa.string()),
        pa.array(points[:, 0], mask=plain),
        pa.array(points[:, 1], mask=plain),
        strings(out, out_end),
    ]


def strings(data: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts that end at ``end`` in UTF-8 bytes ``data``, without a copy of each."""
    offsets = np.concatenate(([0], end)).astype(np.int32)
    return pa.StringArray.from_buffers(len(end), pa.py_buffer(offsets), pa.py_buffer(data))


def restored(forms: list[str], outputs: list[bytes]) -> pa.Array:
    """The texts, from outputs and forms alone."""
    sizes = np.fromiter(map(len, outputs), np.int64, len(outputs))
    out = np.frombuffer(b"".join(outputs), np.uint8)
    out_end = np.cumsum(sizes)
    out_start = out_end - sizes
    psm, spm = (np.array([f == name for f in forms], bool) for name in (PSM, SPM))
    mixed = psm | spm
    found = sentinels(out)
    owner = np.searchsorted(out_end, found, side="right")
    inside = mixed[owner] & (found + MARK <= out_end[owner])
    found = found[inside]
    if (np.bincount(owner[inside], minlength=len(outputs))[mixed] != 3).any():
        raise ValueError("an output in psm or spm form holds three sentinels")
    marks = np.zeros((len(outputs), 3), np.int64)
    marks[mixed] = found.reshape(-1, 3)
    first, second = marks[:, 1] - marks[:, 0] - MARK, marks[:, 2] - marks[:, 1] - MARK
    m = np.where(mixed, out_end - marks[:, 2] - MARK, 0)
    p = np.where(psm, first, np.where(spm, second, sizes))
    s = np.where(psm, second, np.where(spm, first, 0))
    end = np.cumsum(p + m + s)
    start = end - p - m - s
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    moved(data, *shifts(start, start + p, start + p + m, end, out_start, psm, spm), out, back=True)
    return strings(data, end)


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches cut to about ``STEP_BYTES`` of text (column number ``text``) each, with their texts; null: empty."""
    for batch in common.slices(batches):
        texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        first, held = 0, 0
        for k, x in enumerate(texts):
            held += len(x)
            if held >= STEP_BYTES or k == len(texts) - 1:
                yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                first, held = k + 1, 0


def transform(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``n`` units; part lengths in code points, null if plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            columns = transformed(batch.column(0).to_pylist(), texts, rates)
            yield common.batch_of(SCHEMA, [batch.column(0), *columns])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, DDL)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs``, all columns, with ``restored`` last: the texts, from ``form`` and ``output`` alone (null: an empty text)."""
    form, output = common.position(outputs, "form"), common.position(outputs, "output")
    rows = common.plain(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, output):
            text = restored(batch.column(form).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "_restored"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_restored", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(*outputs.columns, "restored")


def infill(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """The contract's digest: cuts, form and the hashes of the output and of the text restored from it."""
    done = restore(transform(docs, rates))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
