import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import docs, edge, empty

from regulon.llm import common, suffix_index


def brute(rows, window):
    """Removed bytes by document, in the order of (doc_id, text's CRC-32); equal rows are one."""
    keyed = sorted({(i if i is not None else suffix_index.LAST, zlib.crc32((t or "").encode()), t or "") for i, t in rows})
    seen, out = set(), {}
    for d, sub, text in keyed:
        raw = text.encode()
        edge = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - window + 1):
            w = raw[p : p + window]
            if w in seen:
                edge[p] += 1
                edge[p + window] -= 1
            seen.add(w)
        out[d, sub] = np.cumsum(edge)[:-1] > 0
    return out


def corpus(n=250, seed=1):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz éß"
    passages = ["".join(rng.choices(letters, k=k)) for k in (40, 80, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            kind = rng.randrange(6)
            if kind < 2:
                parts.append(rng.choice(passages))
            elif kind == 2:
                parts.append("".join(rng.choices("abc", k=rng.randrange(90))))
            elif kind == 3:
                parts.append("ab" * rng.randrange(120))
            elif kind == 4:
                parts.append("é" * rng.randrange(130))
            else:
                parts.append("".join(rng.choices(letters, k=60)) + passages[-1])
        rows.append((3 * i, "".join(parts) if i % 17 else rows[-1][1] if rows else None))
    return rows


def digest(rows, window):
    gone = brute(rows, window)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mark = gone[i if i is not None else suffix_index.LAST, zlib.crc32(raw)]
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark])
        out.append((i, len(raw), int(mark.sum()), len(common.ranges_of(mark)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,anchor,contexts", [(100, 32, 32), (100, 32, 2), (12, 5, 2)])
def test_against_brute_force(spark, monkeypatch, window, anchor, contexts):
    monkeypatch.setattr(suffix_index, "CONTEXTS", contexts)
    rows = corpus()
    df = docs(spark, rows).repartition(5)
    got = suffix_index.removed_bytes(df, window=window, anchor=anchor, batches=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == digest(rows, window)


def test_small_pieces_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(60, seed=4)
    parts = [rows[::2], rows[1::2]]
    want = None
    for piece, chunk, task in ((1 << 22, 1 << 20, 10**6), (150, 200, 50)):
        for name, value in (("PIECE", piece), ("CHUNK", chunk), ("TASK_ENTRIES", task)):
            monkeypatch.setattr(suffix_index, name, value)
        found = {}
        sent = []
        for part in parts:
            batch = common.batch_of(
                suffix_index.pa.schema([("d", "int64"), ("sub", "int64"), ("text", "string")]),
                [[i for i, _ in part], [zlib.crc32((t or "").encode()) for _, t in part], [t or "" for _, t in part]],
            )
            for out in suffix_index.extract(iter([batch]), 100, 32, 1, 10**6):
                sent += out.to_pylist()
        table = suffix_index.pa.Table.from_pylist(sent, schema=suffix_index.SENT_SCHEMA)
        for r in suffix_index.scan_bucket(table, 100, [60, 120], 10**6, False).to_pylist():
            if r["kind"] == suffix_index.CLAIM:
                found.setdefault((r["d"], r["sub"]), []).append(r["spans"])
        assert found
        want = want or brute(rows, 100)
        for key, spans in found.items():  # runs removed at once are right in either case
            for a, b in suffix_index.merged(spans):
                assert want[key][a:b].all()


def test_levels_merge_geometrically():
    family = suffix_index.Family([])
    for k in range(7):
        rows = np.zeros(4, suffix_index.ENTRY_TYPE)
        rows["h"], rows["d"] = np.arange(4) + 10 * k, k
        family.add(rows)
    assert [(k, len(rows)) for k, rows in family.levels] == [(2, 16), (1, 8), (0, 4)]
    assert all((np.diff(rows["h"].astype(np.int64)) > 0).all() for _, rows in family.levels)


def test_stored_index_takes_batches(spark):
    rows = corpus(120, seed=7)
    batches = [rows[:40], rows[40:80], rows[80:]]
    index = suffix_index.SuffixIndex(spark, suffix_index.common.scratch_path(spark, "index"))
    gone, before = {}, None
    for part in batches:
        df = docs(spark, part)
        for r in index.add(df, before).collect():
            gone[r["d"], r["sub"]] = suffix_index.merged(r["spans"])
        before = df if before is None else before.unionByName(df)
    for key, mark in brute(rows, 100).items():
        assert [tuple(x) for x in common.ranges_of(mark).tolist()] == gone.get(key, [])


def test_cut_keeps_whole_characters(spark):
    a, b = "é" * 49 + "x", "à" + "b" * 30
    rows = [(1, a + b + a + "end"), (2, "start è" + a + "ê" + a), (3, None)]
    gone = brute(rows, 100)
    got = {r["doc_id"]: r["text"] for r in suffix_index.cut(docs(spark, rows)).collect()}
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        mark, at, kept = gone[i, zlib.crc32(t.encode())], 0, ""
        for c in t:
            n = len(c.encode())
            kept += "" if mark[at : at + n].all() else c
            at += n
        assert got[i] == kept


def test_edges(spark):
    df = edge(spark)
    rows = [tuple(r)[:2] for r in df.collect()]
    got = sorted((tuple(r) for r in suffix_index.removed_bytes(df).collect()), key=str)
    assert got == digest(rows, 100)
    cut = suffix_index.cut(df)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert suffix_index.removed_bytes(empty(spark)).count() == 0 and suffix_index.cut(empty(spark)).count() == 0
