"""Vector codes against a full search with Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from regulon.llm import laesa
from regulon.llm.laesa import Shape

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
)


def plainly(rows, shape):
    """(codes and errors by row, codebooks) by full search. ``rows``: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[math.floor(shape.scale * x) for x in np.float32(r[1]).astype(float)] for r in kept]
    bounds = laesa.part_bounds(len(ints[0]), shape.parts)
    seeds = {}
    for r, v in zip(kept, ints):
        seeds.setdefault(r[0], v)
    books = [[v[a:b] for v in list(seeds.values())[: shape.entries]] for a, b in bounds]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(shape.rounds):
        for p, (a, b) in enumerate(bounds):
            members = {}
            for v in ints:
                members.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out = []
    for r, v in zip(kept, ints):
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(bounds)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted([(i, c, e, total[label]) for i, label, c, e in out], key=str), digest


def compare(spark, rows, shape, columns=VECTORS):
    df = spark.createDataFrame([(*r, *[7] * (len(columns) - 3)) for r in rows], columns).repartition(4)
    got = laesa.vector_codes(df, shape).collect()
    want, digest = plainly(rows, shape)
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got], key=str) == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, width))
    values = (centres[rng.integers(0, 5, n)] + rng.normal(0, 0.1, (n, width))).astype(np.float32)
    labels = [None if k == 0 else int(k) for k in rng.integers(0, 4, n)]
    return [(int(i), v.tolist(), label) for i, v, label in zip(rng.permutation(n) * 3 - n, values, labels)]


def test_like_a_full_search(spark):
    compare(spark, vectors(700, 32, 1), Shape())


def test_ties_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 16)], int(i) % 3 or None) for i in rng.integers(0, 60, 250)]  # many equal distances
    rows += rows[:40]
    rows += [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] + [0.0] * 15, 1), (1003, [float("inf")] * 16, 2),
             (None, [0.25] * 16, None), (1004, [0.5] * 7, 1), (1005, [], 1)]
    extra = T.StructType([*VECTORS.fields, T.StructField("VEC_ID", T.IntegerType()), T.StructField("near", T.IntegerType()), T.StructField("_label", T.IntegerType())])
    compare(spark, rows, Shape(scale=2, rounds=3), extra)


def test_few_ids_odd_lengths_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(laesa, "HOT", 3)  # labels of over a third of the rows go one way, the others the other
    compare(spark, vectors(90, 13, 2), Shape(rounds=2))
    compare(spark, vectors(5, 5, 3), Shape(rounds=2))
    compare(spark, [(None, [1.0, 2.0], None)] * 3, Shape(parts=2, rounds=1))


def test_empty_table_and_large_components(spark):
    assert laesa.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        laesa.vector_codes(spark.createDataFrame([(1, [1e9] * 8, 1)], VECTORS)).count()


@pytest.mark.parametrize("seed", range(20))
def test_bounds_rule_out_no_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    size = 3 if seed % 2 else 5000
    x, entries = (rng.integers(-size, size, (n, 6)) for n in (300, 16))
    pivots = laesa.choose_pivots(entries, 4)
    entries = entries + rng.integers(-1, 2, entries.shape)
    code, square, evaluated = laesa.assign(x, laesa.distances(x, pivots), entries, laesa.distances(entries, pivots))
    full = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (code == full.argmin(1)).all() and (square == full.min(1)).all()
    assert evaluated <= full.size


def test_pivots_save_evaluations():
    rng = np.random.default_rng(9)
    centres = rng.integers(-40_000, 40_000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-500, 500, (5000, 8))
    pivots = laesa.choose_pivots(centres, 4)
    _, _, evaluated = laesa.assign(x, laesa.distances(x, pivots), centres, laesa.distances(centres, pivots))
    assert evaluated < 1.5 * len(x)
