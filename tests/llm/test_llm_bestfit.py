"""Best-fit packing: the plan against best fit one piece at a time, the pieces against the library's ids."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from llm_cases import docs, edge, empty

from regulon.llm import bestfit, common, tokens


def spread(runs, length):
    """Sequences as lists of (offset, size) from the runs; every piece once."""
    out, seen = {}, Counter()
    for r in runs:
        assert r.rank == seen[r.size]  # ranks without gaps
        seen[r.size] += r.count
        for k in range(r.count):
            out.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.size, r.size))
    for pieces in out.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return out, seen


def one_by_one(histogram, length):
    """Number of sequences by matching and best fit, piece by piece."""
    items = sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True)
    big = [s for s in items if 3 * s > length]
    gaps = []
    while big:
        s = big.pop(0)
        fits = [k for k, t in enumerate(big) if s + t <= length and s < length]
        gaps.append(length - s - (big.pop(fits[0]) if fits else 0))
    for s in (s for s in items if 3 * s <= length):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(length - s)
    return Counter(gaps)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 2, 3, 7, 12, 30, 64])
    histogram = {s: rng.choice([0, 1, 2, 3, 9, 40]) for s in range(1, length + 1) if rng.random() < 0.7}
    runs = bestfit.plan(histogram, length)
    got, seen = spread(runs, length)
    assert seen == Counter({s: n for s, n in histogram.items() if n})
    assert sorted(got) == list(range(len(got)))
    gaps = Counter(length - sum(s for _, s in x) for x in got.values())
    assert gaps == one_by_one(histogram, length)
    assert all(sum(3 * s > length for _, s in x) <= 2 for x in got.values())


@pytest.mark.parametrize("seed", range(40))
def test_as_many_pairs_as_can_be(seed):
    rng = random.Random(seed)
    length = 20
    sizes = [rng.randint(7, 20) for _ in range(rng.randint(0, 9))]

    def best(rest):
        if not rest:
            return 0
        s, *rest = rest
        return max([best(rest)] + [1 + best(rest[:k] + rest[k + 1 :]) for k, t in enumerate(rest) if s + t <= length])

    got, _ = spread(bestfit.plan(Counter(sizes), length), length)
    assert len(got) == len(sizes) - best(sizes)


def test_plan_size_does_not_grow_with_the_data():
    rng = random.Random(1)
    histogram = {s: rng.randint(0, 50) for s in range(1, 1025)}
    few = len(bestfit.plan(histogram, 1024))
    many = bestfit.plan({s: n * 10**9 + rng.randint(0, 10**6) for s, n in histogram.items()}, 1024)
    assert len(many) < 60_000 and few < 60_000
    total = sum(s * n for s, n in histogram.items()) * 10**9
    used = max(r.sequence + -(-r.count // r.each) for r in many)
    assert used * 1024 < 1.05 * total  # the counts of sizes that would complement each other differ at random


def checked(df, rows, length, name="byte_bpe_50k.json", end=2):
    """Rows of ``pack`` with ids against whole-text encoding by a fresh tokenizer."""
    fresh = tokenizers.Tokenizer.from_file(tokens.vocabulary(name))
    want = Counter()
    for r in common.pick(df, doc_id="long", text="string").collect():
        ids = np.array([*fresh.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4").tobytes()
        first = (len(ids) // 4 - 1) % length + 1
        cuts = [0, *range(first, len(ids) // 4 + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, ids[4 * a : 4 * b]] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    by_sequence = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by_sequence.values():
        at = 0
        for offset, size, _ in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return {k: b"".join(x[2] for x in sorted(v)) for k, v in by_sequence.items()}


@pytest.mark.parametrize("length", [1024, 16])
def test_packing_of_edge_rows(spark, length):
    df = edge(spark)
    packed = bestfit.pack(df, length=length)
    want = checked(df, packed.collect(), length)
    got = {r["sequence_id"]: (r["n_tokens"], bytes(r["ids"])) for r in bestfit.sequences(packed).collect()}
    assert got == {k: (len(x) // 4, x) for k, x in want.items()}


def test_many_documents_over_many_partitions(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["one", "two", "of", "the"], k=rng.choice([0, 1, 1, 1, 5, 20, 100, 700]))) for _ in range(600)]
    df = docs(spark, texts).repartition(9)
    rows = bestfit.pack(df, length=128).collect()
    used = checked(df, rows, 128)
    total = sum(r["length"] for r in rows)
    assert len(used) <= -(-total // 128) * 1.02 + 1
    digest = bestfit.pieces(df, length=128)
    assert digest.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert digest.count() == len(rows)


def test_empty_table(spark):
    assert bestfit.pieces(empty(spark)).count() == 0
