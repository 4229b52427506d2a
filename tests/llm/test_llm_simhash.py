import random

import numpy as np
import xxhash
from llm_cases import PASSAGE, docs, edge, empty

from regulon.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best.setdefault(find(i), []).append(d)
    return [min((x for x in best[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(3000)]
    texts = ["", None, " \n", "One", "one", "a b c", "a b c d", PASSAGE]
    for k in range(40):
        words = list(base)
        for _ in range(k // 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(base, k=30)) for _ in range(20)]
    got = {r["doc_id"]: r for r in simhash.simhash_duplicates(docs(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    want = brute_components(list(range(len(texts))), fps)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(set(fps))  # there are near links
    kept = {r["doc_id"] for r in simhash.keep_first(docs(spark, texts)).collect()}
    assert kept == set(want)


def clouds(n=300):
    """Random fingerprints with chains of near ones, zero and both ends of the range."""
    rng = random.Random(9)
    fps = {0, 2**64 - 1, 1 << 63, 15}
    for _ in range(n // 20):
        f = rng.getrandbits(64)
        for _ in range(20):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                f ^= 1 << b
    return sorted(fps)


def test_every_link_is_found_in_small_and_divided_buckets(spark):
    fps = clouds()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(signed, fps)
    for blocks, rows in ((6, 4096), (5, 4096), (6, 2), (8, 3)):
        edges = simhash.candidate_edges(df, 4, blocks, rows)
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        assert [roots.get(f, f) for f in signed] == want, (blocks, rows)


def test_large_bucket_is_walked_without_its_pairs():
    rng = np.random.default_rng(1)
    fps = np.array([int(sum(1 << int(b) for b in rng.choice(12, 3, replace=False))) for _ in range(400)], np.int64)
    edges = simhash.bucket_edges(fps, 4)
    assert len(edges) == len(np.unique(fps)) - 1  # one component: 3 + 3 bits over 12 are linked in steps


def test_one_row_of_each_component_where_ids_repeat(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(80)) for k in "abcd")
    # 5 is the smallest id of a's component and, in b's, a copy of 3; c: rows equal in id and text; d: no id
    rows = [(5, a), (9, a), (3, b), (5, b), (7, c), (7, c), (7, c), (8, c), (7, c.upper()), (None, d), (None, d), (None, a)]
    kept = [(r["doc_id"], r["text"].lower()) for r in simhash.keep_first(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (7, c), (None, d)], key=str)


def test_edges(spark):
    df = edge(spark)
    rows = simhash.simhash_duplicates(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[1] == got[2] == got[3] == 1 and got[6] in (5, 6)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} <= {r["component_id"] for r in rows}
    assert simhash.simhash_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0
