import hashlib
import re

import pytest
from llm_cases import PASSAGE, docs, edge, empty

from regulon.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, k=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        b = words(t)
        n = min(k, len(b))
        for i in range(max(1, len(b) - n + 1) if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, PASSAGE.upper()), (2, "two words"), (2, "é é-é!"), (10, "solo"), (3, None), (None, "tail"), (4, ""), (5, "a b a b a b a b a b a b")]


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_against_brute_force(spark, block_words):
    texts = [
        "x " + PASSAGE.replace(" ", "\n; ") + " y",
        PASSAGE[:200],
        "Two--words, two words two; Solo",
        "a b " * 9,
        "prefixsolo solosuffix two wordsx",
        "É É É é é é ÉÉ",
        None,
        "",
    ]
    df = docs(spark, texts)
    items = [(i, t) for i, t in ITEMS if i is not None and t is not None]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.decontamination(df, bench(spark, ITEMS), block_words=block_words).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in decontam.clean(df, bench(spark, ITEMS), block_words=block_words).collect()}
    assert kept == {i for i, r in got.items() if not r[-1]}


def test_spans_point_into_the_original(spark):
    text = "Ünder: TWO  words — and solo."
    row = decontam.decontaminate(docs(spark, [text]), bench(spark, ITEMS)).first()
    raw = text.encode()
    assert [raw[s["start"] : s["end"]].decode() for s in row["hit_spans"]] == ["TWO  words", "solo"]


def test_edges(spark):
    df, none = edge(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontamination(df, bench(spark, ITEMS)).count() == df.count()
    assert decontam.decontamination(df, none).where("contaminated").count() == 0
    assert decontam.clean(df, none).count() == df.count()
    assert decontam.clean(df, bench(spark, ITEMS)).columns == df.columns
    assert decontam.decontamination(empty(spark), bench(spark, ITEMS)).count() == 0
