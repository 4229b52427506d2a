"""Fill-in-middle against a plain version, text by text."""

import hashlib
import random
import re

import pytest
from llm_cases import docs, edge, empty

from regulon.llm import common, infill
from regulon.llm.infill import Rates

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plainly(doc_id, text, rates=Rates()):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rates.transformed:
        return n, "plain", None, None, text
    if h[3] % 100 < rates.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(seed, n=1500):
    rng = random.Random(seed)
    bits = ["word", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "\x85", "\xa0", "<", "<P", "S>", "M>", ">", "<P>", "x"]
    weights = [6, 6, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 0.1, 3]
    return ["".join(rng.choices(bits, weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk, rates", [(1 << 20, Rates()), (7, Rates(transformed=100)), (1, Rates(seed=3, transformed=100, spm=0)), (64, Rates(transformed=100, spm=100))])
def test_like_the_plain_version(monkeypatch, chunk, rates):
    monkeypatch.setattr(infill, "CHUNK_BYTES", chunk)
    texts = random_texts(chunk, 300 if chunk < 64 else 1500)
    ids = list(range(len(texts)))
    raw = [t.encode() for t in texts]
    got = list(zip(*(c.to_pylist() for c in infill.transformed(ids, raw, rates))))
    want = [plainly(i, t, rates) for i, t in enumerate(texts)]
    assert got == want
    assert len({x[1] for x in got}) > 1 or rates.spm in (0, 100)
    back = infill.restored([x[1] for x in got], [x[4].encode() for x in got])
    assert back.to_pylist() == texts


def test_marks_over_the_border_of_two_texts_are_none():
    # outputs that end in "<" or "<P" before texts that start with the rest
    forms, outputs = ["spm", "plain", "plain", "psm"], [b"<S><P>a<M>x <", b"P> b", b"c <P", b"<P>d<S><M>"]
    assert infill.restored(forms, outputs).to_pylist() == ["ax <", "P> b", "c <P", "d"]
    with pytest.raises(ValueError):
        infill.restored(["psm"], [b"<P>a<S>b"])


def test_edge_rows(spark):
    df = edge(spark)
    rows = infill.restore(infill.transform(df)).collect()
    source = {}
    for r in common.pick(df, doc_id="long", text="string").collect():
        source.setdefault(r[0], []).append(r[1])
    assert len(rows) == sum(map(len, source.values()))
    for r in rows:
        wanted = [plainly(r["doc_id"], t) for t in source[r["doc_id"]]]
        got = (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
        assert got in wanted
        assert r["restored"] in [t or "" for t in source[r["doc_id"]]]
    assert infill.infill(empty(spark)).count() == 0


def test_digest_and_steps(spark, monkeypatch):
    texts = [*random_texts(5, 200), "long " * 30_000]
    rows = infill.infill(docs(spark, texts)).collect()
    for r in rows:
        n, form, p, m, out = plainly(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_restore_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("psm", "<P>a<S> c<M> b", 1, 2), (None, None, 3, 4)], "form string, output string, restored int, FORM int")
    got = [tuple(r) for r in infill.restore(df).collect()]
    assert got == [("psm", "<P>a<S> c<M> b", 1, 2, "a b c"), (None, None, 3, 4, "")]
