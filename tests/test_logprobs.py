"""Log-prob predictions on hand-built token streams."""

import math

import pytest
from pyspark.sql import functions as F

from regulon.functions import completions as C
from regulon.functions import logprobs as L


def softmax3(a, b, c):
    m = max(a, b, c)
    e = [math.exp(x - m) for x in (a, b, c)]
    return e[0] / sum(e), e[1] / sum(e)


def tok(t, top=()):
    return {"token": t, "logprob": -0.1, "top_logprobs": [{"token": x, "logprob": lp} for x, lp in top]}


def run(spark, streams):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(streams)], f"i int, logprobs {L.LOGPROBS}")
    out = L.logprob_predictions(df).orderBy("i").collect()
    col = df.select("i", L.logprob_prediction(F.col("logprobs")).alias("p")).orderBy("i").collect()
    assert [(r["lp_up"], r["lp_down"]) for r in out] == [(r["p"]["lp_up"], r["p"]["lp_down"]) for r in col]
    return [(r["lp_up"], r["lp_down"]) for r in out]


def test_cases(spark):
    streams = [
        [tok("<answer>"), tok("B", [("A", -1.0), (">B", -0.5), (" c", -2.0)]), tok("</answer>")],
        [tok("<ans"), tok("wer>"), tok(""), tok(" A", [("a", -0.2)]), tok("</answer>")],
        [tok("no tag here", [("A", -0.1)])],
        [tok("<answer>"), tok("C", [("x", -0.1)]), tok("</answer>")],
    ]
    got = run(spark, streams)
    assert got[0] == pytest.approx(softmax3(-1.0, -0.5, -2.0), abs=1e-15)
    assert got[1] == pytest.approx(softmax3(-0.2, -20.2, -20.2), abs=1e-15)
    assert got[2] == (None, None) and got[3] == (None, None)


def test_sanitize(spark):
    s = [tok("A", [("A", float("-inf")), ("B", float("nan")), ("C", -1.0)])]
    df = spark.createDataFrame([(s,)], f"logprobs {L.LOGPROBS}")
    top = df.select(L.sanitize_logprobs(F.col("logprobs"))).first()[0][0]["top_logprobs"]
    assert [e["logprob"] for e in top] == [-9999.0, -9999.0, -1.0]


def test_completion_fields_and_think(spark):
    rows = [
        ('{"choices":[{"message":{"content":[{"text":"a"},{"content":"b"}]}}],"usage":{"total_tokens":5}}',),
        ('{"choices":[{"message":{"content":"<think> plan </think>  <answer>B</answer>","reasoning":"  r  "}}]}',),
        ('{"choices":[]}',),
    ]
    df = spark.createDataFrame(rows, "j string").select(C.completion_fields(F.col("j")).alias("f"))
    got = df.select("f.text", "f.total_tokens", C.split_think(F.col("f.content"), F.lit(None).cast("string")).alias("s")).collect()
    assert got[0]["text"] == "a\nb" and got[0]["total_tokens"] == 5.0
    assert got[1]["text"] == "r\n\n<think> plan </think>  <answer>B</answer>"
    assert got[1]["s"]["reasoning_trace"] == "plan" and got[1]["s"]["response_trace"] == "<answer>B</answer>"
    assert got[2]["text"] == "" and got[2]["total_tokens"] == 0.0


def test_separator_index_equals_aggregate_index(spark):
    import random

    rnd = random.Random(11)

    def stream():
        text = rnd.choice(["", "Let me think. ", "é\n", "\u0001x "])
        if rnd.random() < 0.8:
            text += "<answer>" + rnd.choice(["", " ", "\n"]) + rnd.choice("ABCabcx") + rnd.choice(["", " "]) + "</answer>"
        text += rnd.choice(["", " done", "<answer>C</answer>"])
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, rnd.randint(0, 6))))
        parts = [text[a:b] for a, b in zip([0] + cuts, cuts + [len(text)])]
        if rnd.random() < 0.3:
            parts.insert(rnd.randint(0, len(parts)), "")
        return [tok(p) for p in parts]

    streams = [stream() for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(streams)], f"i int, logprobs {L.LOGPROBS}")
    rows = df.select("i", L.answer_token_index_sep(F.col("logprobs")).alias("a"),
                     L.answer_token_index(F.col("logprobs")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert sum(r["a"] is not None for r in rows) > 100


def test_older_reasoning_key_only_where_asked_and_absent(spark):
    rows = ['{"choices":[{"message":{"reasoning_content":"rc","content":"c"}}]}',
            '{"choices":[{"message":{"reasoning":"r","reasoning_content":"rc","content":"c"}}]}',
            '{"choices":[{"message":{"reasoning":null,"reasoning_content":"rc","content":"c"}}]}']
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    plain, old = (df.select(C.completion_fields(F.col("j"), k)["text"]).collect() for k in (False, True))
    assert [r[0] for r in plain] == ["c", "r\n\nc", "c"]
    assert [r[0] for r in old] == ["rc\n\nc", "r\n\nc", "c"]
