"""Golden cases for response parsing (docstring examples and reading of the reference)."""

from functools import reduce
from operator import and_

import pytest
from pyspark.sql import functions as F

from regulon.functions import parsing as P
from regulon.functions import traces as T

CASES = [
    ("A) Knockdown of X results in up-regulation of Y.", (1.0, 0.0)),
    ("B) down-regulation", (0.0, 1.0)),
    ("C) does not significantly affect", (0.0, 0.0)),
    ("I don't know", (0.333, 0.333)),
    ("", (0.333, 0.333)),
    ("   \n ", (0.333, 0.333)),
    (None, (0.333, 0.333)),
    ("The gene does not significantly increase.\nAnswer: b", (0.0, 1.0)),
    ("A) yes\nAnswer:", (1.0, 0.0)),
    ("does not significantly increase", (0.333, 0.333)),
    ("No.", (0.0, 0.0)),
    ("Final Answer: B", (0.0, 1.0)),
    ("**C)** unchanged", (0.0, 0.0)),
    ("éA) accent before the letter", (0.333, 0.333)),
]


def test_parse_answer_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: (r["prediction_up"], r["prediction_down"]) for r in P.parse_answers(df, "t").collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, CASES[i][0]


def test_column_form_equals_batch_form(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    a = df.select(P.parse_answer(F.col("t")).alias("p")).select("p.*").collect()
    b = P.parse_answers(df, "t").select("prediction_up", "prediction_down").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_answer_tag(spark):
    df = spark.createDataFrame([("x <answer> c </answer>",), ("<ANSWER>A</ANSWER>",), ("<answer>b</answer> <answer>A</answer>",)], "t string")
    assert [r[0] for r in df.select(P.answer_tag(F.col("t"))).collect()] == ["C", None, "B"]


def test_answer_source_prefers_valid_submission(spark):
    df = spark.createDataFrame([("A", "<answer>B</answer>"), ("X", "<answer>B</answer>"), (None, "free text")], "s string, t string")
    got = [r[0] for r in df.select(P.answer_source(F.col("t"), F.col("s"))).collect()]
    assert got == ["A", "B", "free text"]


def test_argmax_ties(spark):
    df = spark.createDataFrame([(0.333, 0.333), (0.5, 0.5), (0.0, 1.0), (0.2, 0.1)], "u double, d double")
    got = [r[0] for r in df.select(P.argmax_label(F.col("u"), F.col("d"))).collect()]
    assert got == ["none", "up", "down", "none"]


def test_enum_labels(spark):
    df = spark.createDataFrame([("Up",), ("NoEffect",), ("Down",), ("weird",)], "e string")
    got = df.select(P.label_to_pred(P.enum_label(F.col("e"))).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.333, 0.333)]


def test_submitted_answer_step_order(spark):
    traj = {"tool_name_9": "submit_answer", "tool_args_9": '{"answer": " b "}',
            "tool_name_10": "submit_answer", "tool_args_10": '{"answer": "c"}', "tool_name_1": "lookup_gene"}
    df = spark.createDataFrame([(traj,)], "t map<string,string>")
    r = df.select(T.submitted_answer(F.col("t")).alias("n"), T.submitted_answer(F.col("t"), lexical=True).alias("l"),
                  T.tool_calls(F.col("t")).alias("c"), T.distinct_tools(F.col("t")).alias("d")).first()
    assert (r["n"], r["l"], r["c"], r["d"]) == ("C", "B", 3, 2)


def test_stringify_trajectory(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("not json",)], "s string")
    got = [r[0] for r in df.select(T.stringify_trajectory(F.col("s"))).collect()]
    assert got[0] == {"a": "1", "b": "x"} and got[1] == {"raw": "not json"}


def test_whitespace_inside_a_class_is_bare():
    from regulon.functions.text import WS_INNER, portable

    assert portable(r"[\.\s]*$") == rf"[\.{WS_INNER}]*$" and "[[" not in portable(r"[\s,]")


def test_patterns_equal_plain_re(spark):
    """Flags, answer portion and tag of generated texts against Python's own ``re``."""
    import random
    import re

    from pyspark.sql import functions as F

    from regulon.functions import parsing as P

    bits = ["A", "B", "C", "a)", "B)", "C)", "**A)**", "No", "no", ".", "..", "No.", "Answer:", "Final Answer :", "answer:", "\n", " ", "\t", " ",
            " ", "up-regulat", "UPREGULATED", "increase", "Increase.", "decrease", "does not significantly", "not x result in differential",
            "<answer>", "</answer>", "é", "_", "3", "\x1f", "İ", "ſ", "x"]
    rng = random.Random(8)
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 7))) for _ in range(3000)] + ["", "   \n", "No", "No..", "Final Answer : c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    flags = P.pattern_flags(F.col("t"))
    rows = df.select("i", *[c.alias(k) for k, c in flags.items()], P.answer_portion(F.col("t")).alias("portion"), P.answer_tag(F.col("t")).alias("tag")).collect()
    for r in rows:
        t = texts[r["i"]]
        for name, patterns in (("up", P.PATTERNS_UP), ("down", P.PATTERNS_DOWN), ("none", P.PATTERNS_NONE)):
            assert r[name] == any(re.search(p, t, re.I | re.M) for p in patterns), (name, t)
        cut = re.split(P.ANSWER_SPLIT, t, flags=re.I)
        lines = [x for x in t.split("\n") if x.strip()]
        assert r["portion"] == (cut[-1].strip() if len(cut) > 1 else lines[-1].strip() if lines else t), repr(t)
        tag = re.search(P.ANSWER_TAG, t)
        assert r["tag"] == (tag[1].upper() if tag else None), repr(t)


def test_flags_with_needed_strings_equal_the_whole_regexes(spark):
    """ASCII text is decided that lacks the strings of a class skips its regex, any other text does not: one answer."""
    bits = ["A)", "b)", "**C)**", "x", "_", "9", " ", "\n", "\t", "answer:", "ANSWER: b", "Increase", "İncrease", "ıncrease", "decreaſe", "No.", "no",
            "a", "Not ", "result in differential", "K", "̇"]
    texts = [a + b + c for a in bits for b in bits for c in ("", "\n", "c", ")", ".")] + ["", "not all\nsignificantly affect", "not all significantly affect"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    flags = P.pattern_flags(F.col("t"))
    whole = {k: F.col("t").rlike(P.JAVA_FLAGS_IM + rx) for k, rx in P.CLASS_REGEX.items()}
    assert set(P.NEEDED) == set(whole)
    assert df.where(~reduce(and_, [flags[k].eqNullSafe(whole[k]) for k in whole])).collect() == []


def test_right_strip_and_portion_are_those_of_python(spark):
    from regulon.functions.text import is_blank, rstrip

    texts = ["", " ", "a", "a ", "a\n", "~", "!", "\x7f", "a\x1f", "é", "é\u3000", "\u00a0", "a\u0085", "x\n\n y \n", "y\n\u2003", "answer b", "b Answer : c "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", rstrip(F.col("t")).alias("r"), is_blank(F.col("t")).alias("b"), P.answer_portion(F.col("t")).alias("p")).collect()
    for x in rows:
        lines = [y.strip() for y in x["t"].split("\n") if y.strip()]
        assert (x["r"], x["b"]) == (x["t"].rstrip(), not x["t"].strip())
        assert x["p"] == ("c" if ":" in x["t"] else lines[-1] if lines else x["t"])
