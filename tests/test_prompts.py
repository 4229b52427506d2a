"""Prompt templates: golden content, braces, placeholder checks."""

import pytest
from pyspark.sql import functions as F

from regulon.functions import prompts as PR


def test_zero_and_few_shot_contain_names(spark):
    df = spark.createDataFrame([("Aars", "Actb")], "pert string, gene string")
    ex = spark.createDataFrame([(1, "X", "Y", "none")], "ord int, pert string, gene string, label string")
    z = df.select(PR.zero_shot_prompt(F.col("pert"), F.col("gene"))).first()[0]
    f = df.select(PR.few_shot_prompt(F.col("pert"), F.col("gene"), PR.examples_block(ex))).first()[0]
    assert "Aars" in z and "Actb" in z and z == PR.PROMPT_ZERO.format(pert="Aars", gene="Actb", cell_desc=PR.CELL_DESC)
    assert "- Perturbed gene: X" in f and "- Gene of interest: Y" in f and PR.ANSWERS["none"] in f


def test_empty_examples_give_empty_block(spark):
    df = spark.createDataFrame([("P", "G")], "pert string, gene string")
    ex = spark.createDataFrame([], "ord int, pert string, gene string, label string")
    f = df.select(PR.few_shot_prompt(F.col("pert"), F.col("gene"), PR.examples_block(ex))).first()[0]
    assert f == PR.PROMPT_FEWSHOT.format(pert="P", gene="G", cell_desc=PR.CELL_DESC, examples_block="")


def test_template_braces_are_literal_and_values_not_reexpanded(spark):
    tpl = "K {pert} of {gene} {{x}} {cell_desc}"
    df = spark.createDataFrame([("{gene}", "G")], "pert string, gene string")
    got = df.select(PR.compile_template(tpl, {"pert": F.col("pert"), "gene": F.col("gene"), "cell_desc": F.lit("c")})).first()[0]
    assert got == "K {gene} of G {x} c"


def test_template_checks():
    with pytest.raises(ValueError, match="unknown placeholder"):
        PR.parse_template("{pert} {gene} {other}")
    with pytest.raises(ValueError, match="must contain placeholder"):
        PR.parse_template("{pert} only")


def test_answer_tag_and_tokens(spark):
    df = spark.createDataFrame([("question  \n ",)], "p string")
    r = df.select(PR.append_answer_tag(F.col("p")).alias("t")).select("t", PR.prompt_tokens(F.col("t"))).first()
    assert r[0] == "question" + PR.ANSWER_TAG_SUFFIX and r[1] == len(r[0]) // 4


def test_chat_unknown_label(spark):
    df = spark.createDataFrame([("P", "G", "weird"), ("P", "G", "up")], "pert string, gene string, label string")
    m = [r[0] for r in df.select(PR.chat_messages(F.col("pert"), F.col("gene"), F.col("label"))).collect()]
    assert m[0][2]["content"] == "<answer>C</answer>\nLabel: weird"
    assert m[1][2]["content"] == "<answer>A</answer>\nA) Knockdown of P results in up-regulation of G."


def test_row_id_roundtrip(spark):
    df = spark.createDataFrame([("Aars", "Actb_2")], "pert string, gene string")
    rid = df.select(PR.row_id(F.col("pert"), F.col("gene")).alias("id"))
    p, g = PR.split_row_id(F.col("id"))
    assert tuple(rid.select(p, g).first()) == ("Aars", "Actb_2")
