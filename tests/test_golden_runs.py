"""Golden cases for run assembly (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from regulon.functions import parsing as P
from regulon.functions import prompts as PR
from regulon.operators import runs as R
from regulon.sources import readers as RD
from regulon.sources import sinks as SK


def test_enum_run(spark):
    rows = [("A_B", s, "Up") for s in (42, 43, 44)] + [("C_D", s, "NoEffect") for s in (42, 43, 44)]
    long = spark.createDataFrame(rows, "id string, seed int, effect string")
    pred = P.label_to_pred(P.enum_label(F.col("effect")))
    long = long.select("id", "seed", "effect", pred["prediction_up"].alias("prediction_up"),
                       pred["prediction_down"].alias("prediction_down"))
    test = spark.createDataFrame([("A_B",), ("C_D",), ("E_F",)], "id string")
    got = {r["id"]: r for r in R.assemble_enum(test, long, "m").collect()}
    assert (got["A_B"]["prediction_up"], got["A_B"]["prediction_down"]) == (1.0, 0.0)
    assert (got["C_D"]["prediction_up"], got["C_D"]["prediction_down"]) == (0.0, 0.0)
    assert got["E_F"]["effect_seed42"] == "unknown" and got["E_F"]["prediction_up"] == 0.333


def test_minimal_submission_roundtrip(spark, tmp_path):
    sub = spark.createDataFrame([("A_B", 0.8, 0.1), ("C_D", 0.1, 0.7)], "id string, prediction_up double, prediction_down double")
    path = str(tmp_path / "sub")
    SK.write_submission(sub, path, single_file=True)
    back = spark.read.schema(sub.schema).option("header", True).csv(path)
    assert back.columns == ["id", "prediction_up", "prediction_down"]
    assert sorted(map(tuple, back.collect())) == [("A_B", 0.8, 0.1), ("C_D", 0.1, 0.7)]


def test_prompts_from_two_row_csv(spark, tmp_path):
    p = tmp_path / "test.csv"
    p.write_text("id,pert,gene,label\nA_B,A,B,up\nC_D,C,D,none\n")
    pairs = RD.read_pairs(spark, str(p))
    out = pairs.select("id", PR.zero_shot_prompt(F.col("pert"), F.col("gene")).alias("prompt")).collect()
    assert len(out) == 2 and all(r["prompt"].endswith("Answer:") for r in out)


def test_seed_mean_missing_seed_default(spark):
    long = spark.createDataFrame([("x", 42, 1.0, 0.0), ("x", 43, 1.0, 0.0)],
                                 "id string, seed int, prediction_up double, prediction_down double")
    r = R.seed_ensemble(long, keys=["id"]).first()
    assert r["prediction_up"] == (1.0 + 1.0 + 0.333) / 3.0 and r["prediction_down"] == (0.0 + 0.0 + 0.333) / 3.0
