"""Driver contract: entry, registry, and a sample of queries on sf0.001."""

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["de_auroc", "dir_auroc", "score"] and len(rows) == 1


def test_every_query_has_oracle():
    mine = {n for n in E.queries() if n != "pipeline" and not n.startswith("op")}
    assert mine and mine <= set(E.oracle_sql()) <= set(E.queries())


def test_queries_without_the_training_data_package(monkeypatch):
    monkeypatch.setattr(E, "HAS_LLM", False)
    monkeypatch.setattr(E, "HAS_PIPELINE", False)
    assert set(E.queries()) == set(E.oracle_sql())


def test_sample_queries_run(spark):
    qs = E.queries()
    for name in ("negative_pairs", "top_genes_per_cell", "pert_evidence", "submission_track_b", "stream_progress"):
        assert qs[name](spark, SF_SMALL).count() >= 0


def test_readme_usage_flow(spark, tmp_path):
    from pyspark.sql import functions as F

    from regulon.functions import parsing, prompts
    from regulon.operators import runs, scoring
    from regulon.plans import standins as S
    from regulon.sources import readers

    pairs = S.pairs(spark, SF_SMALL).select("id", "pert", "gene", "label")
    pairs.drop("label").write.option("header", True).csv(str(tmp_path / "test.csv"))
    solution = pairs.select("id", "label")

    test = readers.read_pairs(spark, str(tmp_path / "test.csv"), labelled=False)
    todo = runs.expand_seeds(test).withColumn(
        "prompt", prompts.append_answer_tag(prompts.zero_shot_prompt(F.col("pert"), F.col("gene"))))
    done = runs.batch_complete(todo, runs.stub_scorer)
    parsed = parsing.parse_answers(done.withColumn("source", parsing.answer_source(F.col("text"))), "source")
    submission = runs.seed_ensemble(parsed, keys=["id"])
    merged = scoring.check_submission(solution, submission)
    row = scoring.de_dir_score(merged).first()
    assert 0.0 <= row["score"] <= 1.0 and row["de_auroc"] is not None
