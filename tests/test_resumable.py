"""Scoring that survives a stop: every row stored once, finished calls never repeated."""

from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from regulon.operators import runs as R
from regulon.session import scratch_path
from regulon.streaming import scoring
from regulon.streaming.scoring import ScoringRun


def logging_scorer(folder, stop_at=None, fail_at=None):
    """Writes a file a call; stops the run at one prompt, fails for good at another."""
    def score(prompt, seed):
        import os
        import uuid

        if prompt == stop_at:
            raise R.StopScoring("gone")
        with open(os.path.join(folder, f"{prompt}-{seed}-{uuid.uuid4().hex}"), "w"):
            pass
        if prompt == fail_at:
            raise RuntimeError("no answer")
        return f"{prompt}:{seed}"

    return score


def calls(folder):
    return Counter(tuple(p.name.split("-")[:2]) for p in folder.iterdir())


def pending(spark, first, last):
    return spark.createDataFrame([(f"id{i}", 42, f"p{i}") for i in range(first, last)], "id string, seed int, prompt string")


OPTIONS = {"max_retries": 1, "backoff": lambda a: 0.0}


def test_a_stopped_run_goes_on_where_it_stopped(spark, tmp_path):
    run = ScoringRun(spark, scratch_path(spark, "test-scoring"))
    assert run.stored() is None
    run.deliver(pending(spark, 0, 60).coalesce(1), rows_per_file=5)  # 12 files
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    with pytest.raises(StreamingQueryException):
        run.score(logging_scorer(str(first), stop_at="p33"), files_per_batch=2, **OPTIONS)
    early = run.stored()
    kept = {r["id"] for r in early.collect()} if early else set()
    assert "id33" not in kept
    run.score(logging_scorer(str(second), fail_at="p7"), files_per_batch=2, **OPTIONS)
    rows = run.stored().collect()
    assert Counter(r["id"] for r in rows) == Counter(f"id{i}" for i in range(60))
    assert {r["id"]: r["text"] for r in rows if r["status"] == "ok"} == {f"id{i}": f"p{i}:42" for i in range(60) if i != 7 or "id7" in kept}
    # calls of stored batches are not made again; of the batch that stopped, at most its own rows are
    assert not {f"id{p[1:]}" for p, _ in calls(second)} & kept
    repeated = set(calls(first)) & set(calls(second))
    assert len(repeated) < 10
    assert set(calls(first)) | set(calls(second)) == {(f"p{i}", "42") for i in range(60)}


def test_later_deliveries_and_failed_rows(spark, tmp_path):
    run = ScoringRun(spark, scratch_path(spark, "test-scoring"))
    run.deliver(pending(spark, 0, 10))
    run.score(logging_scorer(str(tmp_path), fail_at="p3"), **OPTIONS)
    run.score(logging_scorer(str(tmp_path)), **OPTIONS)  # nothing new: no calls
    assert calls(tmp_path) == Counter({(f"p{i}", "42"): 2 if i == 3 else 1 for i in range(10)})
    ok = run.stored().where("status = 'ok'")
    todo = R.pending_work(pending(spark, 0, 14), ok)  # the failed row and four new ones
    run.deliver(todo)
    run.score(logging_scorer(str(tmp_path)), **OPTIONS)
    rows = run.stored().where("status = 'ok'").collect()
    assert sorted(r["id"] for r in rows) == sorted(f"id{i}" for i in range(14))
    assert sum(calls(tmp_path).values()) == 11 + 5


def test_a_batch_without_its_mark_does_not_show(spark):
    run = ScoringRun(spark, scratch_path(spark, "test-scoring"))
    run.deliver(pending(spark, 0, 4))
    run.score(R.stub_scorer, **OPTIONS)
    spark.createDataFrame([("idx", 42, "px", "t", "ok", 1)], "id string, seed int, prompt string, text string, status string, attempts int").write.parquet(
        f"{run.rows}/batch=99")  # as if the job had died after its write
    assert {r["id"] for r in run.stored().collect()} == {f"id{i}" for i in range(4)}


def test_odd_column_names_pass_through(spark):
    df = spark.createDataFrame([("a", 42, "p", 1)], "id string, seed int, prompt string, `odd: name, <x>` int")
    assert R.batch_complete(df, R.stub_scorer).columns == ["id", "seed", "prompt", "odd: name, <x>", "text", "status", "attempts"]
    assert R.batch_complete(df, R.stub_scorer).first()["odd: name, <x>"] == 1


def test_batches_grow_with_the_work(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FILES_PER_BATCH", 1)
    monkeypatch.setattr(scoring, "MAX_BATCHES", 3)
    run = ScoringRun(spark, scratch_path(spark, "test-scoring"))
    run.deliver(pending(spark, 0, 10).coalesce(1), rows_per_file=1)  # 10 files
    run.score(lambda prompt, seed: f"{prompt}:{seed}", **OPTIONS)
    assert run.finished().count() == 3
    assert sorted(r["text"] for r in run.stored().collect()) == sorted(f"p{i}:42" for i in range(10))
