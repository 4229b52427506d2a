"""Scoring: golden metric case, AUROC vs brute force, invariance, errors."""

import random
from contextlib import contextmanager

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regulon.operators import scoring as SC
from regulon.operators.ranking import range_parts


def brute_auroc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@contextmanager
def settings_of(spark, **conf):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exact_auroc(rows):
    """U statistic in whole numbers: sort once, ties together."""
    by_score = {}
    for y, s in rows:
        p, n = by_score.get(s, (0, 0))
        by_score[s] = (p + y, n + 1 - y)
    u2 = below = 0
    for s in sorted(by_score):
        p, n = by_score[s]
        u2 += p * (2 * below + n)
        below += n
    pos = sum(p for p, _ in by_score.values())
    return u2 / (2 * pos * below)


def test_metric_golden(spark):
    sol = spark.createDataFrame(
        list(zip(["A_X", "A_Y", "B_X", "B_Y", "C_X", "C_Y"], ["up", "none", "down", "none", "up", "down"], ["Public"] * 6)),
        "id string, label string, usage string")
    sub = spark.createDataFrame(list(zip(["A_X", "A_Y", "B_X", "B_Y", "C_X", "C_Y"],
                                         [0.9, 0.1, 0.1, 0.0, 0.8, 0.1], [0.0, 0.0, 0.8, 0.1, 0.1, 0.9])),
                                "id string, prediction_up double, prediction_down double")
    merged = SC.check_submission(sol, sub)
    assert SC.de_dir_score(merged).first()["score"] == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=60))
def test_auroc_matches_brute_force(spark, rows):
    ys = [y for y, _ in rows]
    if len(set(ys)) < 2:
        return
    ss = [s / 6.0 for _, s in rows]
    df = spark.createDataFrame(list(zip(ys, ss)), "y int, s double")
    got = SC.auroc(df, "y", "s").first()["auroc"]
    assert got == pytest.approx(brute_auroc(ys, ss), abs=1e-12)


def test_auroc_partition_invariance(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(data, "y int, s double")
    a = SC.auroc(df.repartition(1), "y", "s").first()["auroc"]
    b = SC.auroc(df.repartition(13), "y", "s").first()["auroc"]
    with settings_of(spark, **{"spark.sql.shuffle.partitions": "1"}):
        c = SC.auroc(df, "y", "s").first()["auroc"]
    assert a == b == c == pytest.approx(brute_auroc(*zip(*data)), abs=1e-12)


MANY = {"spark.sql.shuffle.partitions": "300", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_auroc_over_hundreds_of_ranges_with_a_hot_key(spark):
    """More range partitions than 256, most rows in one key, half of its rows in one score."""
    rnd = random.Random(4)
    rows = []
    for _ in range(40_000):
        k = "hot" if rnd.random() < 0.9 else f"k{rnd.randrange(50)}"
        s = 0.5 if rnd.random() < 0.5 else rnd.gauss(0.5, 0.001)  # a narrow range of scores
        rows.append((k, int(rnd.random() < s), s))
    df = spark.createDataFrame(rows, "k string, y int, s double")
    with settings_of(spark, **MANY):
        counts = df.groupBy("k", F.col("s").alias("score")).agg(F.count("*").alias("n"))
        sizes = [r["count"] for r in range_parts(counts, ["k", "score"]).groupBy("part").count().collect()]
        assert len(sizes) > 256 and max(sizes) < 8 * sum(sizes) / len(sizes)
        got = {r["k"]: r for r in SC.auroc(df, "y", "s", ["k"]).collect()}
        whole = SC.auroc(df, "y", "s").first()
    by_key = {}
    for k, y, s in rows:
        by_key.setdefault(k, []).append((y, s))
    assert set(got) == set(by_key)
    for k, part in by_key.items():
        assert got[k]["auroc"] == exact_auroc(part)
        assert got[k]["n_pos"] + got[k]["n_neg"] == len(part)
    assert whole["auroc"] == exact_auroc([(y, s) for _, y, s in rows])


def test_ranges_are_in_order_of_their_numbers(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("score"), F.lit(1).alias("n"))
    with settings_of(spark, **{"spark.sql.shuffle.partitions": "40"}):
        for coalesced in ("true", "false"):
            with settings_of(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": coalesced}):
                ends = range_parts(df, ["score"]).groupBy("part").agg(F.min("score"), F.max("score")).orderBy("part").collect()
            assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_one_class_raises(spark):
    df = spark.createDataFrame([("a", "none", 0.1, 0.2), ("b", "none", 0.3, 0.1)],
                               "id string, label string, prediction_up double, prediction_down double")
    with pytest.raises(Exception, match="same DE label"):
        SC.de_dir_score(df).collect()


def test_missing_columns_and_nulls(spark):
    sol = spark.createDataFrame([("a", "up"), ("b", "none")], "id string, label string")
    sub = spark.createDataFrame([("a", 0.5, 0.1)], "id string, prediction_up double, prediction_down double")
    full = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.2, 0.1)], "id string, prediction_up double, prediction_down double")
    with pytest.raises(SC.SubmissionError, match="missing required column 'prediction_down'"):
        SC.check_submission(sol, full.drop("prediction_down"))
    # per-column order: prediction_up's null count fails before prediction_down is looked for
    with pytest.raises(SC.SubmissionError, match="missing prediction_up values for 1 rows"):
        SC.check_submission(sol, sub.drop("prediction_down"))
    with pytest.raises(SC.SubmissionError, match="missing required column\\(s\\): reasoning_trace, tokens_used, model_name"):
        SC.check_submission(sol, sub, track="c")
    with pytest.raises(SC.SubmissionError, match="missing prediction_up values for 1 rows"):
        SC.check_submission(sol, sub)


def test_nan_is_missing_and_inf_is_rejected(spark):
    sol = spark.createDataFrame([("a", "up")], "id string, label string")
    schema = "id string, prediction_up double, prediction_down double"
    nan = spark.createDataFrame([("a", float("nan"), 0.1)], schema)
    with pytest.raises(SC.SubmissionError, match="missing prediction_up values for 1 rows"):
        SC.check_submission(sol, nan)
    sub = spark.createDataFrame([("a", float("-inf"), 0.1)], schema)
    with pytest.raises(SC.SubmissionError, match="NaN or Inf in 'prediction_up'"):
        SC.check_submission(sol, sub)
    sub_c = sub.withColumn("reasoning_trace", F.lit("")).withColumn("tokens_used", F.lit(0)).withColumn("model_name", F.lit("m"))
    with pytest.raises(SC.SubmissionError, match=r"NaN or Inf in prediction_up\.$"):
        SC.check_submission(sol, sub_c, track="c")


def test_track_a_prompt_limit(spark):
    sol = spark.createDataFrame([("a", "up")], "id string, label string")
    cols = {c: F.lit("x") for c in SC.REQUIRED_TRACK_A if c not in ("id", "prompt_tokens")}
    sub = spark.createDataFrame([("a", "5000")], "id string, prompt_tokens string")
    for c, v in cols.items():
        sub = sub.withColumn(c, v)
    with pytest.raises(SC.SubmissionError, match="max 4,096, but submission reports 5,000"):
        SC.check_submission(sol, sub, track="a")


def test_tool_call_limit_names_rows(spark):
    df = spark.createDataFrame([("r1", "251", "10", "2"), ("r2", "x", "10", "2"), ("r0", "300", "5", "1")],
                               "id string, num_tool_calls string, prompt_tokens string, num_distinct_tools string")
    row = SC.check_limits(df).first()
    assert row["max_tool_calls"] == 300 and row["first_ids"] == "r0, r1"
    assert row["error"].startswith("Tool-call limit exceeded: max 250 per row, but found 300 (rows: r0, r1)")


def test_checks_of_a_bad_submission_store_nothing(spark, monkeypatch):
    """A check that fails is read from aggregates: it stores no merged table."""
    sol = spark.createDataFrame([("a", "up"), ("b", "none")], "id string, label string")
    rows = spark.createDataFrame([("a", 0.5, 0.2, "251", "1", "1"), ("b", None, 0.1, "3", "x", "2")],
                                 "id string, prediction_up double, prediction_down double, num_tool_calls string, prompt_tokens string, num_distinct_tools string")
    sub = rows.withColumns({c: F.lit("m") for c in ("reasoning_trace", "tokens_used", "model_name")})

    def kept(*_, eager=True):
        raise AssertionError("stored")

    monkeypatch.setattr(type(sol), "checkpoint", kept)
    with pytest.raises(SC.SubmissionError, match=r"Tool-call limit exceeded: max 250 per row, but found 251 \(rows: a\)"):
        SC.check_submission(sol, sub, track="b")
    with pytest.raises(SC.SubmissionError, match="missing prediction_up values for 1 rows"):
        SC.check_submission(sol, sub, track="c")


def test_checks_share_one_partitioning_by_id(spark, monkeypatch):
    """Submission and solution are stored by id: a check's join shuffles and sorts neither, and adaptive execution is on again."""
    from regulon.plans.registry import load_all

    load_all()
    from regulon.plans import q_scoring as Q

    pairs = [(k % 5, k, f"S{k % 5}_G{k}", f"S{k % 5}", f"G{k}", "up" if k % 3 else "none", 1.0, 0.01) for k in range(300)]
    df = spark.createDataFrame(pairs, "pert_key long, gene_key long, id string, pert string, gene string, label string, lfc double, fdr double")
    monkeypatch.setattr(Q.S, "pairs", lambda *_: df)
    check, plans = SC.check_submission, []

    def checked(sol, sub, **options):
        plans.append(SC.score_join(sol, sub, "id")._jdf.queryExecution().executedPlan().toString())
        return check(sol, sub, **options)

    monkeypatch.setattr(SC, "check_submission", checked)
    with settings_of(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true"}):
        got = {(r["track"], r["spoilt"]): r["error"] for r in Q.submission_errors(spark, "").collect()}
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert len(plans) == len(got) == 12
    assert all("SortMergeJoin" in p and "Exchange" not in p and "Sort [" not in p for p in plans)
    spoilt = sum(p[1] % Q.ODD_GENE == 0 for p in pairs)
    assert got["a", "null"] == got["generic", "nan"] == got["b", "nan"] == f"Submission is missing prediction_up values for {spoilt} rows."
    assert got["c", "inf"] == "Submission contains NaN or Inf in prediction_up."
    assert got["b", "column"].startswith("Submission is missing required column(s): model_name.")
