"""Submissions of many rows: parts of bounded size, the same rows."""

from regulon.operators import runs as R
from regulon.plans import registry, standins


def _tables(spark):
    test = spark.range(200).selectExpr("id % 190 AS k", "'r' || id AS id", "7 AS prompt_tokens")
    long = spark.range(600).selectExpr("id % 195 AS k", "CAST(42 + id % 3 AS INT) AS seed", "1.0D AS prediction_up", "0.0D AS prediction_down",
                                       "'t' || id AS text", "id AS total_tokens", "'Up' AS effect")
    return test, long


def test_submissions_in_a_number_of_parts(spark):
    test, long = _tables(spark)
    for build, t in ((R.assemble_track_a, test), (R.assemble_enum, test.drop("prompt_tokens"))):
        parts = build(t, long, "m", on=["k"], tasks=5)
        assert parts.rdd.getNumPartitions() == 5
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, build(t, long, "m", on=["k"]).collect()))


def test_parts_follow_the_pairs(spark, monkeypatch):
    registry.load_all()
    from regulon.plans import q_runs

    sf, n = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = standins.pairs(spark, sf).count()
    monkeypatch.setattr(q_runs, "PAIRS_PER_TASK", pairs)
    assert q_runs._pair_tasks(spark, sf) is None
    monkeypatch.setattr(q_runs, "PAIRS_PER_TASK", -(-pairs // (3 * n)))
    assert n < q_runs._pair_tasks(spark, sf) <= 3 * n
