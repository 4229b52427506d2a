"""Plan properties that the design relies on (guards against regressions)."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def qs():
    import __spark_entry__ as E

    return E.queries()


@pytest.mark.parametrize("name", ["parse_answers", "parse_conversations", "logprob_predictions", "completion_text",
                                  "zero_shot_prompts"])
def test_no_shuffle(spark, qs, name):
    p = plan(qs[name](spark, SF_SMALL))
    assert "Exchange" not in p.replace("BroadcastExchange", ""), name


@pytest.mark.parametrize("name", ["top_genes_per_cell", "top_de_genes", "top_degs_per_pert", "top_interactions"])
def test_partial_topk_before_shuffle(spark, qs, name):
    p = plan(qs[name](spark, SF_SMALL))
    assert p.count("WindowGroupLimit") >= 4, name  # tree + details, partial and final


def test_no_python_udf_in_native_queries(spark, qs):
    for name in ("flagship_run_score", "parse_answers", "logprob_or_text", "pert_evidence", "negative_pairs"):
        p = plan(qs[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_merged_run_shares_one_partitioning(spark):
    """One shuffle of partial sums, one of the solution; both can be sized at run time."""
    from regulon.plans import q_scoring as Q

    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        df = Q.merged_run(spark, SF_SMALL)
        tree = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, old)
    assert tree.count("Exchange hashpartitioning") == 2 and "Bucketed" not in tree
    assert "REPARTITION" not in tree


def test_filter_pushed_to_scan(spark, qs):
    p = plan(qs["scan_de_drug"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(drug), EqualTo(drug,S1)]" in p
