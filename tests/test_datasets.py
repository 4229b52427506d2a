"""Exact splits and mergeable profiles."""

import hashlib

import pytest
from pyspark.sql import functions as F

from regulon.operators import datasets as D


def pairs(spark, n_perts, n_genes):
    return spark.range(n_perts).crossJoin(spark.range(n_genes).withColumnRenamed("id", "g")).select(
        F.concat(F.lit("p"), "id").alias("pert"), F.concat(F.lit("g"), "g").alias("gene"),
        F.concat(F.lit("p"), "id", F.lit("_g"), "g").alias("id"), F.element_at(F.array(*map(F.lit, ("up", "down", "none"))), (F.col("g") % 3 + 1).cast("int")).alias("label"))


@pytest.mark.parametrize("n_perts, n_genes", [(482, 20), (7, 33), (1, 1), (3, 2)])
def test_shares_are_exact_on_both_axes(spark, n_perts, n_genes):
    df = pairs(spark, n_perts, n_genes).repartition(5)
    ps = {r["pert"]: r["s"] for r in df.select("pert", D.axis_split(df, "pert", D.PERT_SPLIT).alias("s")).distinct().collect()}
    gs = {r["gene"]: r["s"] for r in df.select("gene", D.axis_split(df, "gene", D.GENE_SPLIT).alias("s")).distinct().collect()}
    for found, shares in ((ps, D.PERT_SPLIT), (gs, D.GENE_SPLIT)):
        keys = sorted(found, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
        a, b = (D.share_end(len(keys), x) for x in (shares[0], shares[0] + shares[1]))
        assert [found[k] for k in keys] == ["train"] * a + ["val"] * (b - a) + ["test"] * (len(keys) - b)
    if n_perts == 482:
        assert sum(s == "train" for s in ps.values()) == 386
        assert sum(s != "train" for s in ps.values()) == 96
    assigned = D.two_axis_split(df)
    assert {(r["pert"], r["gene"], r["split"]) for r in assigned.collect()} == {(p, g, s) for p, s in ps.items() for g, t in gs.items() if s == t}
    assert D.split_leakage(assigned).count() == 0


def test_the_split_of_an_empty_table(spark):
    assert D.two_axis_split(pairs(spark, 0, 5)).count() == 0


def test_profiles_merge_without_the_old_rows(spark):
    df = pairs(spark, 300, 40).withColumn("split", F.when(F.col("gene") < "g2", "train").otherwise("test")).withColumn("batch", F.hash("id") % 7)
    parts = D.profile_sketch(df, ["batch"])
    merged = {r["split"]: r.asDict() for r in D.merged_profile(parts).collect()}
    assert merged == {r["split"]: r.asDict() for r in D.merged_profile(D.profile_sketch(df)).collect()}
    for r in D.dataset_profile(df).collect():
        got = merged[r["split"]]
        assert all(got[c] == r[c] for c in ("n_rows", "n_up", "n_down", "n_none"))
        assert all(abs(got[c] - r[c]) <= 0.04 * r[c] for c in ("n_perts", "n_genes"))
    # many distinct keys: beyond the exact range of small sketches
    big = spark.range(400_000).select(F.col("id").cast("string").alias("pert"), F.lit("g").alias("gene"), F.lit("none").alias("label"),
                                      F.lit("train").alias("split"), (F.col("id") % 5).alias("batch"))
    a, b = D.merged_profile(D.profile_sketch(big, ["batch"])).first(), D.merged_profile(D.profile_sketch(big)).first()
    assert a == b and abs(a["n_perts"] - 400_000) < 0.04 * 400_000


def test_splits_of_some_rows_are_those_of_all_pairs(spark):
    """Shares are of the keys of all pairs, also where only some rows are wanted."""
    pairs = spark.range(600).select(
        F.concat(F.lit("P"), F.col("id") % 20).alias("pert"), F.concat(F.lit("G"), F.col("id") % 37).alias("gene"), "id")
    some = pairs.where("id % 5 = 0 and pert <> 'P0'")
    got = {tuple(r) for r in D.two_axis_split(pairs, some).select("id", "split").collect()}
    whole = {tuple(r) for r in D.two_axis_split(pairs).where("id % 5 = 0 and pert <> 'P0'").select("id", "split").collect()}
    assert got == whole and got
