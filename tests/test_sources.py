"""Readers and writers on small fixtures written to a scratch folder."""

import json

import pytest
from pyspark.sql import functions as F

from regulon.session import scratch_path
from regulon.sources import readers as RD
from regulon.sources import sinks as SK


def test_read_pairs_quoted_newline(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('id,pert,gene,label\nA_B,A,B,up\n"C_D",C,"D, x\ny",none\nNA_G,NA,G,down\n')
    rows = RD.read_pairs(spark, str(p)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("A_B", "A", "B", "up"), ("C_D", "C", "D, x\ny", "none"), ("NA_G", "NA", "G", "down")]


def test_read_prompts_last_wins_and_required(spark, tmp_path):
    p = tmp_path / "prompts.jsonl"
    p.write_text('{"id": 1, "prompt": "first", "ord": 1}\n\n{"id": "1", "prompt": "second", "ord": 2}\n{"id": 2, "prompt": 5, "ord": 3}\n')
    got = {r["id"]: r["prompt"] for r in RD.read_prompts(spark, str(p)).collect()}
    assert got == {"1": "second", "2": "5"}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1}\n')
    with pytest.raises(Exception, match="missing required column"):
        RD.read_prompts(spark, str(bad)).collect()


def test_last_line_wins_by_position(spark, tmp_path):
    p = tmp_path / "many.jsonl"
    p.write_text("".join(f'{{"id": {k % 7}, "prompt": "p{k}"}}\n' for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits of one file
    try:
        got = {r["id"]: r["prompt"] for r in RD.read_prompts(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {str(k % 7): f"p{k}" for k in range(5000)}
    bad = tmp_path / "bad.csv"
    bad.write_text("id,text\n1,x\n")
    with pytest.raises(ValueError, match="missing required column"):
        RD.read_prompts(spark, str(bad))


def test_seedless_response_cache(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"rows": {"A_B": {"prediction_up": 1.0, "prediction_down": 0.0, "reasoning_trace": "r", "tokens_used": 7},
                                      "C_D": {"prediction_up_seed42": 0.5, "tokens_seed42": 3}}}))
    rows = sorted((tuple(r) for r in RD.read_response_cache(spark, str(p)).collect()), key=str)
    assert rows == [("A_B", None, 1.0, 0.0, "r", None, 7.0), ("C_D", 42, 0.5, None, None, None, 3.0)]
    (tmp_path / "broken.json").write_text('{"rows": [')
    assert RD.read_response_cache(spark, str(tmp_path / "broken.json")).count() == 0


def test_scan_de_reads_shards_of_any_writer(spark, tmp_path):
    de = spark.createDataFrame([(f"d{k % 3}", f"g{k}", float(k)) for k in range(30)], "drug string, gene string, log2FoldChange double")
    de.repartition(7).write.parquet(str(tmp_path / "shards"))
    assert RD.scan_de(spark, str(tmp_path / "shards")).count() == 30
    assert RD.scan_de(spark, str(tmp_path / "shards"), drug="d1").count() == 10


def test_response_cache(spark, tmp_path):
    doc = {"rows": {"A_B": {"prediction_up_seed42": 1.0, "prediction_down_seed42": 0.0, "effect_seed42": "Up",
                            "prediction_up_seed43": 0.0, "prediction_down_seed43": 0.0, "model_name": "m"}}}
    p = tmp_path / "cache.json"
    p.write_text(json.dumps(doc, indent=2))
    rows = RD.read_response_cache(spark, str(p)).orderBy("seed").collect()
    assert [(r["seed"], r["prediction_up"], r["effect"]) for r in rows] == [(42, 1.0, "Up"), (43, 0.0, None)]
    assert RD.read_response_cache(spark, str(tmp_path / "missing.json")).count() == 0


def test_append_store_latest(spark):
    path = scratch_path(spark, "store-test")
    SK.append_responses(spark.createDataFrame([("a", 42, "x", 0)], "id string, seed int, text string, batch int"), path)
    SK.append_responses(spark.createDataFrame([("a", 42, "y", 1)], "id string, seed int, text string, batch int"), path)
    r = SK.latest_responses(spark.read.parquet(path)).collect()
    assert len(r) == 1 and r[0]["text"] == "y"


def test_large_store_is_dealt_out_by_key(spark):
    path = scratch_path(spark, "store-test")
    for b in (1, 0):
        SK.append_responses(spark.range(50).selectExpr("'r' || id AS id", "42 AS seed", f"'t{b}' AS text", f"{b} AS batch"), path)
    latest = SK.latest_responses(spark.read.parquet(path), tasks=3)
    assert latest.rdd.getNumPartitions() == 3
    assert sorted((r["id"], r["text"]) for r in latest.collect()) == sorted((f"r{i}", "t1") for i in range(50))
    assert all(".zstd." in f for f in spark.read.parquet(path).inputFiles())


def test_read_prompts_order_beats_file_name(spark, tmp_path):
    d = tmp_path / "prompts"
    d.mkdir()
    (d / "z-first.csv").write_text('id,prompt,ord\n1,old,1\n')
    (d / "a-second.csv").write_text('id,prompt,ord\n1,new,10\n')
    (d / "m-third.csv").write_text('id,prompt,ord\n1,mid,9\n')
    got = {r["id"]: r["prompt"] for r in RD.read_prompts(spark, str(d), fmt="csv", order_col="ord").collect()}
    assert got == {"1": "new"}


def test_submission_parts_are_one_file_in_test_order(spark, tmp_path):
    import random

    ids = [f"id{i}" for i in range(500)]
    random.Random(3).shuffle(ids)
    test = tmp_path / "test.csv"
    test.write_text("id,pert,gene\n" + "".join(f'{i},"p, {i}","g\n"\n' for i in ids))
    results = spark.createDataFrame([(i, k / 7, "a \"quoted\"\ntext" if k % 3 else "") for k, i in enumerate(ids)], "id string, prediction_up double, trace string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = RD.read_pairs(spark, str(test), labelled=False, position=True).select("id", "position").join(results, "id")
        SK.write_submission(rows, str(tmp_path / "sub"), order=["position"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    parts = sorted((tmp_path / "sub").glob("part-*"))
    assert len(parts) > 4
    import csv
    import io

    text = "".join(p.read_bytes().decode() for p in parts)
    got = list(csv.reader(io.StringIO(text, newline="")))
    assert got[0] == ["id", "prediction_up", "trace"]
    assert [r[0] for r in got[1:]] == ids
    assert [(float(r[1]), r[2]) for r in got[1:]] == [(k / 7, "a \"quoted\"\ntext" if k % 3 else "") for k in range(len(ids))]


def test_a_hot_drug_spans_shards_that_a_filter_still_skips(spark, tmp_path):
    rows = [("hot" if k % 2 else f"d{k % 40:02d}", f"g{k}", float(k)) for k in range(20_000)]
    de = spark.createDataFrame(rows, "drug string, gene string, log2FoldChange double").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        RD.write_de_shards(de, str(tmp_path / "shards"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    import pyarrow.parquet as pq

    ranges = []
    for p in (tmp_path / "shards").glob("*.parquet"):
        stats = [pq.ParquetFile(p).metadata.row_group(0).column(0).statistics]
        ranges.append((stats[0].min, stats[0].max))
    hot = [r for r in ranges if r[0] <= "hot" <= r[1]]
    assert len(hot) > 2 and sum(r[0] <= "d08" <= r[1] for r in ranges) < len(ranges) / 2
    assert RD.scan_de(spark, str(tmp_path / "shards"), drug="hot").count() == 10_000


def test_cache_documents_are_written_by_several_tasks(spark, monkeypatch, tmp_path):
    """Beyond ``DOCUMENT_ROWS`` pairs there are more documents, each whole and read back."""
    from pathlib import Path

    from regulon.plans.registry import load_all

    load_all()
    from regulon.plans import q_io

    rows = [(k, f"S{k}_G{k}", 0.5 + k, 0.25, f"a }} \"{k}\"", 7.0) for k in range(40)]
    df = spark.createDataFrame(rows, "pert_key long, id string, prediction_up double, prediction_down double, reasoning_trace string, tokens_used double")
    made = df.select("pert_key", "id", F.struct("prediction_up", "prediction_down", "reasoning_trace", "tokens_used").alias("r"))
    monkeypatch.setattr(q_io, "DOCUMENT_ROWS", 10)
    monkeypatch.setattr(q_io, "_cache_rows", lambda *_: made)
    monkeypatch.setattr(q_io.S, "pairs", lambda *_: df)
    monkeypatch.setattr(q_io, "scratch_path", lambda *_: str(tmp_path / "docs"))
    back = q_io.read_response_cache_document(spark, "").select("id", "seed", "prediction_up", "reasoning_trace", "tokens").collect()
    assert {tuple(r) for r in back} == {(i, None, up, trace, tokens) for _, i, up, _, trace, tokens in rows} and len(back) == 40
    files = [p for p in Path(tmp_path / "docs").rglob("*.txt")]
    assert len(files) > 1 and sum(len(json.loads(p.read_text())["rows"]) for p in files) == 40


@pytest.mark.parametrize("name", ["read_prompts_jsonl", "read_response_cache"])
def test_files_of_repeated_text_are_compressed(spark, monkeypatch, tmp_path, name):
    """The files a query writes and reads back are a small part of their text, and every row comes back."""
    import gzip

    from regulon.plans.registry import QUERIES, load_all

    load_all()
    from regulon.plans import q_io

    pairs = [(k % 5, k, f"S{k % 5}_G{k}", f"S{k % 5}", f"G{k}", "none", 0.0, 0.5) for k in range(1000)]
    df = spark.createDataFrame(pairs, "pert_key long, gene_key long, id string, pert string, gene string, label string, lfc double, fdr double")
    monkeypatch.setattr(q_io.S, "pairs", lambda *_: df)
    monkeypatch.setattr(q_io, "scratch_path", lambda *_: str(tmp_path / "out"))
    back = QUERIES[name](spark, "").collect()
    if name == "read_prompts_jsonl":
        assert sorted(r["id"] for r in back) == sorted(p[2] for p in pairs)
    else:  # odd perturbations have the row of seed 42 only
        want = q_io.QR.stored(spark, "").where("pert_key % 2 = 0 OR seed = 42").select("id", "prediction_up").collect()
        got = {(r["id"], r["prediction_up"]) for r in back}
        assert got == {tuple(r) for r in want} and len(back) == len(want)
    files = [p for p in tmp_path.rglob("part-*")]
    assert files and all(p.suffix == ".gz" for p in files)
    assert sum(p.stat().st_size for p in files) * 4 < sum(len(gzip.decompress(p.read_bytes())) for p in files)


def test_drafts_are_compressed_in_files_of_bounded_size(spark, monkeypatch, tmp_path):
    """The drafts of many ids are written to several small files, no id's drafts to two, and the last line of an id is read back."""
    import gzip

    from regulon.plans.registry import QUERIES, load_all

    load_all()
    from regulon.plans import q_io

    pairs = [(k % 5, k, f"S{k % 5}_G{k}", f"S{k % 5}", f"G{k}", "none", 0.0, k % 10 / 10) for k in range(1000)]
    df = spark.createDataFrame(pairs, "pert_key long, gene_key long, id string, pert string, gene string, label string, lfc double, fdr double").coalesce(2)
    monkeypatch.setattr(q_io.S, "pairs", lambda *_: df)
    monkeypatch.setattr(q_io, "scratch_path", lambda *_: str(tmp_path / "out"))
    monkeypatch.setattr(q_io, "LINES_PER_FILE", 300)
    back = {r["id"]: r["prompt"] for r in QUERIES["read_prompts_last_jsonl"](spark, "").collect()}
    over = {p[2] for p in pairs if p[7] < q_io.QPR.OVERRIDE_FDR}
    assert 0 < len(over) < 1000
    assert back == {p[2]: f"Custom question about {p[2]}" if p[2] in over else f'draft 2 about {p[2]},\n "quoted"' for p in pairs}
    files = sorted((tmp_path / "out" / "0").glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()).decode() for f in files]
    assert len(files) >= 10 and all(f.suffix == ".gz" for f in files)
    ids = [{json.loads(line)["id"] for line in t.splitlines()} for t in texts]
    assert sum(map(len, ids)) == 1000 and sum(t.count("\n") for t in texts) == 3000
    assert sum(f.stat().st_size for f in files) * 4 < sum(map(len, texts))
