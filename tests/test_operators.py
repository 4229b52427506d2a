"""Skew-safe top-k, bounded model calls, and streaming = batch."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from regulon.operators.topk import top_k, top_k_by_column


def test_topk_by_column_equals_plain_row_number(spark):
    rnd = random.Random(5)
    # one hot group with a third of the rows, per-group limits of various sizes
    rows = [(("hot" if rnd.random() < 0.34 else f"g{rnd.randint(0, 40)}"), rnd.randint(0, 10**6), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    limits = df.select("g").distinct().withColumn("k", (F.abs(F.hash("g")) % 7 + 1).cast("int"))
    base = df.join(limits, "g")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = top_k_by_column(df, limits, ["g"], order, "k").select("g", "id", "rank")
    w = Window.partitionBy("g").orderBy(*order)
    want = base.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k")).select("g", "id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    const = top_k(df, ["g"], order, 3)
    assert const.groupBy("g").count().where("count > 3").count() == 0


def test_model_calls_are_concurrent_retried_and_kept(spark):
    import threading
    import time

    from regulon.operators import runs as R

    def scorer(prompt, seed):
        if prompt == "bad":
            raise RuntimeError
        time.sleep(0.2)
        return f"{prompt}-{seed}-{threading.active_count()}"

    rows = [(f"i{k}", 42, "bad" if k == 3 else f"p{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "id string, seed int, prompt string")
    out = R.batch_complete(df, scorer, max_retries=2, backoff=lambda a: 0.0, concurrency=8, tasks=1).collect()
    assert [r["id"] for r in out if r["status"] == "failed"] == ["i3"]
    assert {r["attempts"] for r in out if r["status"] == "failed"} == {3} and {r["attempts"] for r in out if r["status"] == "ok"} == {1}
    assert max(int(r["text"].rsplit("-", 1)[1]) for r in out if r["text"]) > 2


def test_stream_ingest_equals_batch(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from regulon.functions import parsing as P
    from regulon.plans import standins as S

    streamed = E.queries()["ingest_responses"](spark, SF_SMALL)
    conv = S.table(spark, SF_SMALL, "conversations")
    batch = P.parse_answers(conv.withColumn("source", P.answer_source(F.col("text"))), "source").select(
        "conv_id", "turn", "parsed_label", "prediction_up", "prediction_down")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_cluster_settings_sizes_partitions():
    from regulon.session import cluster_settings

    s = cluster_settings(100 << 40, executors=1000, cores_per_executor=4)
    parts = int(s["spark.sql.shuffle.partitions"])
    assert parts % 4000 == 0 and parts * (256 << 20) >= (100 << 40)
    assert cluster_settings(1 << 20, 2, 4)["spark.sql.shuffle.partitions"] == "16"
