"""STR-2 with a watermark: replays and late rows, restarts, and state that falls again."""

import datetime as dt

from regulon.session import scratch_path
from regulon.streaming import jobs as J

SCHEMA = "id long, ts timestamp, text string"
START = dt.datetime(2024, 1, 1)


def rows(first, last, minutes=10):
    return [(i, START + dt.timedelta(minutes=minutes * i), "<answer>A</answer>") for i in range(first, last)]


def run(spark, path, out, ck, delay="5 hours"):
    stream = J.stream_parquet(spark, path, SCHEMA)
    done = J.run_to_parquet(J.ingest_responses(stream, ["id"], event_time="ts", delay=delay), out, ck)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    return states[-1] if states else None


def test_replays_and_late_rows_over_restarts(spark):
    path, out, ck = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-ck"))

    def deliver(data):
        spark.createDataFrame(data, SCHEMA).coalesce(2).write.mode("append").parquet(path)

    def ids():
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    deliver(rows(0, 600) + rows(550, 600))  # a replay in the batch itself
    first = run(spark, path, out, ck)
    assert ids() == list(range(600))
    # a restart: all old rows again, new ones, and one late row that is too old and one that is not
    late = [(9001, START, "x"), (9002, START + dt.timedelta(minutes=10 * 599 - 60), "x")]
    deliver(rows(0, 700) + late)
    second = run(spark, path, out, ck)
    assert ids() == [*range(700), 9002]
    # far later rows: the watermark passes all keys so far and their state goes
    deliver(rows(5000, 5010))
    third = run(spark, path, out, ck)
    assert ids() == [*range(700), *range(5000, 5010), 9002]
    assert first <= 60 and second <= 60 and third <= 10  # keys of the last hours, not all seen
    deliver(rows(5000, 5010))
    run(spark, path, out, ck)
    assert ids() == [*range(700), *range(5000, 5010), 9002]
