"""Queries: sources and sinks round-trips (SRC-1/2, SNK-1/2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..operators import runs as R
from ..operators.ranking import row_numbers
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources import split_text as ST
from . import q_prompts as QPR
from . import q_runs as QR
from . import standins as S
from .registry import ORACLE, query


@query("read_pairs_csv", S.with_ctes("SELECT id, pert, gene, label FROM pairs", "pairs"))
def read_pairs_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1: pairs written as CSV (header, quoted fields) and read back with a fixed schema."""
    path = scratch_path(spark, "pairs-csv")
    S.pairs(spark, sf).select("id", "pert", "gene", "label").write.option("header", True).option("escape", '"').csv(path)
    return RD.read_pairs(spark, path)


@query("read_prompts_jsonl", S.with_ctes(f"""SELECT p.id, coalesce(o.prompt, {PR.sql_zero_shot_prompt('p.pert', 'p.gene')}) AS prompt
FROM pairs p LEFT JOIN (SELECT id, 'Custom question about ' || id AS prompt FROM pairs WHERE fdr < {S.dbl(QPR.OVERRIDE_FDR)}) o
USING (id)""", "pairs"))
def read_prompts_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: prompts as JSONL in two batches; a later batch overrides some
    ids (last wins by the batch order column)."""
    path = scratch_path(spark, "prompts-jsonl") + ".jsonl"
    p = S.pairs(spark, sf)
    first = p.select("id", PR.zero_shot_prompt(F.col("pert"), F.col("gene")).alias("prompt"), F.lit(1).alias("ord"))
    second = QPR.overrides(spark, sf).withColumn("ord", F.lit(2))
    for batch in (first, second):  # prompts repeat their template: written plainly they are most of what the job writes
        batch.write.mode("append").option("compression", "gzip").json(path)
    return RD.read_prompts(spark, path, fmt="json", order_col="ord")


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every prompt id on three lines, one after the other, then the overrides in a later file."""
    return S.pairs(spark, sf).select("id", F.explode(F.array(*[
        F.concat(F.lit(f"draft {k} about "), F.col("id"), F.lit(",\n \"quoted\"")) for k in range(3)])).alias("prompt"))


_LAST_SQL = S.with_ctes(f"""SELECT p.id, coalesce(o.prompt, 'draft 2 about ' || p.id || ',' || chr(10) || ' "quoted"') AS prompt
FROM pairs p LEFT JOIN (SELECT id, 'Custom question about ' || id AS prompt FROM pairs WHERE fdr < {S.dbl(QPR.OVERRIDE_FDR)}) o
USING (id)""", "pairs")


# of a compressed file, which one task reads whole; a multiple of the drafts of an id, so that all lie in one file
LINES_PER_FILE = 60_000


@query("read_prompts_last_jsonl", _LAST_SQL)
def read_prompts_last_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: JSONL without an order column: the last line of an id stays."""
    path = scratch_path(spark, "prompts-last")
    for k, df in enumerate((_versions(spark, sf), QPR.overrides(spark, sf).select("id", "prompt"))):
        # drafts repeat their template: written plainly they are most of what the job writes
        df.write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).json(f"{path}/{k}")
    return RD.read_prompts(spark, path, fmt="json")


@query("read_prompts_last_csv", _LAST_SQL)
def read_prompts_last_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: the same from CSV with quoted commas, quotes and newlines."""
    path = scratch_path(spark, "prompts-last-csv")
    for k, df in enumerate((_versions(spark, sf), QPR.overrides(spark, sf).select("id", "prompt"))):
        df.write.option("header", True).option("escape", '"').csv(f"{path}/{k}")
    return RD.read_prompts(spark, path, fmt="csv")


@query("read_response_cache", S.with_ctes("""SELECT id, seed, prediction_up, prediction_down, text AS reasoning_trace, effect,
  CAST(total_tokens AS DOUBLE) AS tokens FROM stored WHERE pert_key % 2 = 0
UNION ALL SELECT id, NULL, prediction_up, prediction_down, text, NULL, CAST(total_tokens AS DOUBLE)
FROM stored WHERE pert_key % 2 = 1 AND seed = 42""", "stored"))
def read_response_cache(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4: cache documents, one a perturbation: even ones with columns per
    seed, odd ones (agentic runs) without."""
    rows = _cache_rows(spark, sf)
    path = scratch_path(spark, "caches")
    docs = rows.groupBy("pert_key").agg(F.map_from_entries(F.collect_list(F.struct("id", "r"))).alias("rows"))
    # field names and traces repeat: written plainly the documents are most of what the job writes
    docs.select(F.to_json(F.struct("rows")).alias("value")).write.option("compression", "gzip").text(path)
    return RD.read_response_cache(spark, path, lines=True)


def _cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(pert_key, id, r): cache entries, of even perturbations with columns per seed, of odd ones without."""
    st = QR.stored(spark, sf)
    seeded = F.pmod("pert_key", F.lit(2)) == 0
    fields = {"prediction_up": "prediction_up", "prediction_down": "prediction_down", "reasoning_trace": "text",
              "effect": "effect", "tokens": "total_tokens"}
    per_seed = [F.max(F.when(seeded & (F.col("seed") == s), F.col(c))).alias(f"{d}_seed{s}") for s in S.SEEDS for d, c in fields.items()]
    plain = F.when(~seeded & (F.col("seed") == 42), F.struct("prediction_up", "prediction_down", F.col("text").alias("reasoning_trace"),
                                                           F.col("total_tokens").alias("tokens_used")))
    rows = st.groupBy("pert_key", "id").agg(*per_seed, F.max(plain).alias("_p"))
    row = F.struct(*[f"{d}_seed{s}" for s in S.SEEDS for d in fields], "_p.*")
    return rows.select("pert_key", "id", row.alias("r"))


DOCUMENT_ROWS = 1_000_000  # pairs of one cache document


@query("read_response_cache_document", ORACLE["read_response_cache"])
def read_response_cache_document(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4: the same rows in large JSON documents, each after other objects, read in as many
    tasks as their size asks for: one document, or one for each ``DOCUMENT_ROWS`` pairs."""
    path = scratch_path(spark, "cache-document")
    entry = F.concat(F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(": "), F.to_json("r"))
    documents = -(-S.pairs(spark, sf).count() // DOCUMENT_ROWS) or 1
    rows = _cache_rows(spark, sf).select("id", entry.alias("entry"), F.pmod(F.xxhash64("pert_key", "id"), F.lit(documents)).alias("doc"))
    # a document is a file, so one task writes it, in the order of the window
    order = Window.partitionBy("doc").orderBy("id", "entry")
    start = F.when(F.row_number().over(order) > 1, ",").otherwise('{"config": {"seeds": [42, 43, 44], "rows": {"x": {}}}, "rows": { ')
    end = F.when(F.lead(F.lit(1)).over(order).isNull(), " \n}}").otherwise("")
    lines = rows.select("doc", F.concat(start, F.lit("\n"), F.col("entry"), end).alias("value"))
    lines.write.partitionBy("doc").option("lineSep", " ").text(path)
    return RD.read_response_cache(spark, path)


@query("write_submission_csv", ORACLE.get("submission_track_a"))
def write_submission_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1: the track-A submission written as CSV and read back unchanged."""
    sub = QR.submission_track_a(spark, sf)
    path = scratch_path(spark, "submission-csv")
    SK.write_submission(sub, path)
    return (spark.read.schema(sub.schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


@query("submission_in_order", S.with_ctes("""SELECT CAST(row_number() OVER (ORDER BY h, id) AS BIGINT) AS place, id,
  CAST(coalesce(prediction_up, 0.333) AS VARCHAR) AS prediction_up, CAST(coalesce(prediction_down, 0.333) AS VARCHAR) AS prediction_down
FROM (SELECT p.id, md5(p.id) AS h, e.prediction_up, e.prediction_down FROM pairs p LEFT JOIN (
  SELECT id, max(prediction_up) AS prediction_up, max(prediction_down) AS prediction_down FROM stored WHERE seed = 42 GROUP BY id) e USING (id))""",
    "pairs", "stored"))
def submission_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1: a test file in an order of its own is read with the position of every row, its
    submission is written in that order, and the part files, one after the other, give
    the rows back at the places that they have in the test file."""
    test, out = (scratch_path(spark, n) for n in ("test-csv", "submission-csv"))
    h = F.md5("id")
    rows = S.pairs(spark, sf).select("id", "pert", "gene").repartitionByRange(h, "id").sortWithinPartitions(h, "id")
    rows.write.option("header", True).option("escape", '"').csv(test)
    results = QR.stored(spark, sf).where(F.col("seed") == S.SEEDS[0]).select("id", "prediction_up", "prediction_down")
    sub = RD.read_pairs(spark, test, labelled=False, position=True).select("position", "id").join(results, "id", "left")
    sub = sub.select("position", "id", *[F.coalesce(c, F.lit(R.DEFAULT_UP)).alias(c) for c in ("prediction_up", "prediction_down")])
    SK.write_submission(sub, out, order=["position"])
    back = ST.read_csv(spark, out, ["id", "prediction_up", "prediction_down"], check_header=True, one_header=True)
    return row_numbers(back, [], ["file", "offset"], "place").select(F.col("place").cast("long").alias("place"), "id", "prediction_up", "prediction_down")


ROWS_PER_TASK = 2_000_000  # of the response store


@query("append_responses", S.with_ctes(
    "SELECT id, seed, text, prediction_up, prediction_down FROM stored", "stored"))
def append_responses(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2: scored rows appended to a Parquet store in one write, a stale batch
    of the same keys besides, read back as one table (latest batch per key)."""
    path = scratch_path(spark, "responses-store")
    st = QR.stored(spark, sf).select("id", "seed", "text", "prediction_up", "prediction_down")
    # the run once, then an older batch of the same keys, as the store has them: the latest wins
    SK.append_responses(st.withColumn("batch", F.col("seed") - S.SEEDS[0] + 1), path)
    SK.append_responses(spark.read.parquet(path).select("id", "seed", F.lit("stale").alias("text"), F.lit(0.0).alias("prediction_up"),
                                                        F.lit(0.0).alias("prediction_down"), F.lit(0).alias("batch")), path)
    store = spark.read.parquet(path)
    tasks = -(-store.count() // ROWS_PER_TASK) or 1  # the rows are counted from the files' footers
    return SK.latest_responses(store, tasks=max(tasks, QR._tasks(spark))).select("id", "seed", "text", "prediction_up", "prediction_down")
