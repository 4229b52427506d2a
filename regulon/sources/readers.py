"""Sources: pairs, prompts, response caches, DE shards (SRC-1..7)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.topk import top_k
from . import split_text as ST

PAIRS = StructType([StructField(c, StringType()) for c in ("id", "pert", "gene", "label")])
PROMPTS_REQUIRED = ("id", "prompt")


def read_pairs(spark: SparkSession, path: str, labelled: bool = True, position: bool = False) -> DataFrame:
    """SRC-1: pairs CSV with a header; quoted commas and newlines allowed.

    The schema is fixed (no inference) and a file with other headers fails the job.
    One large file is read in many tasks (``split_text``). With ``position`` there is a
    column of that name, ``(file, offset)``, by which rows can be put in file order.
    """
    names = (PAIRS if labelled else StructType(PAIRS.fields[:3])).names
    rows = ST.read_csv(spark, path, names, check_header=True)
    return rows.select(*names, *([F.struct("file", "offset").alias("position")] if position else []))


def _placed(df: DataFrame) -> DataFrame:
    """Adds ``_place``: file, then the split's start in it, then the row in the split.

    The reader emits a split's rows in order, and the increasing id grows with
    them; ids of different splits are never compared before their starts.
    """
    return df.withColumn("_place", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")))


def read_prompts(spark: SparkSession, path: str, fmt: str | None = None, order_col: str | None = None) -> DataFrame:
    """SRC-2: (id, prompt) from CSV or JSONL; blank lines skipped; both columns
    cast to string; of duplicate ids the last one stays.

    "Last" is the position: file path, then place in the file (CSV: the byte at
    which the record starts). With ``order_col`` that column decides first. JSONL has
    a fixed schema (no inference pass). CSV fields may hold quoted newlines; the names
    are those of the first file's header, and one large file is read in many tasks
    (``split_text``).
    """
    fmt = fmt or ("json" if path.rstrip("/").endswith((".jsonl", ".ndjson")) else "csv")
    if fmt == "json":
        names = [*PROMPTS_REQUIRED, *([order_col] if order_col else [])]
        lines = _placed(spark.read.option("recursiveFileLookup", True).text(path)).where(F.trim("value") != "")
        v = F.try_parse_json("value")
        df = lines.select("_place", *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in names])
        # a line without a required key fails the job when it is read, as a CSV without the column does at once
        lack = F.raise_error(F.concat(F.lit(f"{path} is missing required column(s): id or prompt in "), F.lit("a line")))
        df = df.withColumn("id", F.when(F.col("id").isNull() | F.col("prompt").isNull(), lack.cast("string")).otherwise(F.col("id")))
    else:
        raw = (spark.read.option("recursiveFileLookup", True).option("header", True).option("multiLine", True)
               .option("escape", '"').csv(path))
        missing = [c for c in PROMPTS_REQUIRED if c not in raw.columns]
        if missing:
            raise ValueError(f"{path} is missing required column(s): {set(missing)}. Expected columns: id, prompt")
        order_col = order_col if order_col in raw.columns else None
        df = ST.read_csv(spark, path, raw.columns).withColumn("_place", F.struct("file", "offset"))
    order = F.col(order_col).try_cast("long") if order_col else F.lit(None).cast("long")
    df = df.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt"),
                   order.alias("_ord"), "_place")
    # a one-row top-k per id is limited map-side before the shuffle
    return top_k(df, ["id"], [F.col("_ord").desc_nulls_last(), F.col("_place").desc()], 1).select("id", "prompt")


# The caches' per-seed and seedless fields.
SEED_FIELDS = ("prediction_up", "prediction_down", "reasoning_trace", "effect", "tokens")
ROW_FIELDS = ("prediction_up", "prediction_down", "reasoning_trace", "effect", "tokens_used")
CACHE_SCHEMA = "id string, seed int, prediction_up double, prediction_down double, reasoning_trace string, effect string, tokens double"


def read_response_cache(spark: SparkSession, path: str, seeds=(42, 43, 44), lines: bool = False) -> DataFrame:
    """SRC-4: JSON cache documents ``{"rows": {id: {...}}}`` -> long table
    ``(id, seed, prediction_up, prediction_down, reasoning_trace, effect, tokens)``.

    A row with columns per seed gives a row per seed that has a prediction; a row
    without (agentic and fine-tuned runs) gives one with a null seed. A document
    is a file, of which one large one is read in many tasks (``split_text``), or a
    line each with ``lines``. An unreadable document or a missing path gives no rows.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)  # no cache yet
    fields = ", ".join(["prediction_up double", "prediction_down double", "reasoning_trace string", "effect string", "tokens_used double"]
                       + [f"{c}_seed{s} {'double' if c in ('prediction_up', 'prediction_down', 'tokens') else 'string'}"
                          for s in seeds for c in SEED_FIELDS])
    entry = f"struct<{fields.replace(' double', ':double').replace(' string', ':string')}>"
    if lines:
        rows = raw.select(F.from_json("value", f"rows map<string,{entry}>").alias("d")).select(F.explode("d.rows").alias("id", "r"))
    else:
        rows = ST.json_entries(spark, path, "rows", entry).select(F.col("key").alias("id"), F.col("entry").alias("r"))
    forms = [F.struct(F.lit(s).cast("int").alias("seed"), *[F.col(f"r.{c}_seed{s}").alias(c) for c in SEED_FIELDS]) for s in seeds]
    forms.append(F.struct(F.lit(None).cast("int").alias("seed"), *[F.col(f"r.{c}").alias(d) for c, d in zip(ROW_FIELDS, SEED_FIELDS)]))
    per_seed = F.array(*forms[:-1])
    seeded = F.exists(per_seed, lambda x: x["prediction_up"].isNotNull() | x["prediction_down"].isNotNull())
    out = rows.select("id", F.inline(F.when(seeded, per_seed).otherwise(F.array(forms[-1]))))
    return out.where(F.col("prediction_up").isNotNull() | F.col("prediction_down").isNotNull())


def write_de_shards(de: DataFrame, path: str) -> None:
    """Write a DE table as Parquet shards, each with a range of (drug, gene) in order.

    A drug with many rows spans tasks and shards, while a filter on the drug still
    skips all files and row groups whose statistics exclude it. The shards need no key
    column.
    """
    de.repartitionByRange("drug", "gene").sortWithinPartitions("drug", "gene").write.mode("overwrite").parquet(path)


def scan_de(spark: SparkSession, path: str, drug: str | None = None) -> DataFrame:
    """SRC-5: scan all DE shards, whoever wrote them; a drug filter is pushed
    into the Parquet reader (``PushedFilters``)."""
    df = spark.read.parquet(path)
    return df if drug is None else df.where(F.col("drug") == drug)
