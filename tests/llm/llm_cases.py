"""Shared inputs of the training-data operator tests."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, texts, lang="en"):
    """documents from texts (ids from 0) or (doc_id, text) pairs."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)


PASSAGE = " ".join(f"word{i * 7919 % 1000}" for i in range(60))

# nulls, empty and blank texts, ties, repeated rows, one very long text, other scripts
EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\f\r "),
    (4, "one"),
    (5, PASSAGE + " tail"),
    (6, "head " + PASSAGE),
    (6, "head " + PASSAGE),
    (7, "Ünï cödé ñ 日本語   é don't"),
    (None, "a text without an id " + PASSAGE),
    (8, " ".join(f"long{i % 5000}" for i in range(20_000))),
    (9, "x" * 30_000),
    (10, "[INST] </s> <s> [/INST]"),
]


def edge(spark):
    """The edge rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", None, 1, "x", b"y", 2, True) for i, t in EDGE]
    extra = [("n_words", T.IntegerType()), ("TEXT", T.StringType()), ("spans", T.BinaryType()), ("fp", T.IntegerType()), ("d", T.BooleanType())]
    schema = T.StructType(DOCS.fields + [T.StructField(n, k) for n, k in extra])
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    """Rows by doc_id (repeated ids: the list's last)."""
    return {r["doc_id"]: r for r in df.collect()}
