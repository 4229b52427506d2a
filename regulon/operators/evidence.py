"""Evidence lookups over labelled pairs, annotations and interactions.

The reference answers one lookup at a time; here every lookup in a query
table is answered in one job: a case-insensitive equi-join on lowered keys,
bounded top-n lists per group (partial top-k before the shuffle), and the
text assembled with native string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import row_numbers
from .topk import top_k

# ── Fixed values: wording of the lookup answers ──────────────────────────
LABEL_STR = {"up": "up-regulated", "down": "down-regulated", "none": "not differentially expressed"}
LOOKUP_DESC = {"up": "up-regulated", "down": "down-regulated", "none": "no significant effect"}
PERT_LIST_HEAD = {"up": "    Up-regulated: ", "down": "    Down-regulated: ",
                  "none": "    Not differentially expressed: "}
PERT_NONE = "No training examples found for perturbation '%s'."
PERT_HEAD = "Training data for perturbation '%s' (%d examples):"
PERT_SUMMARY = "  Summary: %d up-regulated, %d down-regulated, %d not differentially expressed"
GENE_NONE = "No training examples found for target gene '%s'."
GENE_HEAD = "Training data for target gene '%s' (%d examples):"
GENE_LINE = "  - pert=%s: %s"
LOOKUP_ERROR = "Error: provide at least one of 'pert' or 'gene'."
LOOKUP_NONE = "No training examples found for %s."
LOOKUP_HEAD = "Found %d training example(s):"
LOOKUP_LINE = "  - pert=%s, gene=%s, label=%s (%s)"
ANNOTATION_NONE = "No results found for gene symbol '%s' in mouse."
ANNOTATION = {"symbol": "Gene: %s", "name": "Full name: %s", "summary": "Summary: %s",
              "go": "GO Biological Process (%d shown): %s", "kegg": "KEGG Pathways: %s"}
PARTNERS_NONE = "No protein interactions found for '%s' in mouse (STRING DB)."
PARTNERS_HEAD = "Protein interactions for %s (mouse, STRING DB):"
PARTNERS_LINE = "  - %s (combined score: %.3f)"
MAX_GENES_LISTED = 30
MAX_GO_TERMS = 8
MAX_PATHWAYS = 5
DEFAULT_PARTNERS = 10
MAX_PARTNERS = 50
# ──────────────────────────────────────────────────────────────────────────

PART_LINES = 1000  # lines of one text part
ASK_BINS = 64  # tasks that answer the lookups of one question


def _say(wording: str, *values: Column) -> Column:
    return F.format_string(wording, *values)


def _map_label(label: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(F.lower(label) == k, F.lit(v)).otherwise(out)
    return out


def pert_evidence(train: DataFrame, queries: DataFrame, q: str = "q") -> DataFrame:
    """AGG-7: per queried perturbation (any case): totals, per-label counts,
    the first 30 genes per label (gene order) and the summary text.

    Counts are a plain aggregate and the listed genes a top-k, both limited map-side,
    so a perturbation with any share of the pairs is spread over all tasks.
    """
    hits = queries.select(q).distinct().join(
        train.select(F.lower("pert").alias("_k"), "gene", F.lower(F.col("label").cast("string")).alias("lab")),
        F.lower(F.col(q)) == F.col("_k"), "inner").drop("_k")
    counts = hits.groupBy(q).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("lab") == k).alias(f"n_{k}") for k in PERT_LIST_HEAD])
    listed = top_k(hits.where(F.col("lab").isin(*PERT_LIST_HEAD)), [q, "lab"], [F.col("gene")], MAX_GENES_LISTED)
    lists = listed.groupBy(q).agg(F.array_sort(F.collect_list(F.struct("lab", "rank", "gene"))).alias("l"))
    g = counts.join(lists, q, "left")
    j = queries.select(q).distinct().join(g, q, "left")

    def genes(k: str) -> Column:
        return F.array_join(F.transform(F.filter("l", lambda x: x["lab"] == k), lambda x: x["gene"]), ", ")

    lines = [
        _say(PERT_HEAD, F.col(q), F.col("n")),
        _say(PERT_SUMMARY, *[F.col(f"n_{k}") for k in PERT_LIST_HEAD]),
        *[F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(h), genes(k))) for k, h in PERT_LIST_HEAD.items()],
    ]
    text = F.when(F.col("n").isNull(), _say(PERT_NONE, F.col(q))).otherwise(F.concat_ws("\n", *lines))
    return j.select(q, F.coalesce("n", F.lit(0)).alias("n_examples"), text.alias("text"))


def _answers(queries: DataFrame, key: str, hits: DataFrame, order: list[str], head: Column, none: Column) -> DataFrame:
    """``queries`` + matching lines -> (key, n_examples, part, text)."""
    return _worded(queries.join(_gathered(hits, key, order, head), key, "left"), key, none)


def _gathered(hits: DataFrame, key: str, order: list[str], head: Column) -> DataFrame:
    """Matching lines -> (key, n, part, text).

    Lines are numbered over ranges of (key, order) and gathered ``PART_LINES`` at a
    time, so a key with any number of matches gives bounded rows, meets in no task,
    and no line is dropped. The head stands in the first part.
    """
    ranked = row_numbers(hits.select(key, *order, "line"), [key], [*order, "line"])
    part = F.floor((F.col("rank") - 1) / PART_LINES).cast("int")
    parts = ranked.groupBy(key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    counts = parts.groupBy(key).agg(F.sum(F.size("l")).alias("n"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    text = F.when(F.col("part") == 0, F.concat_ws("\n", head, lines)).otherwise(lines)
    return parts.join(counts, key).select(key, "n", "part", text.alias("text"))


def _worded(answered: DataFrame, key: str, none: Column) -> DataFrame:
    """Lookups with their texts, or without one: then they say ``none``."""
    text = F.when(F.col("n").isNull(), none).otherwise(F.col("text"))
    return answered.select(key, F.coalesce("n", F.lit(0)).alias("n_examples"), F.coalesce("part", F.lit(0)).alias("part"), text.alias("text"))


def gene_lines(train: DataFrame, queries: DataFrame, q: str = "q") -> DataFrame:
    """AGG-8, long form: (q, pert, line) for every perturbation of a queried gene."""
    hits = queries.select(q).distinct().join(
        train.select(F.lower("gene").alias("_k"), "pert", "label"), F.lower(F.col(q)) == F.col("_k"), "inner")
    return hits.select(q, "pert", _say(GENE_LINE, F.col("pert"), _map_label(F.col("label"), LABEL_STR, F.col("label"))).alias("line"))


def gene_evidence(train: DataFrame, queries: DataFrame, q: str = "q") -> DataFrame:
    """AGG-8: per queried target gene, every perturbation and its wording, in parts."""
    asked = queries.select(q).distinct()
    return _answers(asked, q, gene_lines(train, asked, q), ["pert"], _say(GENE_HEAD, F.col(q), F.col("n")), _say(GENE_NONE, F.col(q)))


def _given(c: Column) -> Column:
    """An empty key counts as none."""
    return F.nullif(c, F.lit(""))


def lookup_ci(train: DataFrame, queries: DataFrame) -> DataFrame:
    """JOI-9: case-insensitive lookup by pert and/or gene for a whole query
    table ``(qid, pert, gene)``.

    Queries are of three kinds by what they give (null or empty marks an absent key),
    and each kind is an equi-join on its keys, so a training row goes to a join once. A
    query with neither key matches nothing.
    """
    t = train.select(F.lower("pert").alias("kp"), F.lower("gene").alias("kg"), F.col("pert").alias("t_pert"),
                     F.col("gene").alias("t_gene"), F.col("label").alias("t_label"))
    asked = queries.select("qid", F.lower(_given(F.col("pert"))).alias("qp"), F.lower(_given(F.col("gene"))).alias("qg"))
    p, g = F.col("qp"), F.col("qg")
    same_p, same_g = p == F.col("kp"), g == F.col("kg")
    kinds = [(p.isNotNull() & g.isNotNull(), same_p & same_g), (p.isNotNull() & g.isNull(), same_p), (p.isNull() & g.isNotNull(), same_g)]
    found = [asked.where(kind).join(t, same).select("qid", "t_pert", "t_gene", "t_label") for kind, same in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2])


def pair_evidence(train: DataFrame, queries: DataFrame) -> DataFrame:
    """AGG-9: count and listing of matching rows per query, in parts; "none" is
    worded "no significant effect", any other label lower-cased; rows by (pert,
    gene). A lookup without a key is answered with the error sentence.

    Lookups that ask the same have the same lines, so these are found, numbered and
    gathered once for each different question; then every lookup gets its answer. Of
    lookups with one qid the lines are listed together: the qid is their question.
    """
    desc = _map_label(F.col("t_label"), LOOKUP_DESC, F.lower("t_label"))
    pert, gene = _given(F.col("pert")), _given(F.col("gene"))
    asked = queries.withColumn("_own", F.count(F.lit(1)).over(Window.partitionBy("qid")) > 1).withColumn("_p", F.lower(pert)).withColumn(
        "_g", F.lower(gene)).withColumn("_bin", F.pmod(F.xxhash64("qid"), F.lit(ASK_BINS)))
    own, shared = (lambda c: F.when(F.col("_own"), c)), (lambda c: F.when(~F.col("_own"), c))
    question = F.to_json(F.struct(own(F.col("qid").cast("string")).alias("qid"), shared(F.col("_p")).alias("pert"), shared(F.col("_g")).alias("gene")))
    asked = asked.withColumn("_ask", F.when(F.col("qid").isNotNull(), question))
    questions = asked.where(F.col("_ask").isNotNull()).select("_own", F.col("_ask").alias("qid"), F.col("_p").alias("pert"), F.col("_g").alias("gene"))
    questions = questions.where(~F.col("_own")).distinct().unionByName(questions.where("_own"))
    hits = lookup_ci(train, questions).withColumn(
        "line", _say(LOOKUP_LINE, F.col("t_pert"), F.col("t_gene"), F.col("t_label"), desc)).withColumnRenamed("qid", "_ask")
    texts = _gathered(hits, "_ask", ["t_pert", "t_gene"], _say(LOOKUP_HEAD, F.col("n")))
    # a question that very many lookups ask is answered in as many tasks as it has bins
    texts = texts.join(asked.select("_ask", "_bin").distinct(), "_ask")
    keys = F.concat_ws(", ", F.concat(F.lit("pert="), pert), F.concat(F.lit("gene="), gene))
    none = F.when(pert.isNull() & gene.isNull(), F.lit(LOOKUP_ERROR)).otherwise(_say(LOOKUP_NONE, keys))
    return _worded(asked.join(texts, ["_ask", "_bin"], "left"), "qid", none)


def annotation_hits(raw: DataFrame, json: str = "json") -> DataFrame:
    """Raw annotation JSON -> (symbol, name, summary, go_bp, kegg).

    GO terms and pathways come as a list or, where there is one, as a single
    object; both become arrays.
    """
    v = F.try_parse_json(json)

    def items(path: str, kind: str) -> Column:
        one = F.try_variant_get(v, path, kind)
        return F.coalesce(F.try_variant_get(v, path, f"array<{kind}>"), F.when(one.isNotNull(), F.array(one)),
                          F.array().cast(f"array<{kind}>"))

    return raw.select(
        *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in ("symbol", "name", "summary")],
        items("$.go.BP", "struct<term:string>").alias("go_bp"),
        items("$.pathway.kegg", "struct<id:string,name:string>").alias("kegg"))


def gene_annotation(annotation: DataFrame, queries: DataFrame, q: str = "q") -> DataFrame:
    """ANN-1: first annotation per symbol; name, summary, up to 8 distinct GO
    terms (sorted; the reference's set order is arbitrary) and up to 5 KEGG
    pathways (name, else id, else ``?``)."""
    first = top_k(annotation, ["symbol"], [F.col("name").asc_nulls_last()], 1).select(
        "symbol", F.struct("name", "summary", "go_bp", "kegg").alias("a"))
    j = queries.select(q).distinct().join(first, F.col(q) == F.col("symbol"), "left")
    terms = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform("a.go_bp", lambda t: t["term"]),
                                                           lambda x: x.isNotNull()))), 1, MAX_GO_TERMS)
    paths = F.slice(F.transform("a.kegg", lambda p: F.coalesce(p["name"], p["id"], F.lit("?"))), 1, MAX_PATHWAYS)
    nz = lambda c: c.isNotNull() & (c != "")
    lines = F.concat_ws(
        "\n",
        _say(ANNOTATION["symbol"], F.col("symbol")),
        F.when(nz(F.col("a.name")), _say(ANNOTATION["name"], F.col("a.name"))),
        F.when(nz(F.col("a.summary")), _say(ANNOTATION["summary"], F.col("a.summary"))),
        F.when(F.size(terms) > 0, _say(ANNOTATION["go"], F.size(terms), F.array_join(terms, "; "))),
        F.when(F.size(paths) > 0, _say(ANNOTATION["kegg"], F.array_join(paths, "; "))),
    )
    text = F.when(F.col("symbol").isNull(), _say(ANNOTATION_NONE, F.col(q))).otherwise(lines)
    return j.select(q, text.alias("text"))


def top_interactions(edges: DataFrame, queries: DataFrame, limit: int = DEFAULT_PARTNERS, q: str = "q") -> DataFrame:
    """ANN-2: top partners per queried gene by score (ties by partner); the
    limit is clamped to 1..50; scores printed with three decimals."""
    k = min(max(1, limit), MAX_PARTNERS)
    e = edges.join(queries.select(q).distinct(), F.col("gene") == F.col(q), "left_semi")
    top = top_k(e, ["gene"], [F.col("score").desc(), F.col("partner").asc()], k)
    line = _say(PARTNERS_LINE, F.col("partner"), F.col("score"))
    g = top.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    j = queries.select(q).distinct().join(g, F.col(q) == F.col("gene"), "left")
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    text = F.when(F.col("l").isNull(), _say(PARTNERS_NONE, F.col(q))).otherwise(
        F.concat_ws("\n", _say(PARTNERS_HEAD, F.col(q)), lines))
    return j.select(q, text.alias("text"))
