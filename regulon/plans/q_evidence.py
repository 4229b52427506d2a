"""Queries: evidence lookups (JOI-9, AGG-7..9, ANN-1/2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as EV
from . import standins as S
from .registry import query

N_PERT_QUERY = 100


def _train(spark, sf):
    return S.pairs(spark, sf).select("pert", "gene", "label")


def pert_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One lower-case lookup per supplier (the perturbation universe)."""
    return S.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("q"))


def gene_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One lower-case lookup per part (some parts have no pairs)."""
    return S.table(spark, sf, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("q"))


def pair_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups of six kinds by part key: gene only, both, pert only (the other
    key null or empty), an unknown gene, and neither."""
    p = S.table(spark, sf, "part").withColumn("kind", F.pmod("p_partkey", F.lit(6)))
    pert = F.concat(F.lit("S"), (F.pmod("p_partkey", F.lit(N_PERT_QUERY)) + 1).cast("string"))
    gene = F.concat(F.lit("g"), F.col("p_partkey").cast("string"))
    kind = F.col("kind")
    return p.select(
        F.col("p_partkey").cast("string").alias("qid"),
        F.when(kind.isin(1, 2), pert).when(kind.isin(3, 5), F.lit("")).alias("pert"),
        F.when(kind.isin(0, 1, 3), gene).when(kind == 4, F.concat(F.lit("unknown"), gene)).when(kind == 5, F.lit("")).alias("gene"),
    )


def mixed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with labels in mixed case and some outside the list."""
    n = F.pmod("gene_key", F.lit(5))
    lab = F.when(n == 0, F.upper("label")).when(n == 1, F.lit("Unclear")).otherwise(F.col("label"))
    return S.pairs(spark, sf).select("pert", "gene", lab.alias("label"))


S.register("pert_q", None, "SELECT 's' || CAST(s_suppkey AS VARCHAR) AS q FROM supplier", [])
S.register("gene_q", None, "SELECT 'g' || CAST(p_partkey AS VARCHAR) AS q FROM part", [])
S.register("pert_hits", None, """SELECT q.q, t.gene, lower(t.label) AS lab FROM (SELECT DISTINCT q FROM pert_q) q
JOIN pairs t ON lower(t.pert) = lower(q.q)""", ["pert_q", "pairs"])
_HEAD = EV.PERT_LIST_HEAD
S.register("mixed_pairs", None, """SELECT pert, gene, CASE gene_key % 5 WHEN 0 THEN upper(label) WHEN 1 THEN 'Unclear' ELSE label END AS label
FROM pairs""", ["pairs"])


@query("pert_evidence", S.with_ctes(f"""SELECT q.q, coalesce(c.n, 0) AS n_examples,
  CASE WHEN c.n IS NULL THEN 'No training examples found for perturbation ''' || q.q || '''.'
  ELSE 'Training data for perturbation ''' || q.q || ''' (' || CAST(c.n AS VARCHAR) || ' examples):' || chr(10)
    || '  Summary: ' || CAST(c.n_up AS VARCHAR) || ' up-regulated, ' || CAST(c.n_down AS VARCHAR) || ' down-regulated, '
    || CAST(c.n_none AS VARCHAR) || ' not differentially expressed'
    {"".join(f"|| CASE WHEN c.n_{k} > 0 THEN chr(10) || '{h}' || l_{k}.genes ELSE '' END " for k, h in _HEAD.items())}
  END AS text
FROM (SELECT DISTINCT q FROM pert_q) q
LEFT JOIN (SELECT q, count(*) AS n, count(*) FILTER (WHERE lab = 'up') AS n_up, count(*) FILTER (WHERE lab = 'down') AS n_down,
                  count(*) FILTER (WHERE lab = 'none') AS n_none FROM pert_hits GROUP BY q) c ON c.q = q.q
{"".join(f'''LEFT JOIN (SELECT q, string_agg(gene, ', ' ORDER BY gene) AS genes FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY gene) AS rn FROM pert_hits WHERE lab = '{k}') WHERE rn <= {EV.MAX_GENES_LISTED}
  GROUP BY q) l_{k} ON l_{k}.q = q.q
''' for k in _HEAD)}""", "pert_hits"))
def pert_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-7: per perturbation lookup: counts per label and first 30 genes each."""
    return EV.pert_evidence(_train(spark, sf), pert_queries(spark, sf))


def _cases(table: dict[str, str], other: str) -> str:
    return "CASE lower(t.label) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


@query("gene_evidence", S.with_ctes(f"""SELECT q.q, coalesce(n.n, 0) AS n_examples, CAST(coalesce(g.part, 0) AS INTEGER) AS part,
  CASE WHEN n.n IS NULL THEN 'No training examples found for target gene ''' || q.q || '''.'
  ELSE CASE WHEN g.part = 0 THEN 'Training data for target gene ''' || q.q || ''' (' || CAST(n.n AS VARCHAR) || ' examples):' || chr(10) ELSE '' END
       || g.lines END AS text
FROM (SELECT DISTINCT q FROM gene_q) q
LEFT JOIN (SELECT q.q, count(*) AS n FROM (SELECT DISTINCT q FROM gene_q) q JOIN mixed_pairs t ON lower(t.gene) = lower(q.q) GROUP BY q.q) n USING (q)
LEFT JOIN (
  SELECT q, (rn - 1) // {EV.PART_LINES} AS part, string_agg(line, chr(10) ORDER BY rn) AS lines FROM (
    SELECT q.q, '  - pert=' || t.pert || ': ' || {_cases(EV.LABEL_STR, 't.label')} AS line, row_number() OVER (PARTITION BY q.q ORDER BY t.pert) AS rn
    FROM (SELECT DISTINCT q FROM gene_q) q JOIN mixed_pairs t ON lower(t.gene) = lower(q.q)) GROUP BY ALL) g USING (q)""",
    "gene_q", "mixed_pairs"))
def gene_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-8: per target gene lookup: every perturbation and its effect."""
    return EV.gene_evidence(mixed_labels(spark, sf), gene_queries(spark, sf))


S.register("pair_q", None, f"""SELECT CAST(p_partkey AS VARCHAR) AS qid,
  CASE WHEN p_partkey % 6 IN (1, 2) THEN 'S' || CAST(p_partkey % {N_PERT_QUERY} + 1 AS VARCHAR) WHEN p_partkey % 6 IN (3, 5) THEN '' END AS pert,
  CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN 'g' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 6 = 4 THEN 'unknowng' || CAST(p_partkey AS VARCHAR)
       WHEN p_partkey % 6 = 5 THEN '' END AS gene FROM part""", [])
S.register("pair_hits", None, f"""SELECT q.qid, t.pert, t.gene,
  '  - pert=' || t.pert || ', gene=' || t.gene || ', label=' || t.label || ' (' || {_cases(EV.LOOKUP_DESC, 'lower(t.label)')} || ')' AS line,
  row_number() OVER (PARTITION BY q.qid ORDER BY t.pert, t.gene) AS rn
FROM (SELECT qid, nullif(pert, '') AS pert, nullif(gene, '') AS gene FROM pair_q) q JOIN mixed_pairs t
  ON (q.pert IS NULL OR lower(t.pert) = lower(q.pert)) AND (q.gene IS NULL OR lower(t.gene) = lower(q.gene))
 AND (q.pert IS NOT NULL OR q.gene IS NOT NULL)""", ["pair_q", "mixed_pairs"])


@query("pair_evidence", S.with_ctes(f"""SELECT q.qid, coalesce(n.n, 0) AS n_examples, CAST(coalesce(h.part, 0) AS INTEGER) AS part,
  CASE WHEN coalesce(q.pert, '') = '' AND coalesce(q.gene, '') = '' THEN 'Error: provide at least one of ''pert'' or ''gene''.'
  WHEN n.n IS NULL THEN 'No training examples found for ' || concat_ws(', ', CASE WHEN q.pert <> '' THEN 'pert=' || q.pert END,
       CASE WHEN q.gene <> '' THEN 'gene=' || q.gene END) || '.'
  ELSE CASE WHEN h.part = 0 THEN 'Found ' || CAST(n.n AS VARCHAR) || ' training example(s):' || chr(10) ELSE '' END || h.lines END AS text
FROM pair_q q LEFT JOIN (SELECT qid, count(*) AS n FROM pair_hits GROUP BY qid) n USING (qid)
LEFT JOIN (SELECT qid, (rn - 1) // {EV.PART_LINES} AS part, string_agg(line, chr(10) ORDER BY rn) AS lines FROM pair_hits GROUP BY ALL) h USING (qid)""",
    "pair_q", "pair_hits"))
def pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-9 + AGG-9: lookups by pert and/or gene, or neither, case-insensitive, one job."""
    return EV.pair_evidence(mixed_labels(spark, sf), pair_queries(spark, sf))


# ── ANN-1: annotation table derived from part ────────────────────────────

def annotation(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation hits per gene symbol from ``part``, as raw JSON: name, summary
    (absent for some), GO terms from the type words (with repeats), KEGG entries
    (name, id only, or neither); some hold a single object instead of a list."""
    p = S.table(spark, sf, "part")
    words = F.split("p_type", " ")
    go = F.transform(F.concat(words, words), lambda w: F.struct(F.lower(w).alias("term")))
    kegg = F.array(
        F.struct(F.col("p_brand").alias("id"),
                 F.when(F.pmod("p_size", F.lit(3)) != 0, F.concat(F.lit("Pathway of "), F.col("p_brand"))).alias("name")),
        F.struct(F.when(F.pmod("p_size", F.lit(4)) != 0, F.concat(F.lit("k"), F.col("p_size").cast("string"))).alias("id"),
                 F.lit(None).cast("string").alias("name")),
    )
    one_term, one_path = F.pmod("p_size", F.lit(7)) == 0, F.pmod("p_size", F.lit(11)) == 0

    def hit(bp, paths):
        return F.to_json(F.struct(
            F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("symbol"),
            F.col("p_name").alias("name"),
            F.when(F.pmod("p_size", F.lit(5)) != 0, F.concat(F.lit("Brand "), F.col("p_brand"), F.lit(", size "),
                                                              F.col("p_size").cast("string"))).alias("summary"),
            F.struct(bp.alias("BP")).alias("go"), F.struct(paths.alias("kegg")).alias("pathway")))

    raw = (F.when(one_term & one_path, hit(go[0], kegg[0])).when(one_term, hit(go[0], kegg))
           .when(one_path, hit(go, kegg[0])).otherwise(hit(go, kegg)))
    return EV.annotation_hits(p.select(raw.alias("json")))


S.register("annotation", None, """SELECT 'G' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name,
  CASE WHEN p_size % 5 <> 0 THEN 'Brand ' || p_brand || ', size ' || CAST(p_size AS VARCHAR) END AS summary,
  list_slice(list_transform(list_concat(string_split(p_type, ' '), string_split(p_type, ' ')), lambda w: lower(w)),
             1, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 99 END) AS terms,
  list_slice([coalesce(CASE WHEN p_size % 3 <> 0 THEN 'Pathway of ' || p_brand END, p_brand, '?'),
   coalesce(CASE WHEN p_size % 4 <> 0 THEN 'k' || CAST(p_size AS VARCHAR) END, '?')], 1, CASE WHEN p_size % 11 = 0 THEN 1 ELSE 9 END) AS paths
FROM part""", [])


@query("gene_annotation", S.with_ctes(f"""SELECT g.gene AS q, CASE WHEN a.symbol IS NULL THEN 'No results found for gene symbol ''' || g.gene || ''' in mouse.'
  ELSE concat_ws(chr(10), 'Gene: ' || a.symbol, CASE WHEN a.name <> '' THEN 'Full name: ' || a.name END,
    CASE WHEN a.summary <> '' THEN 'Summary: ' || a.summary END,
    CASE WHEN len(list_slice(list_sort(list_distinct(a.terms)), 1, {EV.MAX_GO_TERMS})) > 0 THEN 'GO Biological Process ('
      || CAST(len(list_slice(list_sort(list_distinct(a.terms)), 1, {EV.MAX_GO_TERMS})) AS VARCHAR) || ' shown): '
      || array_to_string(list_slice(list_sort(list_distinct(a.terms)), 1, {EV.MAX_GO_TERMS}), '; ') END,
    'KEGG Pathways: ' || array_to_string(list_slice(a.paths, 1, {EV.MAX_PATHWAYS}), '; ')) END AS text
FROM (SELECT DISTINCT gene FROM pairs) g LEFT JOIN annotation a ON a.symbol = g.gene""", "pairs", "annotation"))
def gene_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """ANN-1: annotation summary for every gene in the pairs table."""
    q = S.pairs(spark, sf).select(F.col("gene").alias("q"))
    return EV.gene_annotation(annotation(spark, sf), q)


# ── ANN-2: interaction edges derived from lineitem ───────────────────────

def interactions(spark: SparkSession, sf: str) -> DataFrame:
    li = S.table(spark, sf, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("score")).select(
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("partner"), "score")


S.register("edges", None, """SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene, 'S' || CAST(l_suppkey AS VARCHAR) AS partner,
  max(l_discount) AS score FROM lineitem GROUP BY l_partkey, l_suppkey""", [])


@query("top_interactions", S.with_ctes(f"""SELECT q.q, CASE WHEN t.lines IS NULL
  THEN 'No protein interactions found for ''' || q.q || ''' in mouse (STRING DB).'
  ELSE 'Protein interactions for ' || q.q || ' (mouse, STRING DB):' || chr(10) || t.lines END AS text
FROM (SELECT DISTINCT 'G' || CAST(p_partkey AS VARCHAR) AS q FROM part) q LEFT JOIN (
  SELECT gene, string_agg('  - ' || partner || ' (combined score: ' || printf('%.3f', score) || ')', chr(10) ORDER BY rk) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, partner) AS rk FROM edges)
  WHERE rk <= {EV.DEFAULT_PARTNERS} GROUP BY gene) t ON t.gene = q.q""", "edges"))
def top_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """ANN-2: the 10 strongest partners for every part's gene symbol."""
    q = S.table(spark, sf, "part").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("q"))
    return EV.top_interactions(interactions(spark, sf), q)
