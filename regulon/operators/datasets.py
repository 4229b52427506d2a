"""Dataset construction: labels, two-axis split, positives, negatives, profile.

The construction is described in prose only; the tie and hash orders below are
our definition and are written identically in the oracle SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import largest_match, left_over
from .ranking import row_numbers
from .topk import largest_limit, top_k, top_k_by_column

# ── Fixed values ─────────────────────────────────────────────────────────
FDR_MAX = 0.05                 # significance
LFC_MIN = math.log2(1.5)       # |log2 fold change| for up / down
NEG_ABS_LFC_MAX = 0.25         # negatives: clearly unchanged
MIN_DEGS = 9                   # eligible perturbations have at least 9 DEGs
TOP_DEGS = 9                   # positives per perturbation
PERT_SPLIT = (80, 10, 10)      # train / val / test share of perturbations (%)
GENE_SPLIT = (60, 20, 20)      # train / val / test share of genes (%)
SPLITS = ("train", "val", "test")
# ──────────────────────────────────────────────────────────────────────────


def ternary_label(lfc: Column, fdr: Column) -> Column:
    """DSC-1: up / down / none from fold change and FDR."""
    sig = fdr < F.lit(FDR_MAX)
    return (
        F.when(sig & (lfc >= F.lit(LFC_MIN)), F.lit("up"))
        .when(sig & (lfc <= F.lit(-LFC_MIN)), F.lit("down"))
        .otherwise(F.lit("none"))
    )


def hash_pct(c: Column) -> Column:
    """A stable 0..99 bucket: first 32 bits of md5, modulo 100."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))


def sql_hash_pct(expr: str) -> str:
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT % 100)"


def _split_of(pct: Column, shares: tuple[int, int, int]) -> Column:
    a, b, _ = shares
    return F.when(pct < a, F.lit(SPLITS[0])).when(pct < a + b, F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))


def sql_split_of(pct: str, shares: tuple[int, int, int]) -> str:
    a, b, _ = shares
    return f"(CASE WHEN {pct} < {a} THEN 'train' WHEN {pct} < {a + b} THEN 'val' ELSE 'test' END)"


def hash_place(key: Column) -> Column:
    """Where a key stands in the shuffled order of all keys: its md5, then itself."""
    return F.struct(F.md5(key.cast("string")).alias("h"), key.cast("string").alias("k"))


def axis_split(keys: DataFrame, key: str, shares: tuple[int, int, int]) -> Column:
    """The split of ``key``: shares of all distinct keys, exact to one key.

    Keys are ranked by ``hash_place`` over range partitions, and the last key of the
    first and of the second share is looked up. Only these two leave the cluster: the
    split of a row is then a comparison with them, without a join.
    """
    place = hash_place(F.col(key))
    ranked = row_numbers(keys.select(key).distinct().select(place.alias("place")), [], ["place"])
    n = ranked.count()
    ends = [share_end(n, x) for x in (shares[0], shares[0] + shares[1])]
    found = {r["rank"]: r["place"] for r in ranked.where(F.col("rank").isin(ends)).collect()}

    def among(end: int) -> Column:
        last = found.get(end)
        return F.lit(False) if last is None else place <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k"))

    return F.when(among(ends[0]), F.lit(SPLITS[0])).when(among(ends[1]), F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))


def share_end(n: int, percent: int) -> int:
    """``percent`` of ``n`` keys, half a key rounded up."""
    return (2 * n * percent + 100) // 200


def sql_axis_split(table: str, key: str, shares: tuple[int, int, int]) -> str:
    a, b = shares[0], shares[0] + shares[1]
    return f"""SELECT {key}, CASE WHEN r <= (2 * n * {a} + 100) // 200 THEN 'train' WHEN r <= (2 * n * {b} + 100) // 200 THEN 'val' ELSE 'test' END AS split
FROM (SELECT {key}, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR)), {key}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table}))"""


def two_axis_split(pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """DSC-2: perturbations and genes get independent splits of exact shares, by the order
    of their hashes; a pair is kept only when both fall in the same split (so splits
    are disjoint on both axes). Adds ``split``. ``rows`` are those of ``pairs`` that are
    wanted, if not all: the shares are always of the keys of all ``pairs``."""
    ps, gs = axis_split(pairs, "pert", PERT_SPLIT), axis_split(pairs, "gene", GENE_SPLIT)
    return (
        (pairs if rows is None else rows).withColumn("_ps", ps).withColumn("_gs", gs)
        .where(F.col("_ps") == F.col("_gs"))
        .withColumnRenamed("_ps", "split").drop("_gs")
    )


def pair_hash_split(pairs: DataFrame) -> DataFrame:
    """A split by pair (the hash of the id), which does leak both axes: the
    baseline that :func:`split_leakage` is for."""
    return pairs.withColumn("split", _split_of(hash_pct(F.col("id")), PERT_SPLIT))


def is_deg(label: Column) -> Column:
    return label.isin("up", "down")


def eligible_perts(pairs: DataFrame, min_degs: int = MIN_DEGS) -> DataFrame:
    """DSC-3: perturbations with at least ``min_degs`` DEGs (all pairs)."""
    return (
        pairs.groupBy("pert")
        .agg(F.count_if(is_deg(F.col("label"))).alias("n_degs"))
        .where(F.col("n_degs") >= min_degs)
    )


def deg_order() -> list[Column]:
    """Most significant first: FDR, then |lfc| descending, then gene."""
    return [F.col("fdr").asc(), F.abs(F.col("lfc")).desc(), F.col("gene").asc()]


def top_degs_per_pert(pairs: DataFrame, k: int = TOP_DEGS) -> DataFrame:
    """WIN-3: up to ``k`` significant genes per perturbation, ranked by FDR."""
    return top_k(pairs.where(is_deg(F.col("label"))), ["pert"], deg_order(), k)


def eligible_pairs(pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Split-consistent pairs of eligible perturbations; of them ``rows``, if not all are wanted."""
    return two_axis_split(pairs, rows).join(eligible_perts(pairs).select("pert"), "pert", "left_semi")


def positive_pairs(pairs: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """DSC-4: split-consistent pairs of eligible perturbations, top DEGs each.
    ``eligible``: what :func:`match_input` has stored of ``pairs``, if there is that."""
    return top_degs_per_pert(eligible_pairs(pairs) if eligible is None else eligible)


def is_candidate() -> Column:
    """Negatives are chosen from none-labelled pairs that clearly did not change."""
    return (F.col("label") == "none") & (F.abs(F.col("lfc")) < NEG_ABS_LFC_MAX)


def match_input(pairs: DataFrame) -> DataFrame:
    """The eligible pairs that are DEGs or candidates, stored in the shared folder: positives
    and negatives are both chosen from these, so ``pairs`` is read for them once. Only
    these rows have their keys hashed for the splits."""
    return eligible_pairs(pairs, pairs.where(is_deg(F.col("label")) | is_candidate())).checkpoint(eager=True)


def negative_pairs(pairs: DataFrame) -> DataFrame:
    """DSC-5: negatives matched to positives per gene, then topped up per pert.

    Candidates: split-consistent, none-labelled pairs of eligible perts with
    |lfc| < 0.25. Pass 1 takes, per gene, as many candidates as the gene has
    positives. Pass 2 gives every perturbation at least as many negatives as
    positives, from the candidates pass 1 left unused. Both passes rank by an
    md5 hash of the id (then id).

    Positives and candidates come from one stored table of the eligible pairs,
    and what pass 1 took is stored too (reliable checkpoints, shared folder), so
    the pair table is read only to build the first.
    """
    kept = match_input(pairs)
    positives = top_degs_per_pert(kept).select("pert", "gene")
    cand = kept.where(is_candidate()).withColumn("_h", F.md5(F.col("id")))
    order = [F.col("_h").asc(), F.col("id").asc()]
    pos_gene = positives.groupBy("gene").agg(F.count(F.lit(1)).alias("_k"))
    pass1 = top_k_by_column(cand, pos_gene, ["gene"], order, "_k").drop("_k", "rank").checkpoint(eager=True)
    pos_pert = positives.groupBy("pert").agg(F.count(F.lit(1)).alias("_np"))
    got_pert = pass1.groupBy("pert").agg(F.count(F.lit(1)).alias("_ng"))
    deficit = (
        pos_pert.join(got_pert, "pert", "left")
        .select("pert", (F.col("_np") - F.coalesce(F.col("_ng"), F.lit(0))).alias("_k"))
        .where(F.col("_k") > 0)
    )
    unused = cand.join(pass1.select("pert", "gene"), ["pert", "gene"], "left_anti")
    pass2 = top_k_by_column(unused, deficit, ["pert"], order, "_k").drop("_k", "rank")
    return pass1.withColumn("pass", F.lit(1)).unionByName(pass2.withColumn("pass", F.lit(2))).drop("_h")


def matched_negative_pairs(pairs: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """DSC-5 as a degree-constrained match: negatives that keep the per-gene match while topping up.

    Candidates are those of :func:`negative_pairs`. First as many perturbations' needs
    as can be are met from genes within their quotas (``pass`` 1, a largest match: a
    perturbation needs as many negatives as it has positives, a gene may give as many as
    it has). Then genes still below their quota take more candidates (2), and only what
    perturbations still lack is taken beyond quotas (3): by no more pairs than any
    choice must. ``shortfall`` is what a perturbation lacks for want of candidates;
    one without any negative has a row with a null gene. ``eligible``: what :func:`match_input`
    has stored of ``pairs``, if there is that.
    """
    kept = match_input(pairs) if eligible is None else eligible
    positives = top_degs_per_pert(kept).select("pert", "gene").checkpoint(eager=True)
    edges = kept.where(is_candidate()).select(F.col("pert").alias("left"), F.col("gene").alias("right"), F.md5("id").alias("h"), "split")
    need, room = (positives.groupBy(F.col(c).alias(side)).agg(F.count(F.lit(1)).alias("k")).checkpoint(eager=True) for c, side in (("pert", "left"), ("gene", "right")))
    rows = _match_in_passes(edges, need, room)
    got = rows.groupBy("left").agg(F.count(F.lit(1)).alias("got"))
    lack = need.join(got, "left", "left").select("left", F.greatest(F.col("k") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("shortfall"))
    out = lack.join(rows, "left", "full").join(edges.select("left", "right", "split"), ["left", "right"], "left")
    return out.select(F.col("left").alias("pert"), F.col("right").alias("gene"), "split", "pass", F.coalesce("shortfall", F.lit(0)).alias("shortfall"))


def match_balance(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """(kind, key, wanted, shortfall) of every perturbation and gene with positives: as many
    negatives are wanted, and ``shortfall`` is how many are not there."""
    def axis(kind: str) -> DataFrame:
        wanted = positives.groupBy(F.col(kind).alias("key")).agg(F.count(F.lit(1)).alias("wanted"))
        got = negatives.where(F.col("gene").isNotNull()).groupBy(F.col(kind).alias("key")).agg(F.count(F.lit(1)).alias("got"))
        lack = F.greatest(F.col("wanted") - F.coalesce("got", F.lit(0)), F.lit(0))
        return wanted.join(got, "key", "left").select(F.lit(kind).alias("kind"), "key", "wanted", lack.alias("shortfall"))

    return axis("pert").unionByName(axis("gene"))


def _match_in_passes(edges: DataFrame, need: DataFrame, room: DataFrame) -> DataFrame:
    """(left, right, pass): a largest match, then what fills ``room``, then what fills ``need``."""
    order = [F.col("h"), F.col("left"), F.col("right")]
    edges = edges.select("left", "right", "h")
    rows = largest_match(edges, need, room).withColumn("pass", F.lit(1))
    for number, side, limits in ((2, "right", room), (3, "left", need)):
        free = edges.join(rows, ["left", "right"], "left_anti")
        more = top_k_by_column(free, left_over(limits, side, rows), [side], order, "k", most=largest_limit(limits, "k")).select("left", "right", "h")
        rows = rows.unionByName(more.withColumn("pass", F.lit(number))).checkpoint(eager=True)
    return rows.drop("h")


def split_leakage(assigned: DataFrame) -> DataFrame:
    """DSC-6 / SET-3: perturbations or genes present in more than one split."""
    def one(kind: str, col: str) -> DataFrame:
        return (
            assigned.groupBy(F.col(col).alias("key"))
            .agg(F.countDistinct("split").alias("n_splits"))
            .where(F.col("n_splits") > 1)
            .select(F.lit(kind).alias("kind"), "key", "n_splits")
        )
    return one("pert", "pert").unionByName(one("gene", "gene"))


def dataset_profile(assigned: DataFrame) -> DataFrame:
    """AGG-14: per split: perturbations, unique genes, rows, label counts (exact)."""
    return assigned.groupBy("split").agg(
        F.countDistinct("pert").alias("n_perts"),
        F.countDistinct("gene").alias("n_genes"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == "up").alias("n_up"),
        F.count_if(F.col("label") == "down").alias("n_down"),
        F.count_if(F.col("label") == "none").alias("n_none"),
    )


SKETCH_LOG = 14  # 2**14 registers: a relative standard error of about 0.8 %


def profile_sketch(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-14, mergeable: per split (and ``by``) HyperLogLog sketches of the perturbations and
    genes and the plain counts. One pass with partial sums, no sort of distinct values.

    Kept beside each batch of a growing dataset, these rows make the profile of all
    batches (:func:`merged_profile`) without reading the old ones again.
    """
    return assigned.groupBy(*(by or []), "split").agg(
        F.hll_sketch_agg("pert", SKETCH_LOG).alias("perts"),
        F.hll_sketch_agg("gene", SKETCH_LOG).alias("genes"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("up", "down", "none")],
    )


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile per split of all batches whose sketches these are; distinct counts are estimates."""
    return sketches.groupBy("split").agg(
        F.hll_sketch_estimate(F.hll_union_agg("perts")).alias("n_perts"),
        F.hll_sketch_estimate(F.hll_union_agg("genes")).alias("n_genes"),
        *[F.sum(c).alias(c) for c in ("n_rows", "n_up", "n_down", "n_none")],
    )


def head_rows(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """LIM-1: first ``n`` rows by an explicit key (tables have no file order)."""
    return df.orderBy(order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """LIM-2: ``n`` pseudo-random rows; repeatable across partitionings."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("_"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")
