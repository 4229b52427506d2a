"""Degree-constrained matching: as many edges as can be, none beyond a node's number.

Edges ``(left, right, h)`` join two kinds of nodes; a left node needs a number of
partners, a right node may take a number. Three kinds of rounds, each a few joins
and limited top-k selections over all nodes at once:

1. *Proposals.* Every left node offers itself, for as many partners as it lacks, to
   right nodes with room; they take as many as they have room for. Both prefer who has
   the fewest open edges to spare (then the order of ``h``): who has none to spare is
   served by others hardly ever, and little is left to exchange. Rounds go on until
   no open edge has a left node that lacks and a right node with room.
2. *Distances.* From the right nodes with room, backwards: a left node is one step
   further than the nearest right node it has a free edge to, a full right node one
   further than the nearest of its partners. If no left node that lacks a partner is
   reached, no change of partners can help and the matching is as large as can be.
3. *Exchanges.* Left nodes that lack partners and were reached offer themselves to
   nodes one step nearer; a full one lets a nearer partner go for each that it takes,
   who then does the same, down to the nodes with room. Every pass adds at least one
   edge; then distances are measured again.

Work tables are checkpointed in the shared folder after each round. An edge taken or let
go in a pass joins distances that no later step of the pass looks at, so the matching
itself is written once a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import largest_limit, top_k, top_k_by_column

ORDER = ["h", "left", "right"]
FOLD = 16  # steps after which a union of tables is written as one


def left_over(limits: DataFrame, key: str, matched: DataFrame) -> DataFrame:
    """``limits (key, k)`` less the matched edges of each node, where something is left."""
    used = matched.groupBy(key).agg(F.count(F.lit(1)).alias("_used"))
    rest = limits.join(used, key, "left").select(key, (F.col("k") - F.coalesce(F.col("_used"), F.lit(0))).alias("k"))
    return rest.where(F.col("k") > 0)


def _offers(free: DataFrame, lacking: DataFrame, room: DataFrame, most: tuple[int, int], first: tuple[str, ...] = ()) -> DataFrame:
    """Offers taken: each left node makes at most as many as it lacks, each right node takes what it has room for.

    ``most`` bounds the ``k`` of both. Columns ``first`` of ``room`` and of ``lacking`` go before the order of ``h``.
    """
    order = [F.col(c) for c in (*first, *ORDER)]
    to = free.join(room.select("right", *first), "right", "inner" if first else "left_semi")
    made = top_k_by_column(to, lacking.select("left", "k"), ["left"], order, "k", most=most[0]).select("left", "right", "h")
    if first:
        made = made.join(lacking.select("left", *first), "left")
    return top_k_by_column(made, room.select("right", "k"), ["right"], order, "k", most=most[1]).select("left", "right", "h", "rank")


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def _with_spare(limits: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``limits (key, k)`` of the nodes with open edges, and how many of these they have to ``spare``."""
    degree = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return limits.join(degree, key).select(key, "k", (F.col("_n") - F.col("k")).alias("spare"))


def largest_match(edges: DataFrame, need: DataFrame, room: DataFrame) -> DataFrame:
    """A largest subset of ``edges (left, right, h)`` with at most ``need (left, k)`` edges of a left
    and ``room (right, k)`` of a right node. Edges are distinct; ties go by ``h`` and the names."""
    edges = _kept(edges.select("left", "right", "h").join(need.select("left"), "left", "left_semi").join(room.select("right"), "right", "left_semi"))
    most = largest_limit(need, "k"), largest_limit(room, "k")
    matched = _proposed(edges, need, room, most)
    while True:
        free = _kept(edges.join(matched, ["left", "right"], "left_anti"))
        lacking, spare = _kept(left_over(need, "left", matched)), _kept(left_over(room, "right", matched))
        nearer = _distances(free, matched, lacking, spare)
        if nearer is None:
            return matched
        matched = _exchanged(free, matched, lacking, spare, most, *nearer)


def _proposed(edges: DataFrame, need: DataFrame, room: DataFrame, most: tuple[int, int]) -> DataFrame:
    """The matching after rounds of proposals along ``active`` edges: of left nodes that lack and right nodes with room."""
    matched, active = edges.where("false"), edges
    lacking, spare = need, room
    while not active.isEmpty():
        taken = _offers(active, _with_spare(lacking, "left", active), _with_spare(spare, "right", active), most, ("spare",))
        matched = _kept(matched.unionByName(taken.drop("rank")))
        lacking, spare = left_over(need, "left", matched), left_over(room, "right", matched)
        rest = active.join(matched, ["left", "right"], "left_anti")
        active = _kept(rest.join(lacking.select("left"), "left", "left_semi").join(spare.select("right"), "right", "left_semi"))
    return matched


def _distances(free, matched, lacking, spare) -> tuple[DataFrame, DataFrame, int] | None:
    """(distances of left nodes, of right nodes, that of the nearest left nodes that lack partners); None if none is reached."""
    rights = reached = spare.select("right", F.lit(0).alias("d"))
    lefts, step = None, 1
    while True:
        new = free.join(reached.select("right"), "right", "left_semi").select("left").distinct()
        if lefts is not None:
            new = new.join(lefts, "left", "left_anti")
        new = _kept(new.join(lacking.select("left", F.lit(True).alias("lacks")), "left", "left"))
        found = new.agg(F.count(F.lit(1)).alias("n"), F.count("lacks").alias("lacks")).first()
        if not found["n"]:
            return None
        new = new.select("left", F.lit(step).alias("d"))
        lefts = new if lefts is None else lefts.unionByName(new)
        if found["lacks"]:
            return lefts, rights, step
        reached = matched.join(new.select("left"), "left", "left_semi").select("right", F.lit(step + 1).alias("d")).distinct()
        reached = _kept(reached.join(rights, "right", "left_anti"))
        if reached.isEmpty():
            return None
        rights, step = rights.unionByName(reached), step + 2
        if step % (2 * FOLD) == 1:
            lefts, rights = _kept(lefts), _kept(rights)


def _exchanged(free, matched, lacking, spare, most: tuple[int, int], lefts: DataFrame, rights: DataFrame, step: int) -> DataFrame:
    """The matching after offers from distance ``step`` down to the nodes with room."""
    asking = lacking.join(lefts.where(F.col("d") == step).select("left"), "left", "left_semi")
    added = let_go = matched.where("false")
    while step > 1:
        to = rights.where(F.col("d") == step - 1).select("right")
        partners = _kept(matched.join(lefts.where(F.col("d") == step - 2).select("left"), "left", "left_semi").join(to, "right", "left_semi"))
        may_go = partners.groupBy("right").agg(F.count(F.lit(1)).alias("k"))
        taken = _kept(_offers(free, asking, may_go, most))
        ranked = top_k(partners, ["right"], [F.col(c) for c in ORDER], most[1])
        gone = _kept(ranked.join(taken.select("right", "rank"), ["right", "rank"], "left_semi").select("left", "right", "h"))
        added, let_go = added.unionByName(taken.drop("rank")), let_go.unionByName(gone)
        asking, step = gone.groupBy("left").agg(F.count(F.lit(1)).alias("k")), step - 2
        if step % (2 * FOLD) == 1:
            added, let_go = _kept(added), _kept(let_go)
    added = added.unionByName(_offers(free, asking, spare, most).drop("rank"))
    return _kept(matched.join(let_go, ["left", "right"], "left_anti").unionByName(added))
