"""Degree-constrained matches against augmenting paths on many small graphs at once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from regulon.operators import datasets as D
from regulon.operators import matching as M
from regulon.operators.matching import largest_match


def largest(edges, need, room):
    """Size of a largest match: one augmenting path after the other."""
    partners = {r: set() for r in room}
    count = 0

    def give(left, seen):
        for right in sorted(r for x, r in edges if x == left and r in room and left not in partners[r]):
            if right in seen:
                continue
            seen.add(right)
            if len(partners[right]) < room[right]:
                partners[right].add(left)
                return True
            for other in sorted(partners[right]):
                if give(other, seen):
                    partners[right].discard(other)
                    partners[right].add(left)
                    return True
        return False

    for left in sorted(need):
        for _ in range(need[left]):
            if give(left, set()):
                count += 1
    return count


def graphs(n):
    """Disjoint random graphs with node names that start with their number; some make greedy choices fail."""
    rng = random.Random(5)
    edges, need, room = [], {}, {}
    for g in range(n):
        a, b = rng.randint(1, 6), rng.randint(1, 6)
        for i in range(a):
            need[f"{g}-l{i}"] = rng.randint(1, 3)
        for j in range(b):
            room[f"{g}-r{j}"] = rng.randint(1, 2)
        p = rng.choice([0.2, 0.4, 0.7])
        edges += [(f"{g}-l{i}", f"{g}-r{j}") for i in range(a) for j in range(b) if rng.random() < p]
    for g in range(n, n + 3):  # chains: every left but the last could take its neighbour's only partner
        k = g - n + 2
        for i in range(k):
            need[f"{g}-l{i}"] = room[f"{g}-r{i}"] = 1
            edges += [(f"{g}-l{i}", f"{g}-r{j}") for j in (i, i + 1) if j < k]
    return edges, need, room


def test_as_many_edges_as_can_be(spark):
    edges, need, room = graphs(24)
    e = spark.createDataFrame(edges, "left string, right string").withColumn("h", F.md5(F.concat("left", "right"))).repartition(4)
    n, r = (spark.createDataFrame(list(x.items()), f"{c} string, k long") for x, c in ((need, "left"), (room, "right")))
    got = [(x["left"], x["right"]) for x in largest_match(e, n, r).collect()]
    assert len(set(got)) == len(got) and set(got) <= set(edges)
    assert all(k <= need[x] for x, k in Counter(x for x, _ in got).items())
    assert all(k <= room[x] for x, k in Counter(x for _, x in got).items())
    found = Counter(x.split("-")[0] for x, _ in got)
    for g in {x.split("-")[0] for x in need}:
        mine = lambda d: {k: v for k, v in d.items() if k.split("-")[0] == g}  # noqa: B023, E731
        assert found[g] == largest([x for x in edges if x[0].split("-")[0] == g], mine(need), mine(room)), g
    # passes: overshoot is no more than it must be, and shortfalls only where candidates end
    rows = [tuple(x) for x in D._match_in_passes(e, n, r).collect()]
    assert len({x[:2] for x in rows}) == len(rows)
    lefts, rights = Counter(x[0] for x in rows), Counter(x[1] for x in rows)
    degree = Counter(x for x, _ in edges)
    assert all(lefts[x] >= min(k, degree[x]) for x, k in need.items())
    degree = Counter(x for _, x in edges)
    assert all(rights[x] >= min(k, degree[x]) for x, k in room.items())
    over = sum(max(0, rights[x] - k) for x, k in room.items())
    degree = Counter(x for x, _ in edges)
    assert over == sum(min(k, degree[x]) for x, k in need.items()) - len(got)


def test_nothing_to_match(spark):
    e = spark.createDataFrame([], "left string, right string, h string")
    n = spark.createDataFrame([("a", 2)], "left string, k long")
    r = spark.createDataFrame([("b", 1)], "right string, k long")
    assert largest_match(e, n, r).count() == 0


def tables(spark, edges, need, room):
    e = spark.createDataFrame(edges, "left string, right string").withColumn("h", F.md5(F.concat("left", "right"))).repartition(4)
    n, r = (spark.createDataFrame(list(x.items()), f"{c} string, k long") for x, c in ((need, "left"), (room, "right")))
    return e, n, r


def test_exchanges_alone_reach_the_largest_match(spark, monkeypatch):
    """From an empty matching, with unions of tables written after every step."""
    edges, need, room = graphs(10)
    monkeypatch.setattr(M, "_proposed", lambda edges, need, room, most: edges.where("false"))
    monkeypatch.setattr(M, "FOLD", 1)
    got = [(x["left"], x["right"]) for x in largest_match(*tables(spark, edges, need, room)).collect()]
    assert len(set(got)) == len(got) == largest(edges, need, room) and set(got) <= set(edges)
    assert all(k <= need[x] for x, k in Counter(x for x, _ in got).items())
    assert all(k <= room[x] for x, k in Counter(x for _, x in got).items())


def test_proposals_leave_little_to_exchange(spark, monkeypatch):
    """Needs and rooms are nearly equal, and edges few: taken in the order of h alone they need many exchanges."""
    rng = random.Random(3)
    need = {f"l{i}": 9 for i in range(100)}
    room = {f"r{j}": rng.choice([1, 1, 1, 2]) for j in range(700)}
    edges = sorted({(f"l{rng.randrange(100)}", f"r{rng.randrange(700)}") for _ in range(1650)})
    passes, exchanged = [], M._exchanged
    monkeypatch.setattr(M, "_exchanged", lambda *a: passes.append(1) or exchanged(*a))
    assert largest_match(*tables(spark, edges, need, room)).count() == largest(edges, need, room)
    assert not passes
