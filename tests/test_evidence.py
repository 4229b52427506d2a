"""Golden texts for the evidence lookups on a small labelled table."""

from regulon.operators import evidence as EV
from regulon.operators.ranking import range_parts, row_numbers


def _train(spark):
    rows = [("Irf1", "Actb", "up"), ("irf1", "Gapdh", "none"), ("Irf1", "Cd14", "down"), ("Stat1", "Actb", "none")]
    return spark.createDataFrame(rows, "pert string, gene string, label string")


def test_pert_evidence(spark):
    q = spark.createDataFrame([("IRF1",), ("Nope",)], "q string")
    got = {r["q"]: r["text"] for r in EV.pert_evidence(_train(spark), q).collect()}
    assert got["IRF1"] == (
        "Training data for perturbation 'IRF1' (3 examples):\n"
        "  Summary: 1 up-regulated, 1 down-regulated, 1 not differentially expressed\n"
        "    Up-regulated: Actb\n    Down-regulated: Cd14\n    Not differentially expressed: Gapdh")
    assert got["Nope"] == "No training examples found for perturbation 'Nope'."


def test_gene_evidence(spark):
    q = spark.createDataFrame([("actb",)], "q string")
    text = EV.gene_evidence(_train(spark), q).first()["text"]
    assert text == ("Training data for target gene 'actb' (2 examples):\n"
                    "  - pert=Irf1: up-regulated\n  - pert=Stat1: not differentially expressed")


def test_pair_evidence(spark):
    q = spark.createDataFrame([("1", "IRF1", "actb"), ("2", None, "ACTB"), ("3", "x", None)], "qid string, pert string, gene string")
    got = {r["qid"]: r["text"] for r in EV.pair_evidence(_train(spark), q).collect()}
    assert got["1"] == "Found 1 training example(s):\n  - pert=Irf1, gene=Actb, label=up (up-regulated)"
    assert got["2"].startswith("Found 2 training example(s):") and "label=none (no significant effect)" in got["2"]
    assert got["3"] == "No training examples found for pert=x."


def test_annotation_and_interactions(spark):
    ann = spark.createDataFrame(
        [("Actb", "actin beta", "", [{"term": "b"}, {"term": "a"}, {"term": "b"}], [{"id": "k1", "name": None}, {"id": None, "name": None}])],
        "symbol string, name string, summary string, go_bp array<struct<term:string>>, kegg array<struct<id:string,name:string>>")
    q = spark.createDataFrame([("Actb",), ("Zzz",)], "q string")
    got = {r["q"]: r["text"] for r in EV.gene_annotation(ann, q).collect()}
    assert got["Actb"] == "Gene: Actb\nFull name: actin beta\nGO Biological Process (2 shown): a; b\nKEGG Pathways: k1; ?"
    assert got["Zzz"] == "No results found for gene symbol 'Zzz' in mouse."
    edges = spark.createDataFrame([("Actb", "P1", 0.9), ("Actb", "P2", 0.95), ("Actb", "P0", 0.9)], "gene string, partner string, score double")
    text = EV.top_interactions(edges, q.where("q = 'Actb'"), limit=2).first()["text"]
    assert text.splitlines()[1:] == ["  - P2 (combined score: 0.950)", "  - P0 (combined score: 0.900)"]


def test_lookups_without_keys_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(EV, "PART_LINES", 2)
    q = spark.createDataFrame([("n", None, None), ("e", "", ""), ("p", "IRF1", ""), ("g", None, "zzz")], "qid string, pert string, gene string")
    train = _train(spark).unionByName(spark.createDataFrame([("Irf1", "Zeb", "Odd")], "pert string, gene string, label string"))
    rows = sorted((tuple(r) for r in EV.pair_evidence(train, q).collect()))
    assert rows == [
        ("e", 0, 0, EV.LOOKUP_ERROR),
        ("g", 0, 0, "No training examples found for gene=zzz."),
        ("n", 0, 0, EV.LOOKUP_ERROR),
        ("p", 4, 0, "Found 4 training example(s):\n  - pert=Irf1, gene=Actb, label=up (up-regulated)\n"
                    "  - pert=Irf1, gene=Cd14, label=down (down-regulated)"),
        ("p", 4, 1, "  - pert=Irf1, gene=Zeb, label=Odd (odd)\n  - pert=irf1, gene=Gapdh, label=none (no significant effect)"),
    ]


def test_a_hot_key_is_spread_over_the_tasks(spark):
    """One perturbation and one gene hold a third of all pairs each: answers equal a plain version, and no range is large."""
    import random

    rnd = random.Random(6)
    rows = [("Hot", f"g{i}", rnd.choice(["up", "down", "none", "odd"])) for i in range(6000)]
    rows += [(f"p{i}", "Top", rnd.choice(["up", "down", "none"])) for i in range(6000)]
    rows += [(f"p{rnd.randrange(300)}", f"g{rnd.randrange(300)}", "none") for _ in range(6000)]
    train = spark.createDataFrame(rows, "pert string, gene string, label string").repartition(8)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["count"] for r in range_parts(train.select("gene", "pert", "label"), ["gene", "pert"]).groupBy("part").count().collect()]
        assert max(sizes) < 4 * sum(sizes) / 40  # a third of the rows would be 13 shares
        ranked = row_numbers(train, ["gene"], ["pert", "label"]).collect()
        texts = EV.gene_evidence(train, spark.createDataFrame([("top",), ("g5",)], "q string")).collect()
        pert = EV.pert_evidence(train, spark.createDataFrame([("hot",)], "q string")).first()
        pair = EV.pair_evidence(train, spark.createDataFrame([("a", "hot", None), ("b", "P7", "top")], "qid string, pert string, gene string")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_gene = {}
    for r in ranked:
        by_gene.setdefault(r["gene"], []).append((r["rank"], r["pert"], r["label"]))
    assert sum(map(len, by_gene.values())) == len(rows)
    for gene, got in by_gene.items():
        want = sorted((p, lab) for p, g, lab in rows if g == gene)
        assert sorted(got) == [(k + 1, *x) for k, x in enumerate(want)]
    lines = {}
    for r in sorted(texts, key=lambda r: r["part"]):
        lines.setdefault(r["q"], []).extend(r["text"].splitlines()[1 if r["part"] == 0 else 0 :])
        assert r["n_examples"] == sum(g.lower() == r["q"] for _, g, _ in rows)
    assert lines["top"] == [f"  - pert={p}: {EV.LABEL_STR[lab]}" for p, lab in sorted((p, lab) for p, g, lab in rows if g == "Top")]
    genes = {lab: sorted(g for p, g, x in rows if p == "Hot" and x == lab) for lab in ("up", "down", "none")}
    assert pert["n_examples"] == 6000 and pert["text"].splitlines()[1] == EV.PERT_SUMMARY % tuple(len(genes[k]) for k in ("up", "down", "none"))
    assert pert["text"].splitlines()[2] == EV.PERT_LIST_HEAD["up"] + ", ".join(genes["up"][:30])
    assert {r["qid"]: r["n_examples"] for r in pair} == {"a": 6000, "b": 1}
    assert max(r["part"] for r in pair) == 5


def test_lookups_that_ask_the_same_are_found_once(spark, monkeypatch):
    asked, real = [], EV.lookup_ci
    monkeypatch.setattr(EV, "lookup_ci", lambda train, queries: (asked.append(queries.count()), real(train, queries))[1])
    q = spark.createDataFrame([(f"q{i}", "IRF1" if i % 2 else "irf1", "" if i % 3 else None) for i in range(40)]
                              + [("two", "stat1", None), ("two", "Irf1", "cd14"), (None, "Irf1", None), ("none", "x", None)],
                              "qid string, pert string, gene string")
    rows = EV.pair_evidence(_train(spark), q).collect()
    assert asked == [4]  # one question of the forty, the two of "two", and "none"
    line = "  - pert=%s, gene=%s, label=%s (%s)"
    lines = [line % x for x in [("Irf1", "Actb", "up", "up-regulated"), ("Irf1", "Cd14", "down", "down-regulated"),
                                ("irf1", "Gapdh", "none", "no significant effect")]]
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((r["n_examples"], r["part"], r["text"]))
    assert all(got[f"q{i}"] == [(3, 0, "\n".join(["Found 3 training example(s):", *lines]))] for i in range(40))
    both = "\n".join(["Found 2 training example(s):", lines[1], line % ("Stat1", "Actb", "none", "no significant effect")])
    assert got["two"] == [(2, 0, both)] * 2
    assert got[None] == [(0, 0, "No training examples found for pert=Irf1.")]
    assert got["none"] == [(0, 0, "No training examples found for pert=x.")]
