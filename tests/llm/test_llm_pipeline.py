"""The pipeline against a plain version of its five stages."""

import importlib.util
import os
import random
import zlib

import corpus_pipeline
from llm_cases import docs, edge, empty
from test_llm_decontam import brute as brute_hits
from test_llm_simhash import brute_components, brute_fingerprint
from test_llm_suffix import brute as brute_spans

from regulon.llm import quality, tokens

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(n))


def sample():
    rng = random.Random(11)
    item, passage = prose(rng, 30), prose(rng, 70)
    texts = [prose(rng, 120) for _ in range(12)]
    texts += [texts[0], texts[1].upper(), texts[2] + " end", "too short", None, "", ("spam ham " * 60).strip()]
    texts += [f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}" for _ in range(4)]
    texts += [f"{prose(rng, 60)} {item.upper()} {prose(rng, 60)}"]
    return texts, item, passage


def plain_pipeline(texts, items):
    kept = dict(enumerate(texts))
    verdicts = dict(zip(kept, quality.judge(list(kept.values()), quality.Rules())))
    kept = {i: t for i, t in kept.items() if verdicts[i][-1]}
    ids = list(kept)
    first = brute_components(ids, [brute_fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for i in sorted(set(first))}
    gone = brute_spans(list(kept.items()), 100)
    kept = {i: "".join(c for c, g in zip(t, gone[i, zlib.crc32(t.encode())]) if not g) for i, t in kept.items()}  # ASCII
    kept = {i: t for i, t in kept.items() if not brute_hits(t, items)[-1]}
    encode = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"))
    return {i: encode.whole(t) + (1).to_bytes(4, "little") for i, t in kept.items()}


def test_against_plain_version(spark, tmp_path):
    texts, item, passage = sample()
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = plain_pipeline(texts, [(1, item)])
    assert {r["doc_id"] for r in pieces} == set(want) and len(want) == 12 + 4
    for r in pieces:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) // 4
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    for i, ids in want.items():
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == len(ids) // 4
    at = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in pieces)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for make in (edge, empty):
        df = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            assert out.columns == df.columns and len(rows) <= df.count(), name
            assert all(r[4] is None or name != "suffix_dedup" or r[4] == len(r[1]) for r in rows if r[1] is not None)
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() >= df.count()


def test_registered_queries_are_there():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    spec = importlib.util.find_spec("corpus_pipeline")
    assert os.path.dirname(spec.origin) == os.path.dirname(entry.__file__)
