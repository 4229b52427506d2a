"""Piecewise ids, packing and token files against the library's own encoding."""

import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import docs, edge, empty
from pyspark.sql import functions as F

from regulon.llm import common, packing, repair, tokens

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_pieces_encode_like_the_whole_text(name):
    rng = random.Random(5)
    bits = list("ab cd'st \n\n\t  .,!3é½²İßж´’  -_#1\x1f\x85") + [" the", " don't", "'ll", "\r\n", "   ", "<|endoftext|>", "é"]
    latin = list("abcé  \n.,;3-_ßÑ") + ["\n\n", " \n", "\n ", "  ", " the"]
    encode = tokens.encoder(tokens.vocabulary(name))
    for alphabet in (bits, latin):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
        for text, ids in zip(texts, encode(texts)):
            assert ids == (encode.whole(text) if text else b""), text


@pytest.mark.parametrize("name", VOCABULARIES)
def test_added_tokens_encode_like_a_freshly_loaded_tokenizer(name, monkeypatch):
    fresh = tokenizers.Tokenizer.from_file(tokens.vocabulary(name))
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]
    bits = [*added, "<", "a", " b", "  ", " ", "\n", "é", "e\u0301", "\u0301", "İ", "日", "'s", " don't", "1", ", "]
    rng = random.Random(8)
    texts = ["end of one <|endoftext|> next", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000))]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (tokens.PART_BYTES, 40):
        monkeypatch.setattr(tokens, "PART_BYTES", size)
        encode = tokens.Encoder(tokens.vocabulary(name))
        assert encode(texts) == want and [encode.whole(t) for t in texts] == want


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 50)
    encode = tokens.Encoder(tokens.vocabulary(VOCABULARIES[0]))
    rng = random.Random(2)
    texts = ["".join(rng.choices(["word ", "don't ", "x, ", "  ", "\n\n", "é"], k=rng.randint(0, 200))) for _ in range(50)]
    assert encode(texts) == [encode.whole(t) if t else b"" for t in texts]
    assert max(len(tokens.parts(t)) for t in texts) > 5


@pytest.mark.parametrize("name", VOCABULARIES)
def test_texts_whose_hashes_clash_get_their_own_ids(name):
    """A run over two letters after the rule of Thue and Morse has the polynomial hash of its complement, whatever the factor."""
    fresh = tokenizers.Tokenizer.from_file(tokens.vocabulary(name))
    pairs = []
    for n in (64, 256, 1024, 2048):
        run = "".join("ab"[k.bit_count() % 2] for k in range(n))
        pairs += [run, run.translate(str.maketrans("ab", "ba")), f"one {run} two"]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in pairs]
    for order in (1, -1):
        encode = tokens.Encoder(tokens.vocabulary(name))
        assert [encode([t])[0] for t in pairs[::order]] == want[::order]  # one worker, one text after the other
        assert encode(pairs[::order]) == want[::order]
        encode.forget()
        assert encode(pairs[::order]) == want[::order]


def test_equal_hashes_are_noticed(monkeypatch):
    class Same(tokens.Prefix):
        def of(self, start, end):
            return np.zeros(len(start), np.uint64)

    encode = tokens.Encoder(tokens.vocabulary(VOCABULARIES[0]))
    monkeypatch.setattr(tokens, "Prefix", Same)
    long = "x" * 200
    for texts in (["one"], ["two three"], ["one", "two"], [long], [long[1:] + "y"]):
        assert encode(texts) == [encode.whole(t) for t in texts]


def test_memo_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 3)
    encode = tokens.Encoder(tokens.vocabulary(VOCABULARIES[0]))
    monkeypatch.setattr(tokens, "MEMO_OTHERS", 3)
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20)
    for text in ["a b c d e f", "a b x y", "", None, "a a a", "don't do a b c", "it's"]:
        assert encode([text]) == [encode.whole(text) if text else b""]


def expected(spark, df, name, end):
    encode = tokens.encoder(tokens.vocabulary(name))
    return [(r["doc_id"], encode.whole(r["text"] or "") + end.to_bytes(4, "little")) for r in common.pick(df, doc_id="long", text="string").collect()]


def test_packing(spark):
    df = edge(spark)
    got = [r.asDict() for r in packing.pack(df, length=64).collect()]
    want = expected(spark, df, "word_bpe_49k.json", 1)
    # windows are full but for the last, and gapless from 0
    by_window = {}
    for r in got:
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_window) == list(range(len(by_window)))
    for k, rows in by_window.items():
        rows.sort(key=lambda r: r["offset"])
        at = 0
        for r in rows:
            assert r["offset"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at == 64 or k == len(by_window) - 1
    # each document's pieces make up its ids (rows equal in id: as many times)
    texts = sorted(str((i, x.hex())) for i, x in want)
    stream = b"".join(r["ids"] for k in sorted(by_window) for r in by_window[k])
    assert len(stream) == sum(len(x) for _, x in want)
    rebuilt, held = [], b""
    for r in (r for k in sorted(by_window) for r in by_window[k]):
        assert r["start"] == len(held) // 4
        held += r["ids"]
        if len(held) == 4 * r["doc_tokens"]:
            rebuilt.append(str((r["doc_id"], held.hex())))
            held = b""
    assert sorted(rebuilt) == texts
    assert packing.pieces(empty(spark)).count() == 0


def test_sequences_are_padded(spark):
    packed = packing.pack(docs(spark, ["one two three four five", "six"]), length=16)
    rows = packing.sequences(packed, length=16, pad_id=7).collect()
    for r in rows:
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 16)
        assert r["ids"][4 * n :] == (7).to_bytes(4, "little") * (len(r["ids"]) // 4 - n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_grammar_round_trip_and_ranges(ids, a, b):
    seq = np.array(ids, np.uint32)
    grammar = repair.Grammar(repair.compress(seq, rounds=12, min_count=2))
    assert len(grammar) == len(seq)
    a, b = sorted((min(a, len(seq)), min(b, len(seq))))
    assert grammar.ids(0, len(seq)).tolist() == ids and grammar.ids(a, b).tolist() == ids[a:b]


def test_rules_name_only_earlier_symbols_and_compress():
    seq = np.tile(np.arange(50, dtype=np.uint32), 400)
    data = repair.compress(seq)
    grammar = repair.Grammar(data)
    assert len(data) < len(seq) and len(grammar.symbols) < len(seq) / 8
    for k, (x, y) in enumerate(zip(grammar.left.tolist(), grammar.right.tolist())):
        assert max(x, y) < grammar.base + k
    with pytest.raises(ValueError):
        repair.Grammar(b"nope" + data[4:])


def test_rules_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 5000, 701).astype(np.uint32)
    noise = [rng.integers(0, 5000, n).astype(np.uint32) for n in rng.integers(1, 40, 200)]
    for seq in (np.tile(passage, 200), np.concatenate([x for n in noise for x in (n, passage)]), np.zeros(5000, np.uint32)):
        grammar = repair.Grammar(repair.compress(seq))
        assert (grammar.ids(0, len(seq)) == seq).all() and grammar.size.max() >= 256 and len(grammar.symbols) < len(seq) / 10
        pairs = np.stack([grammar.symbols[:-1], grammar.symbols[1:]])
        assert len(pairs.T) == 0 or np.unique(pairs, axis=1, return_counts=True)[1].max() < repair.MIN_COUNT


def test_token_files(spark):
    df = edge(spark)
    path = repair.scratch_path(spark, "test-ids")
    repair.write_ids(df, path, block_ids=500)
    rows = [r.asDict() for r in repair.read_ids(spark, path).collect()]
    want = sorted(expected(spark, df, "byte_bpe_50k.json", 0), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(str((r["doc_id"], bytes(r["ids"]).hex())) for r in rows) == sorted(str((i, x.hex())) for i, x in want)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in want]  # ascending, null first
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    digest = {r["start"]: r for r in repair.token_files(df).collect()}
    assert {k: r["ids_crc32"] for k, r in digest.items()} == {r["start"]: zlib.crc32(r["ids"]) for r in rows}
    assert repair.token_files(empty(spark)).count() == 0
    blocks = repair.blocks(df, block_ids=500).agg(F.max(F.size("doc_ids")), F.count("*")).first()
    assert blocks[1] > 3
