from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import PASSAGE, by_id, docs, edge, empty

from regulon.llm import quality


def longest_at(words, i):
    """Brute force: the longest repeat of the text that starts at word i."""
    best = 0
    for j in range(len(words)):
        n = 0
        while j != i and i + n < len(words) and j + n < len(words) and words[i + n] == words[j + n]:
            n += 1
        best = max(best, n)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=4))
def test_longest_repeats_against_brute_force(texts):
    ids, doc, base = [], [], 0
    for k, words in enumerate(texts):
        ids += [base + "abc".index(w) for w in words]
        doc += [k] * len(words)
        base += 3
    ids, doc = np.array(ids, int), np.array(doc, int)
    found = quality.longest_repeats(ids, doc)
    assert found.tolist() == [longest_at(w, i) for w in texts for i in range(len(w))]


def test_ids_may_skip_numbers():
    assert quality.longest_repeats(np.array([5, 9, 5, 9]), np.zeros(4, int)).tolist() == [2, 1, 2, 1]


def repeated(words, m):
    windows = [tuple(words[i : i + m]) for i in range(len(words) - m + 1)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    return len({p for i, w in enumerate(windows) if w in twice for p in range(i, i + m)})


def test_counts_and_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    texts = {
        1: clean,
        2: clean + " " + clean,  # all of it twice: base rule
        3: clean + " " + " ".join(f"w{i}" for i in range(20)) + " end",  # under the base rule, over the covered share
        4: " ".join(f"v{i}" for i in range(2000)) + " " + " ".join(f"v{i}" for i in range(250)),  # one repeat too long
        5: "a#b *c\nsame line\n\nsame line\n  \n same line " + clean,
        6: "short",
    }
    got = by_id(quality.quality_rules(docs(spark, list(texts.items()))))
    for i, t in texts.items():
        words = t.split()
        assert got[i]["n_words"] == len(words)
        assert got[i]["word_chars"] == sum(map(len, words))
        assert got[i]["n_repeat_words"] == repeated(words, 3)
        assert got[i]["covered_words"] == repeated(words, 10)
    assert [got[i]["kept"] for i in range(1, 7)] == [True, False, False, False, True, False]
    assert [got[i]["base_failed"] for i in range(1, 7)] == [False, True, False, False, False, True]
    assert got[4]["longest_repeat"] == 250
    assert (got[5]["n_symbols"], got[5]["n_dup_lines"]) == (2, 1)


def test_edges(spark):
    df = edge(spark)
    rows = quality.quality_rules(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["n_words"] == 0 and got[i]["base_failed"] for i in (1, 2, 3))
    assert got[8]["longest_repeat"] == 15_000 and not got[8]["kept"]
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"]) != []
    assert quality.quality_rules(empty(spark)).count() == 0 and quality.keep(empty(spark)).count() == 0
    assert PASSAGE in {r[1][-len(PASSAGE) :] for r in kept.collect()}
