import random
import re

import license_notices
import pytest
from llm_cases import docs, edge, empty

from regulon.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache,apache-2.0",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
    "under the terms of the GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "available under the license": "unknown",
    "Mit und mit Lizenz": "",
    "summit licensees apache licenses": "",
}


@pytest.mark.parametrize("text", TEXTS)
def test_labels(text):
    assert licenses.scan(text)[5] == TEXTS[text]


def test_rules_are_many_and_gated():
    rules = [r for group in licenses.rules().values() for _, r in group]
    assert len(rules) > 300 and all(r.keywords and all(r.keywords) for r in rules)


NAMED = {
    "Released under the GNU GPL": "gpl",
    "released under the GNU GPL v2": "gpl-2.0",
    "Distributed under the GNU LGPL 2.1, or the GNU AGPLv3": "agpl-3.0,lgpl-2.1",  # an identifier with a number needs no grant
    "License: GNU AGPLv3": "agpl-3.0",
    "The Expat License": "mit",
    "Licensed under MIT-0.": "mit-0",
    "PSF License 2": "python-2.0",
    "published under ASL 2.0": "apache-2.0",
    "available under Public Domain Mark 1.0": "cc-pdm-1.0",
    "BigScience Open RAIL-M license": "openrail",
    "Copying: zlib": "zlib",
    "see COPYING for details": "unknown",
    "The manual is free documentation": "",
    "Microsoft public relations on Apache 2.4": "",
}


@pytest.mark.parametrize("text", NAMED)
def test_names_are_found_without_other_words(text):
    assert licenses.scan(text)[5] == NAMED[text]


def test_notices_get_their_labels():
    notices = license_notices.notices()
    assert len(notices) >= 200
    wrong = [(text, licenses.scan(text)[5], label) for text, label in notices if licenses.scan(text)[5] != label]
    assert not wrong


def test_ordinary_texts_get_none():
    texts = license_notices.ordinary()
    assert len(texts) >= 50
    assert [(t, licenses.scan(t)[5]) for t in texts if licenses.scan(t)[5]] == []


def test_one_pass_opens_the_gates_that_searches_open():
    rng = random.Random(2)
    words = [w for gate in licenses.rules() for group in gate for w in group]
    for text in [*(t for t, _ in license_notices.notices()), *(b" ".join(rng.choices(words, k=8)).decode() for _ in range(300))]:
        norm = licenses.decontam.normalise(text)
        want = {gate for gate in licenses.rules() if all(any(w in norm for w in group) for group in gate)}
        assert set(licenses.open_gates(norm)) == want


def sample(parsed, rng):
    """A text that the parsed pattern matches."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, one = rng.choice(value)
            out += chr(one if str(kind) == "LITERAL" else rng.randint(*one))
        elif name == "SUBPATTERN":
            out += sample(value[-1], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif name == "MAX_REPEAT":
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        else:
            assert name == "ASSERT", name  # the spaces around a rule's words
    return out


def test_every_text_of_a_rule_passes_its_gate():
    rng = random.Random(4)
    for group in licenses.rules().values():
        for _, rule in group:
            parsed = re._parser.parse(rule.pattern.pattern.decode())
            for _ in range(60):
                norm = f" {sample(parsed, rng)} ".encode()
                assert rule.pattern.search(norm), (rule, norm)
                if rule.label in licenses.ORDINARY and rule.priority == 65:
                    norm += b"license "
                assert all(any(k in norm for k in words) for words in rule.keywords), (rule, norm)


def all_detections(norm):
    return [(m.start(), m.end(), r, k) for g in licenses.rules().values() for k, r in g for m in r.pattern.finditer(norm)]


def test_gate_and_suppression_against_brute_force():
    text = " ".join(TEXTS) + " Copyright (c) 2020 all rights reserved MIT license apache license version 2 0 license mit"
    norm = licenses.decontam.normalise(text)
    found = sorted(all_detections(norm), key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[3]))
    taken = []
    for a, b, r, _ in found:  # better ones first; inside one that stands: goes
        if not any(x <= a and b <= y for x, y, _ in taken):
            taken.append((a, b, r))
    strong = [(a, b) for a, b, r in taken if r.priority > licenses.CLUE]
    want = sorted((a, b, r.label) for a, b, r in taken if r.priority > licenses.CLUE or not any(a < y and x < b for x, y in strong))
    assert [(a, b, r.label) for a, b, r in licenses.detections(norm)] == want and len(want) > 8


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark):
    texts = ["MIT license mit-license; MIT\nLicense", "general public licenseé general Public LICENSE", *TEXTS, None, "", "mit " * 3 + "license"]
    got = {r["doc_id"]: r for r in licenses.license_labels(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_base(t)
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(filter(None, got[i]["labels"].split(",")))
        assert 0 <= got[i]["score"] <= 1


def test_detections_name_their_words():
    spans = licenses.scan("Foo. Licensed under the Apache License, Version 2.0!")[7]
    assert [(s["label"], s["word"], s["n_words"]) for s in spans] == [("apache-2.0", 1, 7 + 1)]


def test_edges(spark):
    df = edge(spark)
    assert licenses.license_labels(df).count() == df.count()
    assert licenses.license_labels(empty(spark)).count() == 0
