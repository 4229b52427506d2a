"""License scans by ordered signature rules.

A document is normalised to plain words joined by single spaces (see ``common``)
and scanned by several hundred regular expressions. The families below are
written by hand; each gives a rule for every way of naming it that is listed
(an SPDX tag, a grant notice, a title, a metadata field, "X licensed", its own phrases),
and identifiers with a number and names that mean nothing else stand for themselves.

1. Gate: a rule runs only on a text that holds the words every match of it must
   hold, which one Aho-Corasick pass over the text finds out. They are read off the
   rule's own pattern, so a gate hides no match. Most texts run no rule at all.
2. Order: detections rank by priority, then length, then place in the list.
3. Suppression: a detection whose interval lies inside that of a better one goes.
   So "licensed under the apache license version 2 0" is one detection and the
   title inside it is none. Clues (priority ``CLUE`` or less) go already if they
   overlap anything better.

The base phrases are found besides, at every place; their labels always stay.

``score`` is 1 - product of (1 - priority / 100) over the taken detections, and
base places count as priority 50: 0 without any.

Defined cases: null and empty texts have no words; repeated rows each get a row;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, decontam

# Base phrases and their labels (fixed by the contract).
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
BASE_PRIORITY = 50
CLUE = 20

# Families: label | SPDX words | names | phrases of its own.
# Names and phrases are regular expressions over lower-case words; "L" stands for
# licence in either spelling. Several are divided by ";".
FAMILIES = r"""
mit | mit | (?:mit|expat)(?: x11)? | permission is hereby granted free of charge to any person obtaining a copy of this software; opensource org licenses mit
mit-0 | mit 0 | mit(?: no attribution| 0) | opensource org licenses mit 0
x11 | x11 | x11 | x consortium
apache-1.0 | apache 1 0 | apache(?: software)?(?: L)?(?: version| v)? ?1 0 | apache org licenses license 1 0
apache-1.1 | apache 1 1 | apache(?: software)?(?: L)?(?: version| v)? ?1 1 | apache org licenses license 1 1
apache-2.0 | apache 2 0 | (?:apache|asl)(?: software)?(?: L)?(?: version| v)? ?2(?: 0)? | apache org licenses license 2 0; opensource org licenses apache 2 0
gpl-1.0 | gpl 1 0(?: only| or later)? | (?:gnu )?gpl(?: version| v)? ?v?1(?: 0)? | gnu org licenses(?: old licenses)? gpl 1 0
gpl-2.0 | gpl 2 0(?: only| or later)? | (?:gnu )?gpl(?: version| v)? ?v?2(?: 0)? | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3.0 | gpl 3 0(?: only| or later)? | (?:gnu )?gpl(?: version| v)? ?v?3(?: 0)? | gnu org licenses gpl(?: 3 0)?(?: html)?
gpl-1.0 | gpl 1 | (?:gnu )?general public L(?: gpl)?(?: as published by the free software foundation(?: either)?)?(?: version| v) ?1(?: 0)? | -
gpl-2.0 | gpl 2 | (?:gnu )?general public L(?: gpl)?(?: as published by the free software foundation(?: either)?)?(?: version| v) ?2(?: 0)? | -
gpl-3.0 | gpl 3 | (?:gnu )?general public L(?: gpl)?(?: as published by the free software foundation(?: either)?)?(?: version| v) ?3(?: 0)? | -
gpl | - | (?:gnu )?gpl | -
gpl | gpl | gnu general public(?: L)? | this program is free software you can redistribute it and or modify it under the terms of the gnu general public L
lgpl-2.0 | lgpl 2 0(?: only| or later)? | (?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)? | gnu org licenses(?: old licenses)? lgpl 2 0
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu )?lgpl(?: version| v)? ?v?2 1 | gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-3.0 | lgpl 3 0(?: only| or later)? | (?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)? | gnu org licenses lgpl(?: 3 0)?
lgpl-2.0 | lgpl 2 | (?:gnu )?library general public L(?: version| v) ?2(?: 0)? | -
lgpl-2.1 | lgpl 21 | (?:gnu )?lesser general public L(?: version| v) ?2 1 | -
lgpl-3.0 | lgpl 3 | (?:gnu )?lesser general public L(?: version| v) ?3(?: 0)? | -
lgpl | - | (?:gnu )?lgpl | -
lgpl | lgpl | (?:gnu )?(?:lesser|library) general public(?: L)? | -
agpl-1.0 | agpl 1 0(?: only| or later)? | affero general public L(?: version| v) ?1(?: 0)? | affero org oagpl
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu )?affero general public L(?: version| v) ?3(?: 0)? | gnu org licenses agpl 3 0
agpl-3.0 | agpl 3 | (?:gnu )?(?:agpl|affero gpl)(?: version| v)? ?v?3(?: 0)? | gnu org licenses agpl(?: 3 0)?
agpl | - | (?:gnu )?(?:agpl|affero gpl) | -
agpl | agpl | (?:gnu )?affero general public(?: L)? | -
gfdl | gfdl 1 [123](?: only| or later)? | (?:gnu )?free documentation(?: L)?(?: version 1 [123])? | gnu org (?:copyleft|licenses) fdl
bsd-1-clause | bsd 1 clause | (?:bsd 1 clause|1 clause bsd|one clause bsd) | opensource org licenses bsd 1 clause
bsd-2-clause | bsd 2 clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) | opensource org licenses bsd 2 clause
bsd-3-clause | bsd 3 clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) | opensource org licenses bsd 3 clause
bsd-4-clause | bsd 4 clause | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd) | opensource org licenses bsd 4 clause
0bsd | 0bsd | (?:0 ?bsd|zero clause bsd) | opensource org licenses 0bsd
bsd | bsd | bsd(?: style)? | redistributions of source code must retain the above copyright notice
isc | isc | isc | opensource org licenses isc; internet systems consortium
mpl-1.0 | mpl 1 0 | mozilla public L(?: version| v)? ?1 0 | mozilla org mpl 1 0
mpl-1.1 | mpl 1 1 | mozilla public L(?: version| v)? ?1 1 | mozilla org mpl 1 1
mpl-2.0 | mpl 2 0 | mozilla public L(?: version| v)? ?2(?: 0)? | mozilla org mpl 2 0
mpl | mpl | mpl(?: v?[12](?: [01])?)? | mozilla org mpl
mpl | - | mozilla public L | -
epl | epl | epl(?: v?[12](?: 0)?)? | -
epl | - | eclipse public L | -
cddl | cddl | cddl(?: v?1(?: [01])?)? | -
cddl | - | common development and distribution L | -
cpl | - | common public L | -
eupl | eupl | eupl(?: v?1 [12])? | -
eupl | - | european union public L | -
bsl-1.0 | - | boost software L | -
busl-1.1 | - | business source L | -
apache | - | apache(?: software)? L | -
epl-1.0 | epl 1 0 | eclipse public L(?: version| v)? ?1(?: 0)? | eclipse org legal epl v10
epl-2.0 | epl 2 0 | eclipse public L(?: version| v)? ?2(?: 0)? | eclipse org legal epl 2 0
edl-1.0 | edl 1 0 | eclipse distribution L(?: version| v)? ?1(?: 0)? | eclipse org org documents edl v10
cddl-1.0 | cddl 1 0 | common development and distribution L(?: version| v)? ?1(?: 0)? | opensource org licenses cddl 1 0
cddl-1.1 | cddl 1 1 | common development and distribution L(?: version| v)? ?1 1 | -
cpl-1.0 | cpl 1 0 | common public L(?: version| v)? ?1(?: 0)? | opensource org licenses cpl1 0
ipl-1.0 | ipl 1 0 | ibm public L(?: version| v)? ?1(?: 0)? | opensource org licenses ipl 1 0
eupl-1.1 | eupl 1 1 | european union public L(?: version| v)? ?1 1 | -
eupl-1.2 | eupl 1 2 | european union public L(?: version| v)? ?1 2 | joinup ec europa eu collection eupl
artistic-1.0 | artistic 1 0(?: perl)? | artistic L(?: version| v)? ?1(?: 0)? | opensource org licenses artistic 1 0
artistic-2.0 | artistic 2 0 | artistic L(?: version| v)? ?2(?: 0)? | opensource org licenses artistic 2 0
artistic | artistic | (?:perl |clarified )?artistic | under the same terms as perl itself
bsl-1.0 | bsl 1 0 | boost(?: software)? L(?: version| v)? ?1(?: 0)? | boost org license 1 0
busl-1.1 | busl 1 1 | business source L(?: version| v)? ?1 1 | mariadb com bsl11
elastic-2.0 | elastic 2 0 | elastic L(?: version| v)? ?2(?: 0)? | elastic co licensing elastic license
sspl-1.0 | sspl 1 0 | server side public L(?: version| v)? ?1? | mongodb com licensing server side public license
zlib | zlib | zlib(?: libpng)? | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng(?: 2 0)? | libpng | png reference library
openssl | openssl | openssl | this product includes software developed by the openssl project
php-3.01 | php 3 01 | php L(?: version| v)? ?3 01 | php net license 3 01
python-2.0 | python 2 0 | (?:python software foundation|psf) L(?: version| v)? ?2? | python software foundation
ruby | ruby | ruby | ruby lang org en about license
postgresql | postgresql | postgresql | opensource org licenses postgresql
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? | opensource org licenses ncsa
w3c | w3c | w3c(?: software(?: notice and)?)? | w3 org consortium legal
ofl-1.1 | ofl 1 1 | (?:sil )?open font L(?: version| v)? ?1 1 | scripts sil org ofl
wtfpl | wtfpl | wtfpl(?: version 2)? | wtfpl net; do what the fuck you want to public L
unlicense | unlicense | (?:the )?unlicense | unlicense org; this is free and unencumbered software released into the public domain
upl-1.0 | upl 1 0 | universal permissive L(?: version| v)? ?1? | oss oracle com licenses upl
mulan-psl-2.0 | mulanpsl 2 0 | mulan(?: permissive software| psl)(?: L)?(?: version| v)? ?2 | license coscl org cn mulanpsl2
ms-pl | ms pl | microsoft public(?: L)? | opensource org licenses ms pl
ms-rl | ms rl | microsoft reciprocal(?: L)? | opensource org licenses ms rl
odbl-1.0 | odbl 1 0 | open (?:data commons )?(?:open )?database L(?: version| v)? ?1? | opendatacommons org licenses odbl
odc-by-1.0 | odc by 1 0 | open data commons attribution(?: L)? | opendatacommons org licenses by
pddl-1.0 | pddl 1 0 | open data commons public domain dedication and L | opendatacommons org licenses pddl
cc0-1.0 | cc0 1 0 | cc0(?: 1 0)?(?: universal)? | creativecommons org publicdomain zero 1 0
cc0-1.0 | cc zero | creative commons(?: cc0| zero)(?: 1 0)?(?: universal)? | -
cc-pdm-1.0 | pdm 1 0 | public domain mark(?: 1 0)? | creativecommons org publicdomain mark 1 0
openrail | openrail | (?:creativeml )?(?:big ?science )?open ?rail(?: ?m)? | -
llama | llama[ 0-9]* | (?:meta )?llama ?[234]?(?: [0-3])? community | -
proprietary | - | - | all rights reserved
proprietary | - | - | proprietary and confidential
proprietary | - | end user L agreement eula | -
public-domain | - | - | (?:dedicated to|released (?:in)?to|placed in|is in|in) the public domain
"""

# Names that stand for a licence by themselves, without a word of grant or licence: identifiers
# with a number, and names that mean nothing else.
ALONE = r"""
gpl-1.0 | (?:gnu )?gpl(?: version| v)? ?v?1(?: 0)?(?: only| or later| or any later version| or newer)?
gpl-2.0 | (?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: only| or later| or any later version| or newer)?
gpl-3.0 | (?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: only| or later| or any later version| or newer)?
lgpl-2.0 | (?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)?(?: only| or later| or any later version| or newer)?
lgpl-2.1 | (?:gnu )?lgpl(?: version| v)? ?v?2 1(?: only| or later| or any later version| or newer)?
lgpl-3.0 | (?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?(?: only| or later| or any later version| or newer)?
agpl-3.0 | (?:gnu )?(?:agpl|affero gpl)(?: version| v)? ?v?3(?: 0)?(?: only| or later| or any later version| or newer)?
apache-1.1 | apache 1 1
apache-2.0 | (?:apache 2 0|asl 2 0)
bsd-1-clause | bsd 1 clause
bsd-2-clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)
bsd-3-clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|modified bsd|revised bsd)
bsd-4-clause | (?:bsd 4 clause|4 clause bsd|four clause bsd)
0bsd | (?:0bsd|zero clause bsd)
mit-0 | mit 0
mpl-1.0 | mpl(?: version| v)? ?1 0
mpl-1.1 | mpl(?: version| v)? ?1 1
mpl-2.0 | mpl(?: version| v)? ?2 0
epl-1.0 | epl(?: version| v)? ?1 0
epl-2.0 | epl(?: version| v)? ?2 0
edl-1.0 | edl(?: version| v)? ?1 0
cddl-1.0 | cddl(?: version| v)? ?1 0
cddl-1.1 | cddl(?: version| v)? ?1 1
cpl-1.0 | cpl(?: version| v)? ?1 0
eupl-1.1 | eupl(?: version| v)? ?1 1
eupl-1.2 | eupl(?: version| v)? ?1 2
artistic-1.0 | artistic 1 0
artistic-2.0 | artistic 2 0
bsl-1.0 | bsl 1 0
busl-1.1 | busl 1 1
sspl-1.0 | sspl(?: v)? ?1(?: 0)?
ofl-1.1 | (?:sil )?ofl(?: v)? ?1 1
upl-1.0 | upl 1 0
odbl-1.0 | odbl(?: v)? ?1 0
pddl-1.0 | pddl(?: v)? ?1 0
cc0-1.0 | (?:cc0(?: 1 0)?|cc zero)
wtfpl | wtfpl
unlicense | the unlicense
mulan-psl-2.0 | mulanpsl 2 0
openrail | openrail(?: m)?
"""

# Creative Commons: attribution terms x versions, written in short and in full.
CC_TERMS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

LICENSE = "licen[sc]e"
GRANT = (
    "(?:dual |double |re|sub)?(?:redistribute it(?: and or modify it)?|licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|"
    "shared|offered|governed|issued|made available|distribute it(?: and or modify it)?)(?: to you)? (?:under|by|with|through) "
    "(?:(?:the|a|an) )?(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )?"
)
FIELD = f"(?:{LICENSE}|{LICENSE}s|licensing|copying)(?: (?:is|type|name|classifier osi approved))? "


# Names that are ordinary words where their licence word is left out ("free documentation"):
# a title without it counts only in a text that speaks of licences somewhere.
ORDINARY = {"apache-1.0", "apache-1.1", "apache-2.0", "gfdl", "ms-pl", "ms-rl"}

Gate = tuple[tuple[bytes, ...], ...]  # of each group a text must hold one


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: Gate
    pattern: re.Pattern


def families() -> Iterator[tuple[str, str, str, list[str]]]:
    """(label, SPDX words, names, own phrases)."""
    for line in FAMILIES.strip().splitlines():
        label, spdx, names, phrases = (x.strip() for x in line.split("|", 1)[:1] + _rest(line))
        yield label, spdx, names, [p.strip() for p in phrases.split(";") if p.strip() != "-"]
    for terms, full in CC_TERMS.items():
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            short = f"cc {terms.replace('-', ' ')} {number}"
            yield f"cc-{terms}-{version}", short, short, []
            place = f"creativecommons org licenses {terms.replace('-', ' ')} {number}"
            yield f"cc-{terms}-{version}", "-", "-", [place]
            kind = "(?: international| unported| generic)?"
            long = f"creative commons {full}(?: L)?(?: {number}| version {number}| v ?{number}){kind}"
            after = f"creative commons {full} {number}{kind}"
            yield f"cc-{terms}-{version}", "-", long, [after]
        yield f"cc-{terms}", f"cc {terms.replace('-', ' ')}", f"creative commons {full}", []
        yield f"cc-{terms}", "-", f"cc {terms.replace('-', ' ')}", []


def _rest(line: str) -> list[str]:
    """The last three fields; alternatives inside brackets hold "|" of their own."""
    body = line.split("|", 1)[1]
    depth, cuts = 0, []
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            cuts.append(i)
    return [body[: cuts[0]], body[cuts[0] + 1 : cuts[1]], body[cuts[1] + 1 :]]


def spelled(pattern: str) -> str:
    return re.sub(r"\bL\b", LICENSE, pattern)


def best(groups: list[set[str]]) -> set[str]:
    """The group that sorts out most: its shortest word is the longest."""
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=set())


def needed(parsed) -> list[set[str]]:
    """Groups of words of a parsed pattern: every match holds a word of each group."""
    groups: list[set[str]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run.strip():
            groups.append({run.strip()})
        run = ""
        if op is _parser.SUBPATTERN:
            groups += needed(value[-1])
        elif op is _parser.MAX_REPEAT and value[0] > 0:
            groups += needed(value[-1])
        elif op is _parser.BRANCH:
            each = [best(needed(branch)) for branch in value[1]]
            if all(each):
                words = set().union(*each)
                groups.append({w for w in words if not any(o != w and o in w for o in words)})
    return groups


def gate_of(*parts: str) -> Gate:
    """The gate of a rule whose matches hold a match of each part."""
    gate: dict[tuple[bytes, ...], None] = {}
    for part in parts:
        groups = needed(_parser.parse(spelled(part)))
        for group in [g for g in groups if min(map(len, g)) > 2] or [best(groups)]:
            gate[tuple(sorted(w.encode() for w in group))] = None
    return tuple(gate)


@lru_cache(maxsize=1)
def rules() -> dict[Gate, list[tuple[int, Rule]]]:
    """Gate -> (number, rule); numbers follow the families."""
    found: dict[Gate, list[tuple[int, Rule]]] = {}
    number = 0

    def add(label: str, priority: int, parts: tuple[str, ...], pattern: str) -> None:
        nonlocal number
        gate = gate_of(*parts)
        rule = Rule(label, priority, gate, re.compile(f"(?<= )(?:{spelled(pattern)})(?= )".encode()))
        found.setdefault(gate, []).append((number, rule))
        number += 1

    for label, spdx, names, phrases in families():
        if spdx != "-":
            add(label, 99, ("spdx",), f"spdx licen[sc]e identifier {spdx}")
        for phrase in phrases:
            add(label, 90, (phrase,), phrase)
        if names != "-":
            add(label, 80, (names,), f"{GRANT}(?:{names})(?: L| software L)?")
            title = names if re.search(r"\bL\b", names) else f"(?:{names}) L"  # some names hold the word
            add(label, 65, (title, "L") if label in ORDINARY else (title,), f"(?:the )?(?:{title})")
            add(label, 60, (FIELD, names), f"{FIELD}(?:{names})")
    for label, spdx, names, _ in families():
        if names != "-":
            add(label, 62, (names, "licen[sc]ed"), f"(?:{names}) licen[sc]ed")
    for line in ALONE.strip().splitlines():
        label, pattern = (x.strip() for x in line.split("|", 1))
        add(label, 55, (pattern,), pattern)
    for terms in CC_TERMS:
        for version in CC_VERSIONS:
            short = f"cc {terms.replace('-', ' ')} {version.replace('.', ' ')}"
            add(f"cc-{terms}-{version}", 55, (short,), short)
    add("unknown", 20, ("L",), f"{GRANT}(?:following )?L")
    add("unknown", 15, ("(?:L|copying)",), "(?:see|read) (?:the )?(?:L|copying)(?: file| txt| md)?(?: for (?:more )?(?:details|information|terms))")
    add("unknown", 15, ("L",), "(?:this|the) (?:work|software|file|code|document|text|book|image|program) is (?:free )?licen[sc]ed")
    add("copyright", 10, ("copyright",), r"copyright(?: c)?(?: [12][0-9]{3})+")
    return found


@lru_cache(maxsize=1)
def gate_words() -> tuple[ahocorasick.Automaton, dict[bytes, list[Gate]]]:
    """(one automaton over all words of gates, the gates that each word may open: by their best group)."""
    words = ahocorasick.Automaton()
    opens: dict[bytes, list[Gate]] = {}
    for gate in rules():
        for word in best([set(group) for group in gate]):
            opens.setdefault(word, []).append(gate)
        for word in {w for group in gate for w in group}:
            words.add_word(word.decode("latin-1"), word)
    words.make_automaton()
    return words, opens


def open_gates(norm: bytes) -> list[Gate]:
    """The gates that the text opens. One pass over it finds every gate word that it holds."""
    words, opens = gate_words()
    present = {word for _, word in words.iter(norm.decode("latin-1"))}
    gates = {gate for word in present for gate in opens.get(word, ())}
    return [gate for gate in gates if all(any(w in present for w in group) for group in gate)]


def detections(norm: bytes) -> list[tuple[int, int, Rule]]:
    """Kept (start, end, rule) of a normalised text, by start.

    One sweep by start, longer intervals first: whatever can contain an interval
    has been met before it, and a running largest end for each priority tells if
    a better one does. Being inside one that went is being inside what that one
    is inside of.
    """
    found = [
        (m.start(), -m.end(), -rule.priority, k, rule)
        for gate in open_gates(norm)
        for k, rule in rules()[gate]
        for m in rule.pattern.finditer(norm)
    ]
    found.sort(key=lambda d: d[:4])
    reach: dict[int, int] = {}  # priority -> largest end so far
    kept = []
    for start, end, priority, _, rule in found:
        if all(reach.get(p, 0) < -end for p in reach if p >= -priority):
            kept.append((start, -end, rule))
        reach[-priority] = max(reach.get(-priority, 0), -end)
    strong = [(a, b) for a, b, r in kept if r.priority > CLUE]
    starts = [a for a, _ in strong]  # ends rise with starts only for equal priorities
    ends = np.maximum.accumulate([b for _, b in strong]) if strong else []

    def overlaps(a: int, b: int) -> bool:
        before = int(np.searchsorted(starts, b)) if strong else 0
        return before > 0 and ends[before - 1] > a

    return [(a, b, r) for a, b, r in kept if r.priority > CLUE or not overlaps(a, b)]


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    norm = decontam.normalise(text)
    n_words = norm.count(b" ") - 1 if len(norm) > 2 else 0
    places: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE.items():
        at = norm.find(b" " + phrase + b" ")
        while at >= 0:
            places.append(at)
            base.add(label)
            at = norm.find(b" " + phrase + b" ", at + 1)
    kept = detections(norm)
    if not places and not kept:
        return n_words, 0, None, None, "", "", 0.0, []
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  number of the word after the space at ``at``
    miss = (1 - BASE_PRIORITY / 100) ** len(places)
    spans = []
    for start, end, rule in kept:
        miss *= 1 - rule.priority / 100
        first = word(start - 1)
        spans.append({"label": rule.label, "priority": rule.priority, "word": first, "n_words": word(end) - first})
    labels = base | {rule.label for _, _, rule in kept}
    ends = (word(min(places)), word(max(places))) if places else (None, None)
    return n_words, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, spans


SPAN = pa.struct([("label", pa.string()), ("priority", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())])
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("detections", pa.list_(SPAN)),
    ]
)
DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label: string, priority: long, word: long, n_words: long>>"
)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, score and the kept detections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan(t) for t in batch.column("text").to_pylist()]
            columns = [list(c) for c in zip(*out)] or [[]] * (len(SCHEMA) - 1)
            yield common.batch_of(SCHEMA, [batch.column("doc_id"), *columns])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, DDL)


def license_labels(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``license_scan``."""
    return license_scan(docs).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")
