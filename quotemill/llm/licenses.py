"""License scans by ordered signature rules.

A text becomes lower-case words; its rules are regular expressions over those words joined by single spaces. Rules
are written by hand as families: a name in its spellings, versions, and the forms in which each is granted or
mentioned; some hundreds of rules come out, every one with a label, a confidence and a keyword. An automaton finds
the keywords of all rules in one pass, and only the rules whose keyword occurs are tried. Matches are settled in
order: higher priority first (an own notice before a version before a bare name), then longer, then earlier; a match
that lies within one already taken is suppressed. Matches that only overlap both stay.

The base phrases are counted apart, everywhere they stand, and their labels always stay.

Defined results: null texts are empty; a text without words has no label and score 0. Repeated rows get equal
results; an empty table gives no rows. Very long texts are scanned whole; only matches are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quotemill.llm.common import texts

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

NOTICE, VERSIONED, NAMED, HINT = 400, 300, 200, 100
#: A gap of up to three words, as in "under the terms of".
GAP = r"(?:[^ ]+ ){0,3}"
LICENSE = r"licen[cs]e"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keyword: str
    pattern: re.Pattern[str]


def _rule(label: str, priority: int, score: float, keyword: str, pattern: str) -> Rule:
    return Rule(label, priority, score, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"))


def _family(label: str, name: str, keyword: str, versions: tuple[str, ...], bare: float) -> Iterator[Rule]:
    """Rules of one license: notice, version and mention, `name` being the regex of its spellings.

    `bare` is the score of the name alone; 0 for names that are common words, which say nothing alone.
    """
    yield _rule(label, NOTICE, 0.95, keyword, rf"(?:released|distributed|available|provided|licen[cs]ed|covered) (?:under|by) {GAP}{name}")
    yield _rule(label, NAMED, 0.8, keyword, rf"{name} {LICENSE}")
    yield _rule(label, NAMED, 0.75, keyword, rf"{LICENSE}d? (?:is |under |under the )?{name}")
    yield _rule(label, NOTICE + 10, 1.0, "spdx", rf"spdx {LICENSE} identifier {name}")
    if bare:
        yield _rule(label, HINT, bare, keyword, name)
    for version in versions:
        number = version.replace(".", " ")
        short = re.sub(r" 0$", "(?: 0)?", number)
        own = f"{label}-{version}"
        spelled = rf"{name} (?:{LICENSE} )?(?:version |v ?|ver )?{short}"
        yield _rule(own, VERSIONED + 40, 0.98, keyword, rf"{spelled} or (?:any )?later(?: version)?")
        yield _rule(own, VERSIONED + 30, 0.98, keyword, rf"{spelled} only")
        yield _rule(own, VERSIONED, 0.9, keyword, spelled)
        yield _rule(own, NOTICE + 20, 0.99, keyword, rf"(?:released|distributed|licen[cs]ed|available) under {GAP}{spelled}")
        yield _rule(own, NOTICE + 50, 1.0, "spdx", rf"spdx {LICENSE} identifier {name} {short}(?: only| or later)?")


def _creative_commons() -> Iterator[Rule]:
    kinds = {
        "by": r"attribution",
        "by-sa": r"attribution share ?alike",
        "by-nd": r"attribution no ?deriv(?:ative|atives|s)",
        "by-nc": r"attribution non ?commercial",
        "by-nc-sa": r"attribution non ?commercial share ?alike",
        "by-nc-nd": r"attribution non ?commercial no ?deriv(?:ative|atives|s)",
    }
    for kind, spelled in kinds.items():
        short, label, rank = kind.replace("-", " "), f"cc-{kind}", 4 * kind.count("-")
        yield _rule(label, NAMED + rank, 0.85, "cc", rf"cc {short}")
        yield _rule(label, NAMED + rank, 0.9, "creative commons", rf"creative commons {spelled}(?: {LICENSE})?")
        yield _rule(label, NOTICE + rank, 0.95, "cc", rf"licen[cs]ed under {GAP}cc {short}")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            own = f"{label}-{version}"
            yield _rule(own, VERSIONED + rank, 0.95, "cc", rf"cc {short} {number}")
            yield _rule(own, VERSIONED + rank, 0.95, "creative commons", rf"creative commons {spelled} {number}(?: (?:international|unported|generic))?(?: {LICENSE})?")
            yield _rule(own, NOTICE + 20 + rank, 0.99, "cc", rf"licen[cs]ed under {GAP}cc {short} {number}")
            yield _rule(own, NOTICE + 20 + rank, 1.0, "creativecommons", rf"creativecommons org licenses {short} {number}")
    yield _rule("cc0", NAMED, 0.9, "cc0", r"cc0(?: 1 0)?(?: universal)?")
    yield _rule("cc0", NAMED, 0.9, "publicdomain", r"creativecommons org publicdomain zero 1 0")
    yield _rule("creative-commons", HINT, 0.5, "creative commons", r"creative commons")


def _rules() -> list[Rule]:
    gpl = r"(?:gnu )?general public"
    out: list[Rule] = []
    for label, name, keyword, versions, bare in (
        ("gpl", rf"{gpl} {LICENSE}", "general public", ("1.0", "2.0", "3.0"), 0.7),
        ("gpl", r"(?:gnu )?gpl", "gpl", ("1.0", "2.0", "3.0"), 0.6),
        ("lgpl", rf"(?:gnu )?(?:lesser|library) general public(?: {LICENSE})?", "general public", ("2.0", "2.1", "3.0"), 0.8),
        ("lgpl", r"(?:gnu )?lgpl", "lgpl", ("2.0", "2.1", "3.0"), 0.6),
        ("agpl", rf"(?:gnu )?affero general public(?: {LICENSE})?", "general public", ("1.0", "3.0"), 0.8),
        ("agpl", r"(?:gnu )?agpl", "agpl", ("1.0", "3.0"), 0.6),
        ("gfdl", r"(?:gnu )?free documentation", "free documentation", ("1.1", "1.2", "1.3"), 0.6),
        ("apache", r"apache(?: software)?", "apache", ("1.0", "1.1", "2.0"), 0.0),
        ("mozilla", r"mozilla public", "mozilla public", ("1.0", "1.1", "2.0"), 0.7),
        ("mozilla", r"mpl", "mpl", ("1.0", "1.1", "2.0"), 0.0),
        ("eclipse", r"eclipse public", "eclipse public", ("1.0", "2.0"), 0.7),
        ("eclipse", r"epl", "epl", ("1.0", "2.0"), 0.0),
        ("cddl", r"cddl", "cddl", ("1.0", "1.1"), 0.5),
        ("cddl", r"common development and distribution", "common development", ("1.0", "1.1"), 0.7),
        ("eupl", r"eupl", "eupl", ("1.0", "1.1", "1.2"), 0.5),
        ("eupl", r"european union public", "european union public", ("1.0", "1.1", "1.2"), 0.7),
        ("artistic", r"(?:perl )?artistic", "artistic", ("1.0", "2.0"), 0.0),
        ("boost", r"boost software", "boost software", ("1.0",), 0.7),
        ("academic-free", r"academic free", "academic free", ("2.0", "2.1", "3.0"), 0.0),
        ("open-software", r"open software", "open software", ("1.0", "2.0", "3.0"), 0.0),
        ("python", r"python software foundation", "python software", ("2.0",), 0.6),
        ("php", r"php", "php", ("3.0", "3.01"), 0.0),
        ("zope", r"zope public", "zope public", ("2.0", "2.1"), 0.7),
        ("openssl", r"openssl", "openssl", (), 0.0),
        ("zlib", r"zlib(?: libpng)?", "zlib", (), 0.0),
        ("mit", r"mit", "mit", (), 0.0),
        ("mit", r"x11", "x11", (), 0.0),
        ("mit", r"expat", "expat", (), 0.0),
        ("isc", r"isc", "isc", (), 0.0),
        ("bsd-2-clause", r"(?:bsd 2 clause|(?:simplified|two clause) bsd)", "bsd", (), 0.8),
        ("bsd-3-clause", r"(?:bsd 3 clause|(?:new|revised|three clause) bsd)", "bsd", (), 0.8),
        ("bsd-4-clause", r"(?:bsd 4 clause|original bsd)", "bsd", (), 0.8),
        ("bsd", r"bsd(?: style)?", "bsd", (), 0.4),
        ("unlicense", r"unlicense", "unlicense", (), 0.8),
        ("wtfpl", r"wtfpl", "wtfpl", (), 0.8),
        ("open-database", r"odbl", "odbl", ("1.0",), 0.6),
        ("open-database", r"open database", "open database", ("1.0",), 0.0),
        ("open-font", r"(?:sil )?open font", "open font", ("1.0", "1.1"), 0.7),
        ("ms-pl", r"microsoft public", "microsoft public", (), 0.7),
        ("ms-rl", r"microsoft reciprocal", "microsoft reciprocal", (), 0.7),
        ("ibm-public", r"ibm public", "ibm public", ("1.0",), 0.7),
        ("common-public", r"common public", "common public", ("1.0",), 0.0),
        ("server-side-public", r"sspl", "sspl", ("1.0",), 0.6),
        ("server-side-public", r"server side public", "server side public", ("1.0",), 0.8),
        ("business-source", r"business source", "business source", ("1.1",), 0.0),
        ("elastic", r"elastic", "elastic", ("1.0", "2.0"), 0.0),
        ("blue-oak", r"blue oak model", "blue oak", ("1.0.0",), 0.7),
    ):
        out += _family(label, name, keyword, versions, bare)
    out += _creative_commons()
    for label, priority, score, keyword, pattern in (
        ("reserved", NOTICE, 0.9, "rights reserved", r"all rights (?:are )?reserved"),
        ("reserved", NOTICE, 0.8, "reproduced", r"no part of this [^ ]+ may be reproduced"),
        ("reserved", NAMED, 0.6, "written permission", r"without (?:the )?(?:prior |express )*written permission"),
        ("some-rights", NAMED, 0.6, "rights reserved", r"some rights reserved"),
        ("copyright", HINT, 0.4, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
        ("copyright", HINT, 0.3, "copyrighted", r"copyrighted (?:material|work)"),
        ("proprietary", NAMED, 0.7, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
        ("public-domain", NAMED, 0.8, "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
        ("public-domain", HINT, 0.4, "public domain", r"public domain"),
        ("mit", NOTICE + 30, 0.97, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", NOTICE + 30, 0.95, "hereby granted", r"permission to use copy modify and or distribute this software for any purpose"),
        ("bsd", NOTICE + 30, 0.95, "redistribution and use", r"redistribution and use in source and binary forms"),
        ("zlib", NOTICE + 30, 0.95, "altered source", r"altered source versions must be plainly marked as such"),
        ("warranty-disclaimer", HINT, 0.5, "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
        ("warranty-disclaimer", HINT, 0.5, "as is", r"provided as is"),
        ("license-mention", HINT, 0.3, "licensed under", r"licen[cs]ed under the [^ ]+ licen[cs]e"),
        ("free-software", HINT, 0.4, "free software", r"this (?:program|library|work) is free software"),
        ("open-government", NAMED, 0.7, "open government", r"open government licen[cs]e(?: v?[0-9](?: 0)?)?"),
        ("us-government", NAMED, 0.6, "government", r"work of the (?:us|united states) government"),
        ("patent-grant", HINT, 0.4, "patent", r"royalty free (?:irrevocable )?patent licen[cs]e"),
    ):
        out.append(_rule(label, priority, score, keyword, pattern))
    # Order decides; equal rules keep the order in which they are written.
    return sorted(out, key=lambda r: -r.priority)


RULES = _rules()


def automaton() -> ahocorasick.Automaton:
    """Keyword, where a word begins with it, to the numbers of its rules."""
    rules: dict[str, list[int]] = {}
    for n, rule in enumerate(RULES):
        rules.setdefault(rule.keyword, []).append(n)
    found = ahocorasick.Automaton()
    for keyword, numbers in rules.items():
        found.add_word(" " + keyword, numbers)
    found.make_automaton()
    return found


def words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_SPACED).split()


def base_places(joined: bytes) -> Iterator[tuple[int, str]]:
    """(byte, label) of every place of a base phrase in ` word word ... `."""
    for phrase, label in BASE:
        want = b" " + phrase.encode() + b" "
        at = joined.find(want)
        while at >= 0:
            yield at, label
            at = joined.find(want, at + 1)


def rule_matches(line: str, gate: ahocorasick.Automaton) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what stays, in ` word word ... `, after suppression; sorted by start."""
    tried = sorted({n for _, numbers in gate.iter(line) for n in numbers})
    found = [(m.start(), m.end(), n) for n in tried for m in RULES[n].pattern.finditer(line)]
    found.sort(key=lambda m: (-RULES[m[2]].priority, m[0] - m[1], m[0], m[2]))
    # A match goes if a taken one that starts no later ends no earlier: the furthest end of a taken match up to each
    # start is kept in a tree of maxima, two logarithmic steps a match.
    starts = {s: i for i, s in enumerate(sorted({m[0] for m in found}), 1)}
    furthest = [-1] * (len(starts) + 1)
    kept = []
    for start, end, n in found:
        at, reach = starts[start], -1
        while at:
            reach = max(reach, furthest[at])
            at -= at & -at
        if reach >= end:
            continue
        at = starts[start]
        while at < len(furthest):
            furthest[at] = max(furthest[at], end)
            at += at & -at
        kept.append((start, end, RULES[n]))
    return sorted(kept, key=lambda m: (m[0], m[1]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches, matches.

    matches lists label, start and end (words, end exclusive) and score of what the rules found.
    """
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, n_matches long, matches array<struct<label: string, start: long, end: long, score: double>>"
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = automaton()
        for pdf in batches:
            out = []
            for key, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["raw"], strict=True):
                tokens = words(raw)
                joined = b" " + b" ".join(tokens) + b" "
                # Where each word begins, so that a place is a lookup.
                spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                base = [(int(spaces.searchsorted(at)), label) for at, label in base_places(joined)]
                # One character a byte: cheap, and places stay those of the bytes.
                line = joined.decode("latin-1")
                kept = rule_matches(line, gate)
                base_labels = {label for _, label in base}
                labels = base_labels | {rule.label for _, _, rule in kept}
                matches = [
                    {"label": r.label, "start": int(spaces.searchsorted(s)) - 1, "end": int(spaces.searchsorted(e)), "score": r.score} for s, e, r in kept
                ]
                score = max([0.0, *(r.score for _, _, r in kept), *(0.7 for _ in base[:1])])
                places = [at for at, _ in base]
                out.append(
                    (key, len(tokens), len(base), min(places, default=None), max(places, default=None),
                     ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, len(kept), matches)
                )
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_matches", "matches"])
            yield frame.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return texts(docs).mapInPandas(each, schema)

