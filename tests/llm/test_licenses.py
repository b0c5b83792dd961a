"""License scan against a plain Python version of the same rules."""

import re
from collections import namedtuple

import pytest

from palimpsest.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
Row = namedtuple("Row", "n_words n_base first_word last_word base_labels labels")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    starts, base = [], set()
    for phrase, label in licenses.BASE:
        want = phrase.split(" ")
        for k in range(len(words)):
            if words[k : k + len(want)] == want:
                starts.append(k)
                base.add(label)
    norm = " " + " ".join(words) + " " if words else " "
    hits = []
    for rank, label, word, regex in licenses.rules():
        if f" {word} " in norm:
            hits += [(m.start(), m.end(), rank, label) for m in re.finditer(rf"(?<= )(?:{regex})(?= )", norm)]
    # a gate that hides a match would show up here, as the gate is not applied
    stay = {
        h[3] for h in hits
        if not any(o is not h and o[0] <= h[0] and h[1] <= o[1] and ((o[0], o[1]) != (h[0], h[1]) or o[2] < h[2]) for o in hits)
    }
    return Row(len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | stay)))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. cc by CC BY-NC 4.0 and Cc-By",
    "This work is licensed under the GNU General Public License, version 3.\nMIT license mit license",
    "SPDX-License-Identifier: MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GNU Lesser General Public License version 2.1 or later",
    "mit ohne lizenz, the comitted licenses", None, "", "   ", "\x00\x7f!!", "ÀÉ mit license É", "a" * 5000,
    "mit license " * 400, "gnu general public license", "GNU GENERAL PUBLIC\nLICENSE v2 or any later version", "dedicated to the public domain cc0 1.0 universal",
    "Mozilla Public License 2.0; Eclipse Public License 1.0, All rights reserved. Copyright (c) 2020",
]


def compare(spark, frame):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    for r in frame.collect():
        g = got[r["doc_id"]]
        assert Row(*[g[c] for c in Row._fields]) == brute(r["text"]), (r["doc_id"], r["text"], g)
        assert 0 <= g["score"] <= 1


def test_fixed_texts(spark):
    rows = [(k, t, "x", t) for k, t in enumerate(TEXTS)]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string, norm string, labels string"))


def test_generated_documents(spark, documents):
    compare(spark, documents)


def test_repeated_and_empty(spark):
    schema = "doc_id long, text string"
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    assert licenses.scan_licenses(spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, None)], schema)).count() == 3


def test_hundreds_of_distinct_rules():
    all_rules = licenses.rules()
    assert len(all_rules) >= 300
    assert len({(label, regex) for _, label, _, regex in all_rules}) == len(all_rules)
    for _, _, _, regex in all_rules:
        re.compile(regex)


def samples(tree):
    """Texts a parsed regex matches: every alternative, optional parts left out and taken."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(arg)]
        elif kind == "NOT_LITERAL":
            own = ["x"]
        elif kind == "IN":
            own = ["x"] if str(arg[0][0]) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg[:2]]
        elif kind == "BRANCH":
            own = [t for branch in arg[1] for t in samples(branch)]
        elif kind == "SUBPATTERN":
            own = samples(arg[-1])
        else:
            assert kind == "MAX_REPEAT", kind
            one = samples(arg[2])
            own = [""] * (arg[0] == 0) + one if arg[1] == 1 else one
        out = [a + b for a in out for b in own]
    return out


def ungated(text):
    """Labels by all rules over the words of ``text``: no gate, no keyword."""
    words = WORD.findall(text.lower())
    norm = " " + " ".join(words) + " "
    hits = [(m.start(), m.end(), rank, label) for rank, label, _, regex in licenses.rules() for m in re.finditer(rf"(?<= )(?:{regex})(?= )", norm)]
    stay = {h[3] for h in hits if not any(o is not h and o[0] <= h[0] and h[1] <= o[1] and ((o[0], o[1]) != (h[0], h[1]) or o[2] < h[2]) for o in hits)}
    return ",".join(sorted(stay | {label for phrase, label in licenses.BASE if f" {phrase} " in norm}))


def test_keyword_and_gate_hide_no_match():
    for _, label, word, regex in licenses.rules():
        for text in samples(re._parser.parse(regex)):
            norm = f" {text} "
            assert re.search(rf"(?<= )(?:{regex})(?= )", norm), (regex, text)
            assert f" {word} " in norm, (label, word, text)
            assert re.search(licenses.GATE, norm), (label, text)


def test_one_sample_per_rule_without_gates(spark, documents):
    texts = ["so " + samples(re._parser.parse(regex))[0] + " it is" for _, _, _, regex in licenses.rules()]
    rows = documents.select("doc_id", "text").filter("text is not null").collect() + [(10**9 + k, t) for k, t in enumerate(texts)]
    want = {k: ungated(t) for k, t in rows}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and all(want[10**9 + k] for k in range(len(texts)))


@pytest.mark.parametrize(
    "text, label",
    [
        ("under AGPLv3", "agpl-3.0"), ("AGPL3", "agpl-3.0"), ("LGPL3", "lgpl"), ("LGPL2.1", "lgpl"), ("Creative Commons Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
        ("CreativeML Open RAIL-M", "openrail"), ("https://creativecommons.org/licenses/by/4.0/", "cc-by"), ("MulanPSL-2.0", "mulan-2.0"),
        ("https://opendatacommons.org/licenses/by/", "odc-by-1.0"), ("ASL 2.0", "apache-2.0"), ("Zero-Clause BSD", "0bsd"), ("the FreeBSD License", "bsd-2-clause"),
        ("Berkeley Software Distribution", "bsd"), ("Alle Rechte vorbehalten", "all-rights-reserved"), ("Open Data Commons Public Domain Dedication and License", "pddl-1.0"),
    ],
)
def test_labels_that_were_hidden(spark, text, label):
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == label
