"""The licence scan against patterns, and expressions against a recursive parser."""

import random
import re

import pytest

from newsloom.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int, n_words string"

TEXTS = [
    None, "", " \n\t", "...", "mit license", "MIT License. mit-license MIT  license", "Licensed under CC BY-NC 4.0.", "cc by cc by cc by",
    "GNU General Public License, version 3 and the Apache License", "gnu lesser general public license", "gnué general public license", "the amit license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "license = 'MIT'", "License: see below",
    "license: MIT or later thoughts", "Licence: (MIT", "spdx license identifier: mit.", "license: LicenseRef-own OR AGPL-3.0+", "license:\nMIT", "License: MIT\r\nlicense: BSD-3-Clause",
    "Redistribution and use in source and binary forms", "All rights reserved. all rights reserved", "mit license " * 3000, "wörter " * 40000 + "apache license",
]


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _places(words, table):
    out = []
    for phrase, label in table.items():
        want = phrase.split()
        out += [(k, label) for k in range(len(words) - len(want) + 1) if words[k : k + len(want)] == want]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "mit license", "x", 1, "y"), (4, TEXTS[4], "x", 1, "y")], SCHEMA).repartition(3)


def test_digest_equals_patterns(spark, docs):
    scanned = licenses.scan(docs).cache()
    got = licenses.digest(scanned).collect()
    assert len(got) == len(TEXTS) + 2
    places = {r.doc_id: r.places for r in scanned.collect()}
    for r in got:
        text = "mit license" if r.doc_id is None else TEXTS[r.doc_id]
        words = _words(text)
        base = _places(words, licenses.BASE)
        starts = [k for k, _ in base]
        assert (r.n_words, r.n_base) == (len(words), len(base)), text
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert {x for _, x in base} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        for kind, table in (("named", licenses.NAMED), ("quoted", licenses.QUOTED), ("rights", licenses.RIGHTS)):
            assert sorted((p.word, p.label) for p in places[r.doc_id] if p.kind == kind) == sorted(_places(words, table))
    by = {r.doc_id: r for r in got}
    assert (by[12].expressions, by[12].binding, by[12].terms) == ("(mit or gpl-2.0-only) and apache-2.0", "apache,mit", "permissive")
    assert (by[13].labels, by[13].terms) == ("gpl", "weak")
    assert [by[k].expressions for k in (14, 15, 16, 17, 18, 20, 21)] == ["mit", "", "mit", "", "mit", "", "mit; bsd-3-clause"]
    assert (by[19].labels, by[19].binding, by[19].terms) == ("agpl,other", "agpl", "network")
    assert licenses.digest(licenses.scan(spark.createDataFrame([], SCHEMA))).count() == 0


def _parse(ts):
    """Recursive descent over the same tokens."""

    def either(i):
        value, i = both(i)
        while i < len(ts) and ts[i] == "or":
            other, i = both(i + 1)
            rank = min(value[2], other[2])
            value = (value[0] | other[0], (value[1] if value[2] == rank else set()) | (other[1] if other[2] == rank else set()), rank)
        return value, i

    def both(i):
        value, i = single(i)
        while i < len(ts) and ts[i] == "and":
            other, i = single(i + 1)
            value = (value[0] | other[0], value[1] | other[1], max(value[2], other[2]))
        return value, i

    def single(i):
        if ts[i] == "(":
            value, i = either(i + 1)
            return value, i + 1
        label, rank = licenses.license_of(ts[i])
        if i + 1 < len(ts) and ts[i + 1] == "with":
            return ({label}, {label}, max(rank - 1, 0)), i + 3
        return ({label}, {label}, rank), i + 1

    value, i = either(0)
    assert i == len(ts)
    return value


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["mit", "apache-2.0", "gpl-3.0+", "lgpl-2.1-only", "agpl-3.0", "mpl-2.0", "cc-by-nc-4.0"])
        return [name, "with", "llvm-exception"] if rng.random() < 0.2 else [name]
    out = _random(rng, depth - 1)
    for _ in range(rng.randint(1, 3)):
        out = out + [rng.choice(["and", "or"])] + _random(rng, depth - 1)
    return ["(", *out, ")"] if rng.random() < 0.6 else out


def test_expressions_equal_a_recursive_parser():
    rng = random.Random(3)
    for _ in range(500):
        ts = _random(rng, 3)
        assert licenses.tokens(" ".join(ts) + " ??") == ts
        assert tuple(map(lambda x: set(x) if not isinstance(x, int) else x, licenses.evaluate(ts))) == _parse(ts)
    deep = ["("] * 5000 + ["mit"] + [")"] * 5000
    assert licenses.tokens(" ".join(deep)) == deep and licenses.evaluate(deep)[2] == 0
