"""Licence scan: Aho-Corasick over words finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

A text's words are runs of letters, digits and characters beyond ASCII, A-Z lowered. One automaton holds all phrases as
runs of words between single spaces and reads the words of a text once, whatever the number of phrases; overlapping
places all count. Behind an identifier tag (``SPDX-License-Identifier:`` and the like) the raw text is cut into
identifiers, ``and``, ``or``, ``with`` and parentheses; the expression is the longest beginning that is complete and
names known licences. It is evaluated on an operand stack: ``and`` binds all of both sides and takes the stricter terms,
``or`` leaves the choice, so the milder side binds (both, if equal), ``with`` an exception makes terms one step milder.

Defined cases: null text is the empty text (no places, score 0). Rows are judged one by one: repeated rows and null ids
stay as they are, an empty table gives no rows, other columns are ignored. A text is never cut; memory is a few times
the longest text.
"""

from __future__ import annotations

import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import ship
from newsloom.llm.tokens import slices

# Fixed phrases of the digest and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Further notices that name a licence.
NAMED = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "european union public licence": "eupl", "boost software license": "boost",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc", "the unlicense": "unlicense",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
}
# Sentences out of licence texts.
QUOTED = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
}
# Statements about rights that name no licence.
RIGHTS = {"all rights reserved": "all-rights-reserved", "public domain": "public-domain"}
TAGS = ("spdx license identifier", "license expression", "license", "licence")

# Families of licence identifiers and how strict their terms are.
TERMS = ("permissive", "weak", "copyleft", "network", "restricted")
FAMILIES = {
    "mit": 0, "apache": 0, "bsd": 0, "0bsd": 0, "isc": 0, "zlib": 0, "unlicense": 0, "wtfpl": 0, "bsl": 0, "cc0": 0, "cc-by": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1,
    "gpl": 2, "eupl": 2, "cc-by-sa": 2,
    "agpl": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4,
}
_IDENTIFIER = re.compile(r"(?P<family>[a-z0-9]+(?:-(?:by|nc|nd|sa))*)(?:-v?\d+(?:\.\d+)*)?(?:-clause)?(?:-only|-or-later)?\+?")
_REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_EXCEPTION = re.compile(r"[a-z0-9.-]+-exception(?:-[0-9.]+)?|llvm-exception")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

# What a place adds to the belief that the text states a licence.
WEIGHTS = {"base": 0.8, "named": 0.8, "quoted": 0.9, "rights": 0.3, "expression": 0.95}

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_AFTER_TAG = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9.+:-]+)")

SCHEMA = "n_words long, places array<struct<word:long,kind:string,label:string>>, expressions array<struct<word:long,expression:string,labels:array<string>,binding:array<string>,terms:string>>"
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))
_EXPRESSIONS = pa.list_(pa.struct([
    ("word", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("binding", pa.list_(pa.string())), ("terms", pa.string()),
]))


@functools.lru_cache(maxsize=1)
def automaton():
    """All phrases, each between spaces, with what they mean; a phrase may mean several things."""
    import ahocorasick

    phrases: dict[str, list[tuple[str, str, int]]] = {}
    for kind, table in (("base", BASE), ("named", NAMED), ("quoted", QUOTED), ("rights", RIGHTS), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in table.items():
            phrases.setdefault(phrase, []).append((kind, label, phrase.count(" ") + 1))
    found = ahocorasick.Automaton()
    for phrase, meanings in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, meanings))
    found.make_automaton()
    return found


def plain(text: bytes) -> str:
    """The words of a UTF-8 text between single spaces, one character a byte."""
    words = text.translate(_PLAIN)
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return f" {words.strip(b' ').decode('latin-1')} "


def license_of(token: str) -> tuple[str, int] | None:
    """Label and strictness of a licence identifier; a licence of the text's own counts as restricted."""
    if _REFERENCE.fullmatch(token):
        return "other", len(TERMS) - 1
    m = _IDENTIFIER.fullmatch(token)
    family = m["family"] if m else token
    return (family, FAMILIES[family]) if family in FAMILIES else None


def tokens(text: str) -> list[str]:
    """The longest beginning of ``text`` that is a complete expression, as tokens."""
    found: list[str] = []
    complete, depth, at, expects = 0, 0, 0, "licence"
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        if expects == "operator" and token in PRECEDENCE and not (token == "with" and found[-1] == ")"):
            expects = "exception" if token == "with" else "licence"
        elif expects == "operator" and token == ")" and depth:
            depth -= 1
        elif expects == "licence" and token == "(":
            depth += 1
        elif expects == "exception" and _EXCEPTION.fullmatch(token):
            expects = "operator"
        elif expects == "licence" and token not in PRECEDENCE and (license_of(token) or license_of(token.rstrip("."))):
            token = token if license_of(token) else token.rstrip(".")
            expects = "operator"
        else:
            break
        found.append(token)
        if expects == "operator" and not depth:
            complete = len(found)
    return found[:complete]


def evaluate(expression: list[str]) -> tuple[frozenset, frozenset, int]:
    """Labels named, labels that bind, and strictness of a complete expression, by shunting-yard."""
    values: list[tuple[frozenset, frozenset, int]] = []
    operators: list[str] = []

    def reduce() -> None:
        operator = operators.pop()
        (named_b, binding_b, rank_b), (named_a, binding_a, rank_a) = values.pop(), values.pop()
        if operator == "with":
            values.append((named_a, binding_a, max(rank_a - 1, 0)))
        elif operator == "and":
            values.append((named_a | named_b, binding_a | binding_b, max(rank_a, rank_b)))
        else:
            rank = min(rank_a, rank_b)
            binding = (binding_a if rank_a == rank else frozenset()) | (binding_b if rank_b == rank else frozenset())
            values.append((named_a | named_b, binding, rank))

    for token in expression:
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                reduce()
            operators.pop()
        elif token in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                reduce()
            operators.append(token)
        elif operators and operators[-1] == "with":
            values.append((frozenset(), frozenset(), 0))  # the exception
        else:
            label, rank = license_of(token)
            values.append((frozenset([label]), frozenset([label]), rank))
    while operators:
        reduce()
    return values[0]


def _expressions(text: bytes, ends: list[int]) -> list[dict]:
    """The expressions behind tags whose last words have the numbers ``ends``."""
    raw = text.translate(_LOWER)
    found, wanted = [], iter(sorted(set(ends)))
    words = enumerate(_WORD.finditer(raw))
    for want in wanted:
        number, word = next(itertools.islice(((k, w) for k, w in words if k == want), 1))
        stop = min((x for x in (raw.find(b"\n", word.end()), raw.find(b"\r", word.end())) if x >= 0), default=len(raw))
        line = raw[word.end() : stop].decode("latin-1")
        gap = _AFTER_TAG.match(line)
        expression = tokens(line[gap.end() :]) if gap else []
        if expression:
            named, binding, rank = evaluate(expression)
            spelled = " ".join(expression).replace("( ", "(").replace(" )", ")")
            found.append({"word": number + 1, "expression": spelled, "labels": sorted(named), "binding": sorted(binding), "terms": TERMS[rank]})
    return found


def scan_text(text: bytes) -> tuple[int, list[dict], list[dict]]:
    """Number of words, places of phrases by word, and evaluated expressions of one UTF-8 text."""
    words = plain(text)
    n_words = words.count(" ") - 1 if len(words) > 2 else 0
    places, tag_ends = [], []
    at = number = 0
    for end, (length, meanings) in automaton().iter(words):
        # matches come by their end; the words up to the end are counted once
        number += words.count(" ", at, end)
        at = end
        for kind, label, size in meanings:
            if kind == "tag":
                tag_ends.append(number - 1)
            else:
                places.append({"word": number - size, "kind": kind, "label": label})
    return n_words, places, _expressions(text, tag_ends) if tag_ends else []


def _scan(batches):
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        n_words, places, expressions = zip(*(scan_text(t or b"") for t in texts), strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(places, _PLACES), pa.array(expressions, _EXPRESSIONS)],
            names=["doc_id", "n_words", "places", "expressions"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, places (word, kind, label) and expressions with their value."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, {SCHEMA}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, sorted labels, the strictest terms of all expressions and a score per row of ``scan``."""
    base = F.expr("filter(places, p -> p.kind = 'base')")
    weight = "case kind " + " ".join(f"when '{k}' then {w}D" for k, w in WEIGHTS.items()) + " end"
    evidence = F.expr(
        "array_distinct(concat(transform(places, p -> named_struct('kind', p.kind, 'label', p.label)),"
        " flatten(transform(expressions, e -> transform(e.labels, l -> named_struct('kind', 'expression', 'label', l))))))"
    )
    strictest = "case " + " ".join(f"when exists(expressions, e -> e.terms = '{t}') then '{t}'" for t in reversed(TERMS)) + " end"
    return (
        scanned.withColumn("_base", base).withColumn("_evidence", evidence)
        .select(
            "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
            F.array_min("_base.word").alias("first_word"), F.array_max("_base.word").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct("_base.label")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct("_evidence.label")), ",").alias("labels"),
            F.expr(f"1D - aggregate(_evidence, 1D, (p, e) -> p * (1D - {weight.replace('case kind', 'case e.kind')}))").alias("score"),
            F.array_join(F.expr("transform(expressions, e -> e.expression)"), "; ").alias("expressions"),
            F.array_join(F.expr("array_sort(array_distinct(flatten(transform(expressions, e -> e.binding))))"), ",").alias("binding"),
            F.expr(strictest).alias("terms"),
        )
    )
