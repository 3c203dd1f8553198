"""Defined cases of toxicity and language: null and repeated ids, null and very long texts, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import langid, toxicity
from newsloom.llm.runtime import id_crc

SCHEMA = "doc_id long, text string, lang string, score double, held_out boolean, predicted int, toxic int, lang_pred string, languages string, x double, pair long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    plain = {"en": "the house and water with thing shall".split(), "de": "der und schön zwischen über straße nicht".split()}
    out = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        said = [rng.choice(plain[lang]) for _ in range(25)] + (["vile"] * 3 if i % 3 == 0 else [])
        out.append((i, " ".join(said), lang))
    out += [(None, "the vile vile vile house and water", "en"), (None, "the house and water", None), (7, out[7][1], "en"), (7, "der und nicht " * 60000 + "vile", "de")]
    return out + [(1000, None, "en"), (1001, "", None), (1002, " \n", "de"), (1003, "123 456", "en"), (1004, "日本 語", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.3, True, 9, 7, "zz", "y", 1.0, 2) for i, t, lang in rows], SCHEMA).repartition(3)


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0.1, "t") for i in range(240)] + [(7, None, 0.1, "t"), (None, 1, 0.1, "t"), (1, 5, 0.1, "t")], "doc_id long, toxic int, score double, text string")
    got = toxicity.score(docs, labels, id_crc() % 5 != 0)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[None]) == 2 and sorted(r.predicted for r in by[None]) == [0, 1]
    assert len(by[7]) == 3 and len({by[k][0].score for k in (1000, 1001, 1002)}) == 1
    assert sum(by[i][0].predicted == (i % 3 == 0) for i in range(240) if i != 7) >= 235
    assert toxicity.score(docs.limit(0), labels, id_crc() % 5 != 0).count() == 0
    for one in (0, 1):  # a single class: its proportion
        assert {r.score for r in toxicity.score(docs, labels.where(f"toxic = {one}"), F.lit(True)).collect()} == {float(one)}
    assert {r.score for r in toxicity.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_language(docs, rows):
    keep = docs.columns
    names = ("own_pred", "own_score", "own_languages")
    got = langid.identify(docs, id_crc() % 4 != 2, keep, names)
    assert got.columns == [*keep, *names]
    found = got.collect()
    assert len(found) == len(rows) and {(r.score, r.lang_pred, r.languages) for r in found} == {(0.3, "zz", "y")}
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.own_pred)
    assert by[None] == ["en", "en"] and sorted(by[7]) == ["de", "en", "en"]
    assert [by[k] for k in (1000, 1001, 1002, 1003)] == [["und"]] * 4 and by[1004] != ["und"]
    assert langid.identify(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}
