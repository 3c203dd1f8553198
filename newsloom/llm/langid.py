"""Language identification as a mixture of languages, fitted per document by expectation-maximisation.

Training counts byte trigrams inside words (letters only, A-Z lowered, borders count as a space) per
language over all training rows; a trigram falls into one of 2^15 buckets. A document's words are the
units: each has a likelihood under every language, and EM finds the languages' shares. The set of
languages grows, in order of their shares in a fit of all, up to all learned ones: of the sets, the one with the largest
log-likelihood less ``PENALTY * log(words)`` for each further language is chosen. The set and its shares are returned; the
prediction is the language with the largest share, the score that share.

Defined cases: null text or one without a letter: ``und``, score 0, no languages. No training rows: ``und`` for all.
Languages whose name is null teach nothing. Equal shares: the name that sorts first. Rows are judged one by one: repeated
rows and null ids get what their text gets; an empty table gives no rows; kept columns may have any names but those of the
results, which the caller chooses; a text is never cut. The table of ``BUCKETS`` log-probabilities a language is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import ship
from newsloom.llm.tokens import LOWER, slices, utf8

BUCKETS = 1 << 15
ROUNDS = 15
PENALTY = 3.0
SMOOTHING = 0.5
LEAST_SHARE = 0.001

_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def word_trigrams(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams; the first trigram of each word; the words before each text."""
    data, off = utf8(arr)
    n = len(data)
    norm = _KEEP[LOWER[data]]
    left, right = np.empty_like(norm), np.empty_like(norm)
    left[1:], right[:-1] = norm[:-1], norm[1:]
    full = off[1:] > off[:-1]
    if n:
        left[off[:-1][full]] = 32
        right[off[1:][full] - 1] = 32
    at = np.flatnonzero(norm != 32)
    code = (left[at].astype(np.uint32) << np.uint32(16)) | (norm[at].astype(np.uint32) << np.uint32(8)) | right[at]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    first = np.flatnonzero(left[at] == 32)
    return bucket.astype(np.int32), first, np.searchsorted(at[first], off)


def _count(batches):
    """(lang, bucket, n) summed over the partition, for as few languages as it holds."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        bucket, first, before = word_trigrams(batch.column("text"))
        edges = np.append(first, len(bucket))[before]
        names = batch.column("lang").to_pylist()
        for i, name in enumerate(names):
            part = bucket[edges[i] : edges[i + 1]]
            if len(part):
                if name not in held:
                    held[name] = np.zeros(BUCKETS, dtype=np.int64)
                total = held[name]
                if len(part) > BUCKETS // 8:
                    total += np.bincount(part, minlength=BUCKETS)
                else:
                    np.add.at(total, part, 1)
    for name, total in held.items():
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(total[where])], names=["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and log-probabilities (bucket, language), from (text, lang)."""
    ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    # bounded by the number of languages times BUCKETS
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((BUCKETS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    if names:
        table[counts["bucket"].to_numpy(), [place[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    table += SMOOTHING
    return names, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _shares(units: np.ndarray, owner: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for several documents at once: shares per document, and its log-likelihood beyond the units' maxima."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = units * share[owner]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, starts, axis=0) / counts[:, None]
    fit = np.log(np.maximum((units * share[owner]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(fit, starts)


def mixture(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Language shares of each document; scores: log-likelihood of each word under each language."""
    size = scores.shape[1]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(counts)), counts)
    units = np.exp(scores - scores.max(axis=1, keepdims=True))
    everything, _ = _shares(units, owner, starts, counts, np.ones((len(counts), size), dtype=np.float32))
    alone = np.add.reduceat(np.log(np.maximum(units, 1e-30)), starts, axis=0)
    best = alone.argmax(axis=1)
    out = np.zeros((len(counts), size))
    out[np.arange(len(counts)), best] = 1.0
    value = alone.max(axis=1)
    order = np.argsort(-everything, axis=1, kind="stable")
    for k in range(2, size + 1):
        # words of no share can't raise the likelihood of a larger set
        mixed = np.flatnonzero(everything[np.arange(len(counts)), order[:, k - 1]] > LEAST_SHARE)
        if not len(mixed):
            break
        allowed = np.zeros((len(mixed), size), dtype=np.float32)
        np.put_along_axis(allowed, order[mixed, :k], 1, axis=1)
        rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in mixed])
        own = np.concatenate([[0], np.cumsum(counts[mixed])[:-1]])
        share, fit = _shares(units[rows], np.repeat(np.arange(len(mixed)), counts[mixed]), own, counts[mixed], allowed)
        fit = fit - PENALTY * (k - 1) * np.log(counts[mixed] + 1)
        better = fit > value[mixed]
        out[mixed[better]], value[mixed[better]] = share[better], fit[better]
    return out


def _predict(model, keep: list[str], results: tuple[str, str, str]):
    def predict(batches):
        names, table = model.value
        for batch in slices(batches):
            column = batch.column("text")
            bucket, first, before = word_trigrams(column)
            counts = np.diff(before)
            label, score = np.full(len(counts), "und", dtype=object), np.zeros(len(counts))
            languages: list[list] = [[] for _ in range(len(counts))]
            some = np.flatnonzero(counts)
            if len(some) and names:
                scores = np.stack([np.add.reduceat(table[:, i][bucket], first) for i in range(len(names))], axis=1)
                share = mixture(scores, counts[some])
                label[some] = np.array(names, dtype=object)[share.argmax(axis=1)]
                score[some] = np.clip(share.max(axis=1), 0, 1)
                order = np.argsort(-share, axis=1, kind="stable")
                for i, own, places, n in zip(some, share, order, (share > 0).sum(axis=1), strict=True):
                    languages[i] = [{"lang": names[j], "share": float(own[j])} for j in places[:n]]
                data, off = utf8(column)
                plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
                for i in some[(plain[off[1:]] == plain[off[:-1]])[some]]:  # letters beyond A-Z only, if any
                    if not any(c.isalpha() for c in column[int(i)].as_py()):
                        label[i], score[i], languages[i] = "und", 0.0, []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score), pa.array(languages, _LANGUAGES)], names=[*keep, *results]
            )

    return predict


_LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(docs: DataFrame, learn: Column, keep: list[str], results: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """``keep`` columns of ``docs`` with the language, its share, and all languages of the chosen set with theirs; rows where ``learn`` holds teach."""
    names, table = train(docs.where(learn).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = docs.sparkSession.sparkContext.broadcast((names, np.asfortranarray(table)))
    fields = [docs.schema[c] for c in keep]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    source = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("text", F.col("text").cast("string"))
    return source.mapInArrow(_predict(model, keep, results), f"{kept}, `{results[0]}` string, `{results[1]}` double, `{results[2]}` array<struct<lang:string,share:double>>")
