"""A bigram language model in sharded Elias-Fano tries.

Texts are dealt into blocks of a few megabytes, words and word pairs into shards. Each block sends its distinct
words and pairs, with their counts in training texts, to their shards: once per block, so a frequent word
costs a shard one entry per block. A shard adds the counts up, builds its trie (contexts, monotone pointers,
successors with quantised probabilities), maps it into memory and answers every block's words and pairs by
context-relative successor search. The block then scores its texts. Nothing but two totals and the list of
words above one in ``HOT`` of all tokens (so at most that many) passes the driver; pairs of such words are dealt
by both words.

The probability is a bigram with a Dirichlet prior: p(w | v) = (c(vw) + MU p(w)) / (c(v) + MU), with
p(w) = (c(w) + 1) / (N + V + 1). The trie stores log10(c(vw) / (c(v) + MU)) in steps of 1/2048.

Words are known by 64-bit hashes, successors of a context by 40 bits. Defined cases: null text is the empty text,
which has the end token only; a null doc_id counts as the empty id; repeated rows are counted and scored as often
as they come; without training texts every count is 0.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.elias_fano import MISSING, SCALE, Trie, quantise
from newsloom.llm.runtime import Scratch, text_bytes
from newsloom.llm.tokens import mix, slices, words

MU = 300.0
HOT = 1000
BLOCK_BYTES = 10 << 20

_U = np.uint64
END = _U(0x2545F4914F6CDD1D)
BEGIN = _U(0x9E6D62D06F6A9A9B)
_FINGERPRINT = _U((1 << 40) - 1)


def token_stream(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a text column with an end after each text, the token before each, and where texts begin."""
    hashes, before = words(arr)
    texts = len(before) - 1
    starts = before[:-1] + np.arange(texts)
    tokens = np.empty(len(hashes) + texts, dtype=np.uint64)
    ends = before[1:] + np.arange(texts)
    tokens[ends] = END
    inside = np.ones(len(tokens), dtype=bool)
    inside[ends] = False
    tokens[inside] = hashes
    left = np.empty_like(tokens)
    left[1:] = tokens[:-1]
    left[starts] = BEGIN
    return tokens, left, starts


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _vocabulary(batches):
    """(word, n) of training texts."""
    for batch in slices(batches, limit=8 << 20):
        keys, n = np.unique(token_stream(batch.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([_long(keys), pa.array(n.astype(np.int64))], names=["word", "n"])


class _Block:
    """Distinct words and pairs of a block and where its tokens have them; the same each time it is computed."""

    def __init__(self, table: pa.Table, shards: int, hot: np.ndarray):
        table = table.sort_by("row")
        self.table = table
        parts = [token_stream(b.column("text")) for b in slices(table.to_batches())]
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        tokens = np.concatenate([p[0] for p in parts])
        left = np.concatenate([p[1] for p in parts])
        self.starts = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
        self.lengths = np.diff(np.append(self.starts, len(tokens)))
        train = np.repeat(~table["held_out"].to_numpy(), self.lengths)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.word_n = np.bincount(self.word, weights=train, minlength=len(self.words)).astype(np.int64)
        begin = len(self.words)
        position = np.empty(len(tokens), dtype=np.int64)
        position[1:] = self.word[:-1]
        position[self.starts] = begin
        key = (position << 32) | self.word
        pairs, self.pair = np.unique(key, return_inverse=True)
        self.pair_n = np.bincount(self.pair, weights=train, minlength=len(pairs)).astype(np.int64)
        self.left, self.right = pairs >> 32, pairs & 0xFFFFFFFF
        names = np.append(self.words, BEGIN)
        is_hot = np.append(np.isin(self.words, hot), True)
        v, w = names[self.left], self.words[self.right]
        dealt = np.where(is_hot[self.left], mix(v ^ (w * _U(0xD1342543DE82EF95))), v)
        self.word_shard = (self.words % _U(shards)).astype(np.int64)
        self.pair_shard = (dealt % _U(shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.argsort(self.pair_shard, kind="stable")  # by context within a shard
        self.names, self.v, self.finger = names, v, mix(w) & _FINGERPRINT


def _ask(shards: int, hot: np.ndarray):
    def ask(key, table):
        b = _Block(table, shards, hot)
        word_edges = np.searchsorted(b.word_shard[b.word_order], np.arange(shards + 1))
        pair_edges = np.searchsorted(b.pair_shard[b.pair_order], np.arange(shards + 1))
        used = np.flatnonzero((np.diff(word_edges) > 0) | (np.diff(pair_edges) > 0))
        columns: dict[str, list] = {k: [] for k in ("words", "word_n", "contexts", "context_n", "fingers", "pair_n")}
        for s in used:
            rows = b.word_order[word_edges[s] : word_edges[s + 1]]
            columns["words"].append(b.words[rows].tobytes())
            columns["word_n"].append(b.word_n[rows].astype("<u4").tobytes())
            rows = b.pair_order[pair_edges[s] : pair_edges[s + 1]]
            v = b.v[rows]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, dtype=np.int64)
            columns["contexts"].append(v[first].tobytes())
            columns["context_n"].append(np.diff(np.append(first, len(v))).astype("<u4").tobytes())
            columns["fingers"].append(np.ascontiguousarray(b.finger[rows].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
            columns["pair_n"].append(b.pair_n[rows].astype("<u4").tobytes())
        return pa.table(
            {"shard": pa.array(used.astype(np.int32)), "block": pa.array([key[0].as_py()] * len(used), pa.int32())} | {k: pa.array(x, pa.binary()) for k, x in columns.items()}
        )

    return ask


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, dtype=kind) for x in table[name].to_pylist()]
    return np.concatenate(parts), np.cumsum([0, *(len(p) for p in parts)])


def _answer(hot_words: np.ndarray, hot_counts: np.ndarray, texts: int):
    order = np.argsort(hot_words)
    hot_words, hot_counts = hot_words[order], hot_counts[order]

    def answer(key, table):
        asked, word_edges = _joined(table, "words", np.uint64)
        n, _ = _joined(table, "word_n", "<u4")
        _, which = np.unique(asked, return_inverse=True)
        total = np.bincount(which, weights=n).astype(np.uint64)[which] if len(asked) else np.empty(0, dtype=np.uint64)

        contexts, context_edges = _joined(table, "contexts", np.uint64)
        lengths, _ = _joined(table, "context_n", "<u4")
        pair_n, pair_edges = _joined(table, "pair_n", "<u4")
        fingers = np.zeros((len(pair_n), 8), dtype=np.uint8)
        fingers[:, :5] = _joined(table, "fingers", np.uint8)[0].reshape(-1, 5)
        fingers = fingers.view(np.uint64).reshape(-1)
        names, place = np.unique(contexts, return_inverse=True)
        owner = np.repeat(place, lengths)
        trained = np.flatnonzero(pair_n)
        keys, slot = np.unique((owner[trained].astype(np.uint64) << _U(40)) | fingers[trained], return_inverse=True)
        count = np.bincount(slot, weights=pair_n[trained], minlength=len(keys))
        context = (keys >> _U(40)).astype(np.int64)
        of = np.bincount(context, weights=count, minlength=len(names))  # c(v): all pairs of v are here, unless v is hot
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, names), len(hot_words) - 1)
            of = np.where(hot_words[at] == names, hot_counts[at], of)
        of = np.where(names == BEGIN, texts, of)
        codes = quantise(np.log10(count / (of[context] + MU)))
        seen, starts = np.unique(context, return_index=True)
        trie = Trie.build(names[seen], np.diff(np.append(starts, len(keys))), keys & _FINGERPRINT, codes)
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            trie.save(path)
            found = Trie.mapped(path).search(names, owner, fingers) if len(keys) else np.full(len(owner), MISSING, dtype=np.uint16)
        finally:
            os.unlink(path)
        rows = range(table.num_rows)
        return pa.table(
            {
                "block": table["block"],
                "shard": table["shard"],
                "counts": pa.array([total[word_edges[i] : word_edges[i + 1]].tobytes() for i in rows], pa.binary()),
                "codes": pa.array([found[pair_edges[i] : pair_edges[i + 1]].tobytes() for i in rows], pa.binary()),
            }
        )

    return answer


def _score(shards: int, hot: np.ndarray, total: int, kinds: int, texts: int):
    def score(docs, answers):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [docs.schema.field("doc_id").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)})
        b = _Block(docs, shards, hot)
        answers = answers.sort_by("shard")
        count, code = np.zeros(len(b.words)), np.full(len(b.left), MISSING, dtype=np.uint16)
        count[b.word_order] = _joined(answers, "counts", np.uint64)[0]
        code[b.pair_order] = _joined(answers, "codes", np.uint16)[0]
        alone = np.log10((count + 1) / (total + kinds + 1))
        before = np.append(count, texts)[b.left]
        seen = np.where(code == MISSING, 0.0, 10.0 ** (-code.astype(np.float64) / SCALE))
        joint = np.log10(seen + MU / (before + MU) * 10.0 ** alone[b.right])
        per_text = lambda values: np.add.reduceat(values, b.starts)
        rows = len(b.starts)
        out = [
            b.table["doc_id"], b.table["held_out"], pa.array(b.lengths.astype(np.int64)), pa.array(per_text((count > 0)[b.word].astype(np.int64))),
            pa.array(np.full(rows, total, dtype=np.int64)), pa.array(per_text(alone[b.word])), pa.array(per_text(joint[b.pair])),
        ]
        return pa.table(dict(zip(names, out, strict=True)))

    return score


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where ``learn`` holds are learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~learn).alias("held_out"))
    blocks = max(1, -(-text_bytes(rows) // BLOCK_BYTES))
    counted = rows.where("not held_out").select("text").mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = scratch.table(counted, "vocabulary")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.max(F.when(F.col("word") == int(END.astype(np.int64)), F.col("n"))), F.lit(0)).alias("texts")).first()
    frequent = vocabulary.where(F.col("n") * HOT > F.lit(totals["total"])).collect()  # fewer than HOT words
    hot = np.array([r.word for r in frequent], dtype=np.int64).view(np.uint64)
    hot_n = np.array([r.n for r in frequent], dtype=np.float64)

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.expr(f"cast(pmod(xxhash64(row), {blocks}) as int)"))
    asked = dealt.groupBy("block").applyInArrow(
        _ask(blocks, hot), "shard int, block int, words binary, word_n binary, contexts binary, context_n binary, fingers binary, pair_n binary"
    )
    answers = asked.groupBy("shard").applyInArrow(_answer(hot, hot_n, totals["texts"]), "block int, shard int, counts binary, codes binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(blocks, hot, totals["total"], totals["kinds"], totals["texts"]),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
