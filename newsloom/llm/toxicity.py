"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Words (runs of letters, digits and characters beyond ASCII, A-Z lowered) and word pairs of a bounded sample of labelled
texts are counted per class, each once a text. Either class's model takes an absolute discount off its own counts (three per order and class,
out of its counts of counts) and gives the discounted mass, and ``strength`` times as much as all of its own, to the counts
of both classes together: of a word that is rare in both, nearly all of the probability is the same in both models and
cancels, while a word of one class differs however rare it is. A pair backs off to the pooled pair times what its two words
say, and its value is what it says beyond them.

A text is not judged by the mean of its values, which a long text thins out and one odd word of a short text fills: the
range of the values of words is cut into ``BANDS``, that of pairs too, and logistic regression weighs how many distinct
expressions of each band a text has (as a logarithm). What many weak signs are worth beside one strong one is so learned from
one in ``APART`` texts of the sample, which the counts leave out, weighted to the labels' real proportion. ``strength`` is the one
of ``STRENGTHS`` with the least loss on those texts, each judged by weights of the others (``FOLDS``). A rising
curve (isotonic regression, interpolated) over the same judgements turns the weighted sum into a score. Nothing is chosen on held-out labels.

The sample: per class the ``SAMPLE`` labelled texts with the smallest hash of their id, in that order until they have
``SAMPLE_CHARS`` characters; pairs are counted on its beginning, up to ``PAIR_CHARS``. Defined cases: null, empty or wordless text,
and one without any counted word: the proportion of toxic labels. Labels that are
null or not 0/1 teach nothing; a doc_id labelled twice counts by its largest label; a null doc_id is scored and teaches
nothing; repeated rows are scored alike and teach as often as they stand there. With one class only, or none, every text
gets that class's proportion (0 without labels). An empty table gives no rows; other columns are ignored, whatever their
names; a text is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch, ship
from newsloom.llm.tokens import mix, slices, span_hashes, utf8, word_bounds

SAMPLE = 16_000
SAMPLE_CHARS = 48_000_000
PAIR_CHARS = 12_000_000
APART = 4
BANDS = 14
STRENGTHS = (0.0, 1.0, 10.0, 100.0)
FOLDS = 5

_U = np.uint64
_FIRST = _U(0x51ED270B7F4A7C15)
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def words(arr) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of words before each text."""
    data, offsets = utf8(arr)
    data = _PLAIN[data]
    starts, ends, before = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), before


def _pairs(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and a hash of both."""
    left = np.empty_like(hashes)
    left[1:] = hashes[:-1]
    starts = before[:-1][np.diff(before) > 0]
    left[starts] = _FIRST
    return left, mix(left * _U(0x9FB21C651E98DF25) + hashes)


def _once(keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands first in each text, and that text: neither a very long text nor a repeated line fills a class."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.unique(mix(keys + owner.astype(np.uint64) * _FIRST), return_index=True)[1]
    return at, owner[at]


def _count_words(batches):
    for batch in slices(batches):
        hashes, before = words(batch.column("text"))
        once, owner = _once(hashes, before)
        toxic = batch.column("toxic").to_numpy()[owner]
        keys, at = np.unique(hashes[once], return_inverse=True)
        n = [np.bincount(at[toxic == c], minlength=len(keys)) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], names=["w", "n0", "n1"])


def _count_pairs(batches):
    for batch in slices(batches):
        hashes, before = words(batch.column("text"))
        left, pair = _pairs(hashes, before)
        once, owner = _once(pair, before)
        toxic = batch.column("toxic").to_numpy()[owner]
        keys, where, at = np.unique(pair[once], return_index=True, return_inverse=True)
        n = [np.bincount(at[toxic == c], minlength=len(keys)) for c in (0, 1)]
        sides = (left[once][where].view(np.int64), hashes[once][where].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x) for x in sides), *(pa.array(x.astype(np.int64)) for x in n)], names=["pair", "v", "w", "n0", "n1"])


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and above, from how many expressions have the counts 1 to 4."""
    one, two, three, four = (max(float(x), 1.0) for x in counts_of_counts)
    y = one / (one + 2 * two)
    return np.array([0.0, *(np.clip(k - (k + 1) * y * after / own, 0.0, k) for k, own, after in ((1, one, two), (2, two, three), (3, three, four)))])


def smoothed(n: list[np.ndarray], totals: list[float], taken: list[np.ndarray], spared: list[float], shared: list[np.ndarray], strength: float) -> list[np.ndarray]:
    """Class probabilities: discounted counts, and the shared ones with ``strength`` and the discounted mass."""
    out = []
    for c in (0, 1):
        off = np.minimum(taken[c][np.minimum(n[c], 3).astype(np.int64)], n[c])
        out.append(((n[c] - off) / totals[c] + (spared[c] / totals[c] + strength) * shared[c]) / (1 + strength))
    return out


class Bands:
    """Expressions by sorted hash, and the band of each one's value, for one or more valuations."""

    def __init__(self, hashes: np.ndarray, valuations: list[np.ndarray]):
        order = np.argsort(hashes)
        self.hashes, self.bands = hashes[order], [_band(values)[order] for values in valuations]

    def counts(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Per text and band, how many distinct expressions it has, as the logarithm of one more; valuations side by side."""
        rows, size = len(before) - 1, len(self.hashes)
        if not size:
            return np.zeros((rows, BANDS * len(self.bands)))
        at = np.minimum(np.searchsorted(self.hashes, hashes), size - 1)
        known = self.hashes[at] == hashes
        key = np.unique(np.repeat(np.arange(rows), np.diff(before))[known] * size + at[known])
        owner, at = key // size * BANDS, key % size
        return np.hstack([np.log1p(np.bincount(owner + band[at], minlength=rows * BANDS).reshape(rows, BANDS)) for band in self.bands])


def _band(values: np.ndarray) -> np.ndarray:
    """Bands of equal width from the smallest to the largest value."""
    edges = np.linspace(values.min(), values.max(), BANDS + 1)[1:-1] if len(values) else []
    return np.digitize(values, edges).astype(np.uint8)


class Words:
    """Both classes' probabilities of words."""

    def __init__(self, hashes: np.ndarray, n: list[np.ndarray], taken: list[np.ndarray], spared: list[float]):
        order = np.argsort(hashes)
        self.hashes, self.n, self.taken, self.spared = hashes[order], [x[order] for x in n], taken, spared

    def ratios(self, strength: float) -> list[np.ndarray]:
        """Of both classes' probabilities to that by all counts."""
        totals = [max(x.sum(), 1.0) for x in self.n]
        shared = (self.n[0] + self.n[1]) / sum(totals)
        return [p / shared for p in smoothed(self.n, totals, self.taken, self.spared, [shared, shared], strength)]

    def values(self, strength: float) -> np.ndarray:
        """Log-likelihood differences, toxic less ordinary."""
        ordinary, toxic = self.ratios(strength)
        return np.log(toxic / ordinary)


def beyond_words(ratios: list[np.ndarray], n: list[np.ndarray], totals: list[float], taken: list[np.ndarray], spared: list[float], strength: float) -> np.ndarray:
    """The differences of pairs beyond those of their words, whose classes' ``ratios`` are multiplied."""
    shared = (n[0] + n[1]) / sum(totals)
    p = smoothed(n, totals, taken, spared, [shared * r for r in ratios], strength)
    return np.log(p[1] / p[0]) - np.log(ratios[1] / ratios[0])


class Model:
    """Bands of words and pairs, and the weights of their counts after that of no evidence."""

    def __init__(self, known: Bands, pairs: Bands, weights: np.ndarray):
        self.known, self.pairs, self.weights = known, pairs, weights

    def counts(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.hstack([self.known.counts(hashes, before), self.pairs.counts(_pairs(hashes, before)[1], before)])

    def weigh(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The weighted sums; NaN for a text without any counted word."""
        x = self.counts(hashes, before)
        return np.where(x[:, :BANDS].any(axis=1), self.weights[0] + x @ self.weights[1:], np.nan)


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise) -> np.ndarray:
    if not len(known) or not len(keys):
        return np.broadcast_to(np.asarray(otherwise, dtype=np.float64), keys.shape)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


def _u64(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a ridge of one on standardised columns; the first weight stands alone."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    ridge = np.concatenate([[0.01], np.ones(x.shape[1])])

    def loss(w):
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w)) + ridge @ w**2 / 2)

    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-9:
            break
    weights = w[1:] / spread
    return np.concatenate([[w[0] - mean @ weights], weights])


def judged_by_others(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each text's weighted sum, with weights that were learned from the other folds."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        own = fold == k
        w = regression(x[~own], y[~own], weight[~own]) if not own.all() else np.zeros(x.shape[1] + 1)
        out[own] = w[0] + x[own] @ w[1:]
    return out


def rising_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: both ends and the value of each block; it is straight between blocks."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([weight[i] * y[i], weight[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            ones, total, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + ones, blocks[-1][1] + total, blocks[-1][2], high]
    table = np.array(blocks)
    return table[:, 2:4].ravel(), np.repeat(table[:, 0] / table[:, 1], 2)


def _chosen(known: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, toxic, apart, paired, place) of the sample."""
    # one top-k per class: each task keeps SAMPLE rows, so no task sorts a whole class
    first, second = (known.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1))
    found = docs.select("doc_id", "text").join(F.broadcast(first.unionByName(second)), "doc_id")  # 2 * SAMPLE ids
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("size")).groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    within = sizes.withColumn("earlier", F.coalesce(F.sum("size").over(order), F.lit(0))).where(f"earlier < {SAMPLE_CHARS}").select("doc_id", "earlier")
    apart = F.expr(f"pmod(hash(doc_id), {APART}) = 0")
    paired = F.col("earlier") < PAIR_CHARS
    place = F.xxhash64("doc_id")
    return scratch.table(found.join(F.broadcast(within), "doc_id").select("text", "toxic", apart.alias("apart"), paired.alias("paired"), place.alias("place")), "sample")


def _counts_of_counts(table: DataFrame) -> list[list[int]]:
    row = table.agg(*(F.count_if(F.col(f"n{c}") == k).alias(f"c{c}{k}") for c in (0, 1) for k in (1, 2, 3, 4)), *(F.count_if(F.col(f"n{c}") > 4).alias(f"m{c}") for c in (0, 1))).first()
    return [[row[f"c{c}{k}"] for k in (1, 2, 3, 4)] + [row[f"m{c}"]] for c in (0, 1)]


def _discounted(table: DataFrame) -> tuple[list[np.ndarray], list[float]]:
    """Discounts of both classes, and the mass that they take."""
    found = _counts_of_counts(table)
    taken = [discounts(f[:4]) for f in found]
    return taken, [float(d[1] * f[0] + d[2] * f[1] + d[3] * sum(f[2:])) for d, f in zip(taken, found, strict=True)]


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[Model | None, tuple[np.ndarray, np.ndarray], float]:
    """The model, the curve from weighted sums to scores, and the share of toxic labels."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.table(known, "labels")
    real = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = real.get(1, 0) / max(sum(real.values()), 1)
    flat = np.zeros(1), np.array([share])
    if len(real) < 2:
        return None, flat, share
    sample = _chosen(known, docs, scratch)
    taught, counts = sample.where("not apart"), [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]
    pairs = taught.where("paired").select("text", "toxic").mapInArrow(_count_pairs, "pair long, v long, w long, n0 long, n1 long")
    pairs = scratch.table(pairs.groupBy("pair", "v", "w").agg(*counts), "pairs")
    each = scratch.table(taught.select("text", "toxic").mapInArrow(_count_words, "w long, n0 long, n1 long").groupBy("w").agg(*counts), "words")
    u = each.toArrow()  # bounded by the sample
    if not u.num_rows:
        return None, flat, share
    known = Words(_u64(u["w"]), _columns(u, "n"), *_discounted(each))
    del u
    # the strength, by words, on the texts that were left out
    apart = sample.where("apart")
    tried = spark.sparkContext.broadcast(Bands(known.hashes, [known.values(s) for s in STRENGTHS]))
    x, y, fold = _counted(apart, tried)
    tried.destroy()
    learned = len(y) > 0 and y.min() != y.max()
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) if learned else None
    strength = STRENGTHS[len(STRENGTHS) // 2]
    if learned:
        losses = []
        for k in range(len(STRENGTHS)):
            sums = judged_by_others(x[:, k * BANDS : (k + 1) * BANDS], y, weight, fold)
            losses.append(float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * sums)))
        strength = STRENGTHS[int(np.argmin(losses))]
    # the pairs are valued where they are; a key and a value of each come to the driver, bounded by the sample
    (taken, spared), ratios = _discounted(pairs), spark.sparkContext.broadcast((known.hashes, known.ratios(0.0)))
    totals = [max(float(n or 0), 1.0) for n in pairs.agg(*counts).first()]
    values = pairs.mapInArrow(_pair_values(ratios, totals, taken, spared, strength), "pair long, value float").toArrow()
    ratios.destroy()
    model = Model(Bands(known.hashes, [known.values(strength)]), Bands(_u64(values["pair"]), [values["value"].to_numpy()]), np.zeros(1 + 2 * BANDS))
    del values
    if not learned:
        return model, flat, share
    sent = spark.sparkContext.broadcast(model)
    x, y, fold = _counted(apart, sent)
    sent.destroy()
    model.weights = regression(x, y, weight)
    x_of, y_of = rising_curve(judged_by_others(x, y, weight, fold), y, weight)
    return model, (x_of, y_of), share


def _counted(texts: DataFrame, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by bands, labels and folds of the texts set aside, in the order of their hash."""
    found = texts.select("text", "toxic", "place").mapInArrow(_counts(known), "toxic int, place long, x array<double>").toArrow().sort_by("place")
    x = np.stack(found["x"].to_numpy(zero_copy_only=False)) if found.num_rows else np.empty((0, 0))
    return x, found["toxic"].to_numpy().astype(np.float64), found["place"].to_numpy() % FOLDS


def _columns(table, name: str) -> list[np.ndarray]:
    return [table[f"{name}{c}"].to_numpy().astype(np.float64) for c in (0, 1)]


def _pair_values(known, totals: list[float], taken: list[np.ndarray], spared: list[float], strength: float):
    def value(batches):
        hashes, ratios = known.value
        for batch in batches:
            v, w = _u64(batch.column("v")), _u64(batch.column("w"))
            both = [_look_up(v, hashes, r, 1.0) * _look_up(w, hashes, r, 1.0) for r in ratios]
            found = beyond_words(both, _columns(batch, "n"), totals, taken, spared, strength)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(found.astype(np.float32))], names=["pair", "value"])

    return value


def _counts(known):
    def count(batches):
        for batch in slices(batches):
            x = known.value.counts(*words(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("place"), lists], names=["toxic", "place", "x"])

    return count


def _score(model, curve: tuple[np.ndarray, np.ndarray], share: float):
    def score(batches):
        for batch in slices(batches):
            x = model.value.weigh(*words(batch.column("text"))) if model else np.full(batch.num_rows, np.nan)
            value = np.clip(np.where(np.isnan(x), share, np.interp(x, *curve)), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return score


def score(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of ids for which ``learn`` holds teach."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model, curve, share = train(source, labels.select("doc_id", "toxic"), learn)
    sent = docs.sparkSession.sparkContext.broadcast(model) if model else None
    rows = source.withColumn("held_out", ~learn)
    return rows.mapInArrow(_score(sent, curve, share), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
