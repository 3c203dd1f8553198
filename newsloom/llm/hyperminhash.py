"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimate, exact check.

1. Each text becomes the set of its distinct 5-word shingles (hashes of 64 bits). Rows with equal sets
   form one class, so copies are handled once, whatever their number.
2. A class gets 512 registers: the hash's upper bits choose the register, which keeps the smallest hash
   as its number of leading zeros (6 bits) and the 10 bits after the leading one. Small sets use fewer
   registers per permutation and more permutations, so that a band always rests on several shingles; sets
   near the border between two such levels have registers on both.
3. Registers are hashed in bands; classes with an equal band meet. ``banding`` takes the longest bands of which a pair at
   the threshold shares ``LEAST_BANDS`` or more, but for one pair in a million: 64 bands of 8 registers and 3 of them at
   0.85, 85 bands of 6 and 5 of them at 0.8. That many common bands are asked of every pair, whatever the sizes of its bands
   (sets below ``SPARSE`` shingles: one).
4. A class is one row with the array of its shared bands; labels are joined once per class, and only bands that still hold
   different components, and classes in them, go on to the next round. Classes that meet are not all paired. Each class is
   first held against the best connected member of its bands; then only classes that are still in different components
   meet. Pairs inside one component can't change any result, so nothing is lost. In light bands, where at most
   ``PAIRS_PER_PLACE`` members are outside the largest component, these few are joined with all; heavy bands are compared
   in blocks of registers, in numpy, and a pair is looked at only in its first common heavy band.
5. A pair first has its similarity estimated from the registers, corrected for registers that agree by
   chance; pairs far below the threshold (over five standard errors) go. The rest is confirmed on full sets.
6. Components by smallest-label propagation over written tables; component_id is the smallest doc_id.

Defined cases: null, empty or blank text: empty set, linked with nothing. Null doc_id: linked with nothing,
``component_id`` null, ``kept`` false. Rows that repeat a doc_id with different texts are separate members
of the components. ``deduplicate`` keeps of each component the row with the smallest (doc_id, text), once if it is
repeated; rows without words or without a doc_id stay. Other columns are ignored, and kept by ``deduplicate``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch, fresh
from newsloom.llm.tokens import mix, shingle_sets, slices

REGISTERS = 512
LOWEST_BITS = 4
HIGHEST_BITS = 9
MANTISSA_BITS = 10
MISSES = 1e-6
STAR_ROUNDS = 1
ERRORS = 5
LEAST_BANDS = 3
SPARSE = 32
BLOCK = 1024
PAIRS_PER_PLACE = 4
MEMBERS_PER_SLICE = 64

_U = np.uint64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SKETCHES = "array<struct<bits:int,registers:binary>>"
_SKETCH = pa.list_(pa.struct([("bits", pa.int32()), ("registers", pa.binary())]))


def level(n: np.ndarray) -> np.ndarray:
    """Register bits of one permutation for sets of n shingles: two to four shingles a register."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 1, LOWEST_BITS, HIGHEST_BITS)


def registers(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """``REGISTERS`` 16-bit registers per set, over as many permutations as that takes; 0 is empty."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)) * REGISTERS, sizes)
    least = np.full(len(sets) * REGISTERS, _NONE, dtype=np.uint64)
    for k in range(REGISTERS >> bits):
        h = mix(values ^ _U((k + 1) * 0x9E6C63D0876A9A47 % (1 << 64)))
        cell = row + ((k << bits) + (h >> _U(64 - bits)).astype(np.int64))
        np.minimum.at(least, cell, h << _U(bits) >> _U(bits))
    rest = least << _U(bits)
    exact = (rest >> _U(11)).astype(np.float64)  # 53 bits, exact
    zeros = np.where(exact > 0, 53 - np.frexp(exact)[1], 53)
    after = rest << (zeros + 1).astype(np.uint64)
    mantissa = (after >> _U(64 - MANTISSA_BITS)).astype(np.uint16)
    out = ((zeros + 1).astype(np.uint16) << MANTISSA_BITS) | mantissa
    return np.where(least == _NONE, np.uint16(0), out).reshape(len(sets), REGISTERS)


@functools.cache
def banding(threshold: float) -> tuple[int, int]:
    """Registers a band, and the bands that a pair must share: fewer are shared at the threshold with a probability below ``MISSES``."""
    for rows in range(16, 1, -1):
        bands, equal = REGISTERS // rows, threshold**rows
        least, missed = 0, (1 - equal) ** bands
        while missed <= MISSES:
            least += 1
            missed += math.comb(bands, least) * equal**least * (1 - equal) ** (bands - least)
        if least >= LEAST_BANDS:
            return rows, least
    return 1, 1


def band_keys(regs: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """The hash of every band of ``size`` registers; 0 where no register is in use."""
    rows = len(regs)
    bands = REGISTERS // size
    cells = regs[:, : bands * size].reshape(rows, bands, size).astype(np.uint64)
    place = mix(np.arange(1, size + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
    total = (cells * place).sum(axis=2, dtype=np.uint64)
    number = np.arange(1, bands + 1, dtype=np.uint64)[None, :] + (bits.astype(np.uint64) << _U(32))[:, None]
    keys = mix(total + number * _U(0x9E3779B97F4A7C15))
    keys = (keys & ~_U(7)) | (bits.astype(np.uint64) - _U(LOWEST_BITS))[:, None]  # the last bits tell the level
    return np.where(cells.any(axis=2), keys, _U(0))


def chance(n_a: np.ndarray, n_b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets agrees, given that it is in use."""
    m = (1 << bits.astype(np.int64)).astype(np.float64)
    at = np.arange(0, 56, dtype=np.float64)[None, :]
    low, high = 2.0 ** -(at + 1), 2.0**-at
    per = []
    for n in (n_a, n_b):
        load = (n / m)[:, None]
        per.append(np.exp(-load * low) - np.exp(-load * high))
    used = 1 - np.exp(-(n_a + n_b) / m)
    return (per[0] * per[1]).sum(axis=1) / (1 << MANTISSA_BITS) / np.maximum(used, 1e-12)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimate of each pair, and the number of registers it rests on."""
    used = (regs_a != 0) | (regs_b != 0)
    equal = (regs_a == regs_b) & used
    count = np.maximum(used.sum(axis=1), 1)
    by_chance = chance(n_a, n_b, bits)
    return (equal.sum(axis=1) / count - by_chance) / (1 - by_chance), count


def spread(count: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """Standard error at the threshold of a share of ``count`` registers in use.

    The registers of one permutation draw shingles of the union without putting them back, so with k of them in use and
    f shingles the variance is below the binomial one by the factor 1 - (k - 1) / (f - 1); permutations are independent.
    """
    k = count / (REGISTERS >> bits.astype(np.int64))
    f = (n_a + n_b) / (1 + threshold)
    drawn = np.clip(1 - np.maximum(k - 1, 0) / np.maximum(f - 1, 1), 0.25, 1)
    return np.sqrt(threshold * (1 - threshold) / count * drawn)


def near_enough(regs_a, regs_b, n_a, n_b, bits, threshold: float) -> np.ndarray:
    """Whether an estimate is within ``ERRORS`` standard errors of the threshold, or above."""
    value, count = estimate(regs_a, regs_b, n_a, n_b, bits)
    return value >= threshold - ERRORS * spread(count, n_a, n_b, bits, threshold) - 0.01


def fingerprint(values: np.ndarray, n: int) -> bytes:
    """16 bytes that stand for a set."""
    a = int(mix(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix(values + _U(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return ((a ^ n).to_bytes(8, "little")) + b.to_bytes(8, "little")


def _describe(threshold: float):
    def describe(batches):
        """Per row its class and set size; per class of a slice also its registers, on one or two levels."""
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            names = [fingerprint(s, len(s)) if len(s) else None for s in sets]
            bits = level(n)
            lower = (bits > LOWEST_BITS) & (n * threshold < (1 << (bits + 1)))
            found: dict[int, list] = {i: [] for i in range(len(sets))}
            for b in range(LOWEST_BITS, HIGHEST_BITS + 1):
                rows = np.flatnonzero((n > 0) & ((bits == b) | lower & (bits == b + 1)))
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    for i, regs in zip(part, registers([sets[i] for i in part], b), strict=True):
                        found[i].append({"bits": b, "registers": regs.tobytes()})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array(names, pa.binary()), pa.array(list(found.values()), _SKETCH)],
                names=["doc_id", "key", "n_shingles", "mark", "sketches"],
            )

    return describe


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _bands(size: int):
    def bands(batches):
        """Per class the keys of all its bands, on one or two levels."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column("sketches")
                each = column.flatten()
                owner = np.repeat(np.arange(len(part)), np.diff(column.offsets.to_numpy()))
                keys = band_keys(_rows_of(each.field("registers")), each.field("bits").to_numpy(), size)
                row, band = np.nonzero(keys)
                edges = np.searchsorted(owner[row], np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[row, band].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("class"), lists], names=["class", "keys"])

    return bands


def _several(keys_a: np.ndarray, keys_b: np.ndarray, n_a, n_b, least: int) -> np.ndarray:
    """Whether pairs share enough bands."""
    same = ((keys_a == keys_b) & (keys_a != 0)).sum(axis=1)
    return same >= np.where(np.minimum(n_a, n_b) < SPARSE, 1, least)


def _plausible(threshold: float):
    size, least = banding(threshold)

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n_a, n_b = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                bits, a, b = part.column("bits").to_numpy(), _rows_of(part.column("regs_a")), _rows_of(part.column("regs_b"))
                good = _several(band_keys(a, bits, size), band_keys(b, bits, size), n_a, n_b, least) & near_enough(a, b, n_a, n_b, bits, threshold)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return keep


def _block(threshold: float):
    size, least = banding(threshold)

    def pairs(band: int, left: int, table: pa.Table) -> pa.RecordBatch:
        """Slice ``left`` of one heavy band and another one: pairs of different labels that are plausible, each in its first common heavy band only."""
        names, label, n, bits, slot = (table[c].to_numpy() for c in ("class", "label", "n_shingles", "bits", "slice"))
        regs = _rows_of(table["registers"])
        keys = band_keys(regs, bits, size)
        heavy = np.isin(keys, np.unique(pa.compute.list_flatten(table["heavy"]).to_numpy()).view(np.uint64))
        here = np.array([band], dtype=np.int64).view(np.uint64)[0]
        found_a, found_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        other = np.flatnonzero(slot != left) if (slot != left).any() else None
        for i in np.flatnonzero(slot == left):
            with_i = other if other is not None else np.arange(i + 1, len(names))
            with_i = with_i[(label[with_i] != label[i]) & (np.minimum(n[with_i], n[i]) >= threshold * np.maximum(n[with_i], n[i]) - 1e-9)]
            if not len(with_i):
                continue
            own = np.broadcast_to(keys[i], (len(with_i), keys.shape[1]))
            first = keys[i][((keys[with_i] == own) & heavy[i]).argmax(axis=1)] == here
            with_i = with_i[first & _several(own, keys[with_i], n[i], n[with_i], least)]
            if len(with_i):
                good = near_enough(np.broadcast_to(regs[i], (len(with_i), REGISTERS)), regs[with_i], np.full(len(with_i), n[i]), n[with_i], bits[with_i], threshold)
                found_a.append(np.full(int(good.sum()), names[i]))
                found_b.append(names[with_i[good]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a), pa.int64()), pa.array(np.concatenate(found_b), pa.int64())], names=["a", "b"])

    def blocks(batches):
        """Rows arrive in order of band and slices; one block of at most two slices is held at a time."""
        key, held = None, []
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("band", "left", "right")])
            edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if key != (now := tuple(ids[:, a].tolist())):
                        if held:
                            yield pairs(key[0], key[1], pa.Table.from_batches(held))
                        key, held = now, []
                    held.append(batch.slice(a, b - a))
        if held:
            yield pairs(key[0], key[1], pa.Table.from_batches(held))

    return blocks


def _confirm(percent: int):
    def check(key, table):
        """Rows of one hub and some of its members: the links that hold on full sets."""
        hub, found = key[0].as_py(), []
        base = None
        for want_hub in (True, False):
            rows = table.filter(pa.compute.equal(table["hub"], want_hub)) if table.num_rows else table
            for batch in slices(rows.to_batches()):
                for name, mark, values in zip(batch.column("class").to_pylist(), batch.column("mark").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                    if not len(values) or fingerprint(values, len(values)) != mark:
                        continue  # another text under the same doc_id
                    if want_hub:
                        base = values
                        break
                    if base is None:
                        continue
                    both = len(np.intersect1d(base, values, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(values) - both):
                        found.append(name)
                if want_hub and base is not None:
                    break
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return check


def _sketches(classes: DataFrame, *more: str) -> DataFrame:
    return classes.select("class", "n_shingles", *more, F.explode("sketches").alias("s")).select("class", "n_shingles", *more, "s.bits", "s.registers")


def _near(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b), those whose registers allow the threshold."""
    described = _sketches(classes).select("class", "bits", "registers")
    # the smaller set's own level; the larger one has registers there as well
    bits = F.greatest(F.lit(LOWEST_BITS), F.least(F.lit(HIGHEST_BITS), F.floor(F.log2(F.least("n_a", "n_b"))).cast("int") - 1))
    rows = pairs.withColumn("bits", bits).join(described.toDF("a", "bits", "regs_a"), ["a", "bits"]).join(described.toDF("b", "bits", "regs_b"), ["b", "bits"])
    return rows.mapInArrow(_plausible(percent / 100), "a long, b long")


def _links(scratch: Scratch, docs: DataFrame, classes: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    sizes = F.count(F.lit(1)).over(Window.partitionBy("a"))
    slices = F.ceil(sizes / F.lit(float(MEMBERS_PER_SLICE)))
    sliced = scratch.table(near.distinct().withColumn("slices", slices).select("a", "b", F.expr("cast(pmod(xxhash64(b), slices) as int)").alias("slice")), "near")
    needs = scratch.table(
        sliced.select("a", "slice", F.col("b").alias("class"), F.lit(False).alias("hub"))
        .union(sliced.select("a", "slice", F.col("a").alias("class"), F.lit(True).alias("hub")).distinct())
        .join(classes.select("class", "mark", F.col("first_id").alias("doc_id")), "class"),
        "needs",
    )
    ids = scratch.table(needs.select("doc_id").distinct(), "ids")
    texts = docs.select("doc_id", "text").join(scratch.small(ids, 2 << 20), "doc_id", "left_semi").join(needs, "doc_id")
    found = texts.select("a", "slice", "class", "mark", "hub", "text").groupBy("a", "slice").applyInArrow(_confirm(percent), "a long, b long")
    links = scratch.table(found.distinct(), "links")
    for table in (sliced, needs, ids):
        scratch.drop(table)
    return links


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Smallest member of each component for all ends of ``edges`` (a, b): columns class, label."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.lit(0).cast("long").alias("old")), "labels")
    while True:
        now = labels.select("class", "label")
        near = both.join(now.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.min("label").alias("near"))
        lower = now.join(near, "class").select("class", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = now.select(F.col("class").alias("label"), F.col("label").alias("further"))
        step = scratch.table(lower.join(jump, "label", "left").select("class", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        scratch.drop(labels)
        labels = step
        if step.where("label <> old").isEmpty():
            scratch.drop(both)
            return step.select("class", "label")


def _of(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows``, one per class, with the class's label: its own number until it has links."""
    if labels is None:
        return rows.withColumn("label", F.col("class"))
    return rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _open(scratch: Scratch, held: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Bands that hold several labels, and the rows (band, class) in them."""
    rows = scratch.table(_of(labels, held).select("class", "label", "degree", "n_shingles", F.explode("bands").alias("band")), "rows")
    spread = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "class", "n_shingles")).alias("top"))
    found = spread.groupBy("band").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), F.max(F.struct("top", "label")).alias("best")
    ).where("labels > 1")
    pivot = F.struct(F.col("best.top.degree").alias("degree"), F.col("best.top.class").alias("class"), F.col("best.top.n_shingles").alias("n"), F.col("best.label").alias("label"))
    open_bands = scratch.table(found.select("band", pivot.alias("pivot"), F.col("most.label").alias("main"), F.expr("size - most.n").alias("others"), "size"), "open")
    here = scratch.table(rows.join(open_bands, "band"), "here")
    scratch.drop(rows)
    return open_bands, here


def _every_pair(here: DataFrame, sketched: DataFrame, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Every pair across labels: (a, b, n_a, n_b) out of light bands, whose pairs are at most a few per place, and (a, b) out of blocks of heavy ones."""
    light = f"others <= {PAIRS_PER_PLACE}"
    x, y = (here.where(light).select("band", "main", F.col("class").alias(k), F.col("label").alias(f"label_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in ("a", "b"))
    met = x.where("label_a <> main").join(y.drop("main"), "band").where("label_a <> label_b and (label_b = main or a < b)").where(_fits(percent))
    swap = F.col("a") > F.col("b")
    ends = {c: F.when(swap, F.col(c[:-1] + "ba"[c[-1] == "b"])).otherwise(F.col(c)) for c in ("a", "b", "n_a", "n_b")}
    pairs = met.select(*(v.alias(c) for c, v in ends.items())).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    pairs = pairs.where(f"common >= {least} or least(n_a, n_b) < {SPARSE}").drop("common")
    # a class meets its registers once, then goes to its heavy bands; at most the bands of a class
    heavy = here.where(f"not {light}").groupBy("class").agg(
        F.first("label").alias("label"), F.collect_list(F.struct("band", F.expr(f"cast(ceil(size / {BLOCK}.0) as int)").alias("slices"))).alias("heavy")
    )
    rows = _sketches(heavy.join(sketched, "class"), "label", "heavy")
    rows = rows.select("class", "label", "n_shingles", "bits", "registers", F.col("heavy.band").alias("heavy"), F.explode("heavy").alias("at"))
    rows = rows.where(f"(at.band & 7) + {LOWEST_BITS} = bits").withColumn("slice", F.expr("cast(pmod(xxhash64(class), at.slices) as int)"))
    rows = rows.select("*", F.col("at.band").alias("band"), F.explode(F.expr("sequence(0, at.slices - 1)")).alias("with")).drop("at")
    rows = rows.withColumn("left", F.least("slice", "with").cast("long")).withColumn("right", F.greatest("slice", "with").cast("long"))
    ordered = rows.drop("with").repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")
    return pairs, ordered.mapInArrow(_block(percent / 100), "a long, b long")


def _fits(percent: int) -> str:
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def _stars(here: DataFrame, percent: int, first: bool) -> DataFrame:
    """(a, b, n_a, n_b): classes b against the best connected member of their bands; of all their bands in the first round."""
    rows = here.where("label <> pivot.label").select("class", "n_shingles", "pivot")
    if first:
        rows = rows.groupBy("class").agg(F.max("pivot").alias("pivot"), F.first("n_shingles").alias("n_shingles"))
    return rows.select(F.col("pivot.class").alias("a"), F.col("class").alias("b"), F.col("pivot.n").alias("n_a"), F.col("n_shingles").alias("n_b")).distinct().where(_fits(percent))


def _grouped(scratch: Scratch, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, mark) of ``docs`` (doc_id, text, key), and the component of each mark (mark, label, first_id)."""
    size, least = banding(percent / 100)
    wide = scratch.table(docs.mapInArrow(_describe(percent / 100), f"doc_id long, key string, n_shingles long, mark binary, sketches {_SKETCHES}"), "wide")
    rows = scratch.table(wide.drop("sketches"), "marks")
    linkable = wide.where("mark is not null and doc_id is not null")
    classes = scratch.table(
        linkable.groupBy("mark").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches"))
        .withColumn("class", F.monotonically_increasing_id()), "classes",
    )
    scratch.drop(wide)
    keyed = scratch.table(classes.select("class", "sketches").mapInArrow(_bands(size), "class long, keys array<bigint>"), "bands")
    single = keyed.select("class", F.explode("keys").alias("band"))
    shared = single.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = single.join(shared, "band").groupBy("class").agg(F.collect_list("band").alias("bands"), F.sum("size").alias("degree"))
    held = scratch.table(met, "held")
    scratch.drop(keyed)
    # from here on registers are needed of classes that meet others only
    sketched = scratch.table(classes.select("class", "n_shingles", "sketches").join(scratch.small(scratch.table(held.select("class"), "ids")), "class", "left_semi"), "sketched")
    names = scratch.table(classes.drop("sketches"), "names")
    scratch.drop(classes)
    held = scratch.table(held.join(sketched.select("class", "n_shingles"), "class"), "held")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    stars = 0
    while True:
        open_bands, here = _open(scratch, held, labels)
        heavy = open_bands.agg(F.expr(f"count_if(others > {PAIRS_PER_PLACE})"), F.count(F.lit(1))).first()
        scratch.drop(open_bands)
        if not heavy[1]:
            break
        last = not heavy[0] or stars >= STAR_ROUNDS
        pairs, blocks = _every_pair(here, sketched, percent, least) if last else (_stars(here, percent, labels is None), None)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, "pairs")
        near = _near(sketched, pairs, percent)
        found = _links(scratch, docs, names, near.union(blocks) if last else near, percent)
        links = found if links is None else links.union(found)
        labels = components(scratch, links)
        if last:
            break
        # only classes of open bands, with these bands, are looked at again
        next_held = here.groupBy("class").agg(F.collect_list("band").alias("bands"), F.first("degree").alias("degree"), F.first("n_shingles").alias("n_shingles"))
        next_held = scratch.table(next_held, "held")
        for table in (held, here):
            scratch.drop(table)
        held = next_held
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        stars += 1
    return rows, _of(labels, names.select("class", "mark", "first_id")).select("mark", "label", "first_id")


def _source(docs: DataFrame, key) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows, smallest = _grouped(scratch, _source(docs, F.lit(None).cast("string")), percent)
    least = smallest.groupBy("label").agg(F.min("first_id").alias("smallest"))
    named = rows.join(smallest.join(least, "label").select("mark", "smallest"), "mark", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("smallest", "doc_id"))
    return (
        named.withColumn("component_id", own)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component left; all columns stay."""
    scratch = Scratch(docs.sparkSession, "dedup")
    key = F.md5(F.col("text").cast("string").cast("binary"))
    rows, smallest = _grouped(scratch, _source(docs, key), percent)
    members = scratch.table(rows.where("doc_id is not null and mark is not null").join(smallest, "mark").select("doc_id", "key", "label"), "members")
    chosen = members.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # rows that go, or of which one goes; a row is known by its id and text
    judged = members.join(chosen, "label").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"), F.max(F.expr("best.doc_id = doc_id and best.key = key")).alias("stays"))
    judged = scratch.table(judged.where("not stays or times > 1"), "judged")
    names = {c: fresh(docs, c) for c in ("doc_id", "key")}

    def of(part: DataFrame, how: str) -> DataFrame:
        part = scratch.small(scratch.table(part.select(*(F.col(c).alias(n) for c, n in names.items())), "part"))
        return docs.join(part, (docs["doc_id"].cast("long") == part[names["doc_id"]]) & (F.md5(docs["text"].cast("string").cast("binary")) == part[names["key"]]), how)

    once = of(judged, "left_anti")
    return once.unionByName(of(judged.where("stays"), "left_semi").dropDuplicates(["doc_id", "text"]))
