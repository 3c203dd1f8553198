"""Best-fit packing planned on the histogram of lengths.

Each text becomes ids and an end id; only texts longer than a sequence are cut, into full sequences and a
first piece with what is left. The number of pieces of each length is counted, and best-fit decreasing is
run on the driver over these counts (at most ``capacity`` of them): bins of equal free space are ranges of
sequence numbers, so the plan's size follows the lengths, not the documents. A piece's rank among those of
its length then picks its planned slot.

Ranks are counted per written part and shifted by the counts of earlier parts, so no length is ranked in
one task. Defined cases: null text is the empty text (one piece with the end id only); repeated rows are
packed as often as they come; a null doc_id stays null; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bpe import encoder
from newsloom.llm.runtime import Scratch
from newsloom.llm.tokens import slices

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, pieces per sequence, offset), and the number of sequences.

    Rank r of a row's range goes to sequence ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    mask, used, rows = 0, 0, []

    def give(room: int, start: int, n: int) -> None:
        nonlocal mask
        if room and n:
            free[room].append((start, n))
            mask |= 1 << room

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1  # the least free space that is enough
                start, n = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
            else:
                room, start, n = capacity, used, -(-left // (capacity // length))
                used += n
            per = room // length
            take = min(left, n * per)
            full, rest = divmod(take, per)
            if full:
                rows.append((length, rank, full * per, start, per, capacity - room))
                give(room - per * length, start, full)
            if rest:
                rows.append((length, rank + full * per, rest, start + full, rest, capacity - room))
                give(room - rest * length, start + full, 1)
            done = full + (rest > 0)
            give(room, start + done, n - done)
            rank, left = rank + take, left - take
    return rows, used


def _pieces(path: str, capacity: int, end: int):
    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches):
            ids, before = encoder(path, "byte").encode(batch.column("text"))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            tail = np.array([end], dtype=np.uint32)
            for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                own = np.concatenate([ids[a:b], tail])
                first = len(own) % capacity if len(own) > capacity else len(own)
                edges = [0, *range(first or capacity, len(own) + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    n = y - x
                    for column, value in zip(out, (i, k, x, n, zlib.crc32(own[x:y].tobytes()), int(seen[n])), strict=True):
                        column.append(value)
                    seen[n] += 1
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:]), pa.array([part] * len(rows), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "place", "part"],
            )

    return cut


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all pieces of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = scratch.table(
        rows.mapInArrow(_pieces(tokenizer, capacity, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long, part int"), "pieces"
    )
    counts = scratch.table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(histogram, capacity)
    planned = spark.createDataFrame(slots, "length long, low long, ranks long, first long, per long, at long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["part", "length"]).withColumn("rank", F.col("shift") + F.col("place"))
    slot = planned.withColumnRenamed("length", "of")
    inside = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("ranks"))
    # the plan's size depends on the number of lengths, not on the documents
    placed = ranked.join(F.broadcast(slot), inside).withColumn("k", F.col("rank") - F.col("low"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("k div per")).alias("sequence_id"), (F.col("at") + F.expr("k % per") * F.col("length")).alias("offset"),
    )
