"""Token ids in bit-packed files with block offsets.

A file holds the ids of a range of documents in ascending doc_id order. Ids take the minimum number of bits
for the vocabulary, in blocks of ``BLOCK`` ids that begin at whole bytes. The footer has the documents' ids,
where each begins, and the offset of every block, so any range of ids is read by its blocks alone and
unpacked in numpy:

    blocks | doc ids (int64) | doc id known (uint8) | first id of each document, and the end (uint64)
    | offset of each block, and the end (uint64) | documents, ids (uint64), bits, block (uint32) | ``MAGIC``

Files are written below the shared folder, each under a name of its own that no other attempt uses, and
only the names that the written table lists count; a lost executor leaves at most an unlisted file.
Defined cases: null text is the empty text, which has the end id only; null doc_ids come first; repeated
rows are written as often as they come; an empty table has no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bpe import encoder
from newsloom.llm.runtime import Scratch, text_bytes
from newsloom.llm.tokens import slices

MAGIC = b"BITPACK1"
BLOCK = 8192
END_ID = 2
FILE_BYTES = 24 << 20
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The least width that holds all ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    matrix = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(matrix.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little", count=n * bits)
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Streams ids into blocks and ends with the footer."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets, self.docs, self.starts = [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        for k in range(0, n, BLOCK):
            raw = pack_bits(ids[k : min(k + BLOCK, n)], self.bits)
            self.sink.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        known = np.array([x is not None for x in self.docs], dtype=np.uint8)
        self.sink.write(np.array([x or 0 for x in self.docs], dtype="<i8").tobytes() + known.tobytes())
        self.sink.write(np.array([*self.starts, self.ids], dtype="<u8").tobytes() + np.array(self.offsets, dtype="<u8").tobytes())
        self.sink.write(np.array([len(self.docs), self.ids], dtype="<u8").tobytes() + np.array([self.bits, BLOCK], dtype="<u4").tobytes() + MAGIC)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError("not a bit-packed file")
        docs, self.n = (int(x) for x in np.frombuffer(tail[:16], dtype="<u8"))
        self.bits, self.block = (int(x) for x in np.frombuffer(tail[16:24], dtype="<u4"))
        blocks = -(-self.n // self.block)
        length = 17 * docs + 8 + 8 * (blocks + 1)
        raw = source.read_at(length, size - 24 - len(MAGIC) - length)
        known = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=8 * docs)
        ids = np.frombuffer(raw, dtype="<i8", count=docs)
        self.docs = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.starts = np.frombuffer(raw[9 * docs : 17 * docs + 8], dtype="<u8").astype(np.int64)
        self.offsets = np.frombuffer(raw[17 * docs + 8 :], dtype="<u8").astype(np.int64)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a..b, by the blocks that hold them."""
        if b <= a:
            return np.empty(0, dtype=np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, self.n - k * self.block)
            at = int(self.offsets[k] - self.offsets[first])
            parts.append(unpack_bits(raw[at : at + int(self.offsets[k + 1] - self.offsets[k])], n, self.bits))
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]


def _write(folder: str, tokenizer: str, end: int):
    def write(batches):
        where, root = fs.FileSystem.from_uri(folder)
        writer = None
        tail = np.array([end], dtype=np.uint32)
        for batch in slices(batches):
            encode = encoder(tokenizer, "word")
            if writer is None:
                part = TaskContext.get().partitionId()
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.bits"
                where.create_dir(root, recursive=True)
                sink = where.open_output_stream(path)
                writer = Writer(sink, bits_for(max(encode.tokenizer.get_vocab_size(), end + 1)))
            ids, before = encode.encode(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                writer.add(doc, np.concatenate([ids[a:b], tail]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [path.rsplit("/", 1)[1]], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]})

    return write


def _read(folder: str):
    def read(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with where.open_input_file(f"{root}/{name}") as source:
                    file = Reader(source)
                    at, docs = 0, len(file.docs)
                    while at < docs:
                        to = max(at + 1, int(np.searchsorted(file.starts[:-1], file.starts[at] + READ_IDS)))
                        starts = file.starts[at : to + 1]
                        ids = np.ascontiguousarray(file.read(int(starts[0]), int(starts[-1])), dtype="<u4")
                        local = (starts - starts[0]).tolist()
                        crc = [zlib.crc32(ids[a:b].data) for a, b in zip(local[:-1], local[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(file.docs[at:to], pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    return read


def write(docs: DataFrame, tokenizer: str, folder: str, scratch: Scratch, end: int = END_ID) -> DataFrame:
    """Write the files below ``folder``; the table of them: part, file, n_docs, n_ids, base (ids in files before)."""
    parts = max(1, -(-text_bytes(docs) // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    files = scratch.table(ordered.mapInArrow(_write(folder, tokenizer, end), "part int, file string, n_docs long, n_ids long"), "files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    count = max(1, files.count())
    return files.select("file", "base").repartition(count).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "bitpack")
    folder = scratch.path("bits")
    return read(write(docs, tokenizer, folder, scratch, end), folder)
