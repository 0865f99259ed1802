"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after another, in blocks of 128. A
block has its smallest id, a width in bits that 90 % of the differences to it
need at most, all differences cut to that width and packed, and a list of
exceptions (place and whole difference) for those that need more. The footer
has each block's place in the file and each document's id and length; the last
eight bytes have the footer's place.

Defined results: a null or empty text is a document of the end id alone;
documents are in ascending order of doc_id (null first), repeated rows one after
another; an empty table gives no documents; other columns are ignored. Files
have names of their own for each attempt and count only if the manifest names
them, so a task that is run again leaves no wrong rows.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, giving_back, open_shared, shared_dir, table
from .tokens import encoder

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILE = 90
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 8_000_000
#: Blocks that are packed or unpacked at once.
SLAB = 4096

FOOTER = "<u8"


BITS = np.frexp(np.arange(1 << 16).astype(np.float64))[1].astype(np.uint8)


def bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint64(16)
    if not high.any():
        return BITS[x]
    return np.where(high > 0, 16 + BITS[high], BITS[x & np.uint64(0xFFFF)])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2^width as rows of 2 * width 64-bit words."""
    v = np.ascontiguousarray(values.T)
    out = np.zeros((2 * width, v.shape[1]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    x = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, x.shape[1]), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = x[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= x[word + 1] << np.uint64(64 - shift)
    return out.T & np.uint64((1 << width) - 1)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """ids (a multiple of BLOCK) as blocks, and each block's size in bytes."""
    v = ids.reshape(-1, BLOCK).astype(np.uint64)
    low = v.min(axis=1)
    d = v - low[:, None]
    bits = bit_length(d)
    nth = -(-PERCENTILE * BLOCK // 100) - 1
    width = np.partition(bits, nth, axis=1)[:, nth].astype(np.int64)
    more = bits > width[:, None]
    n_more = more.sum(axis=1)
    size = 6 + 16 * width + 5 * n_more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, n_more
    for w in np.unique(width).tolist():
        if w:
            k = np.flatnonzero(width == w)
            out[(at[k] + 6)[:, None] + np.arange(16 * w)] = pack(d[k] & np.uint64((1 << w) - 1), w).astype("<u8").view(np.uint8)
    row, col = np.nonzero(more)
    nth = np.arange(len(row)) - (np.cumsum(n_more) - n_more)[row]
    list_at = (at + 6 + 16 * width)[row]
    out[list_at + nth] = col
    out[(list_at + n_more[row] + 4 * nth)[:, None] + np.arange(4)] = d[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), size


def decode_blocks(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at the places `at` of raw."""
    b = np.frombuffer(raw, np.uint8)
    low = b[at[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint64)
    width, n_more = b[at + 4].astype(np.int64), b[at + 5].astype(np.int64)
    d = np.zeros((len(at), BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            k = np.flatnonzero(width == w)
            d[k] = unpack(b[(at[k] + 6)[:, None] + np.arange(16 * w)].copy().view("<u8"), w)
    row = np.repeat(np.arange(len(at)), n_more)
    nth = np.arange(len(row)) - (np.cumsum(n_more) - n_more)[row]
    list_at = (at + 6 + 16 * width)[row]
    d[row, b[list_at + nth]] = b[(list_at + n_more[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (d + low[:, None]).ravel()


class FileWriter:
    """Writes documents to one file; close() gives the numbers of documents and ids."""

    def __init__(self, path: str):
        self.path, self.out = path, open_shared(path, "w")
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.wait: list[np.ndarray] = []
        self.n_wait = 0
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.wait.append(ids)
        self.n_wait += len(ids)
        if self.n_wait >= SLAB * BLOCK:
            self.flush(self.n_wait - self.n_wait % BLOCK)

    def flush(self, n: int) -> None:
        have = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        for k in range(0, n, SLAB * BLOCK):
            raw, size = encode_blocks(have[k : min(n, k + SLAB * BLOCK)])
            self.out.write(raw)
            self.sizes.append(size)
        self.wait, self.n_wait = [have[n:]], len(have) - n

    def close(self) -> tuple[int, int]:
        if self.n_wait:
            self.wait.append(np.zeros(-self.n_wait % BLOCK, np.uint32))
            self.n_wait += -self.n_wait % BLOCK
            self.flush(self.n_wait)
        starts = np.concatenate([[len(MAGIC)], len(MAGIC) + np.cumsum(np.concatenate([*self.sizes, np.zeros(0, np.int64)]))]).astype(FOOTER)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        parts = [np.array([len(self.doc_ids), self.n_ids, len(starts) - 1], FOOTER), starts, np.array(self.lengths, FOOTER), np.array([d or 0 for d in self.doc_ids], "<i8"), known]
        place = int(starts[-1])
        for p in parts:
            self.out.write(p.tobytes())
        self.out.write(np.array([place], FOOTER).tobytes())
        self.out.close()
        return len(self.doc_ids), self.n_ids


def read_file(path: str) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, start within the file, number of ids and their crc32 for each document of a file, a slab of blocks at a time."""
    with open_shared(path, "r") as f:
        end = f.size()
        place = int(np.frombuffer(f.read_at(8, end - 8), FOOTER)[0])
        foot = io.BytesIO(f.read_at(end - 8 - place, place))
        take = lambda n, kind: np.frombuffer(foot.read(n * np.dtype(kind).itemsize), kind)
        n_docs, _, n_blocks = take(3, FOOTER).tolist()
        starts = take(n_blocks + 1, FOOTER).astype(np.int64)
        lengths, doc_ids, known = take(n_docs, FOOTER).tolist(), take(n_docs, "<i8").tolist(), take(n_docs, np.uint8).tolist()
        have, at = b"", 0
        block = 0
        for doc_id, n, ok in zip(doc_ids, lengths, known, strict=True):
            crc, left = 0, 4 * n
            while left:
                if not have:
                    stop = min(n_blocks, block + SLAB)
                    raw = f.read_at(int(starts[stop] - starts[block]), int(starts[block]))
                    have = memoryview(decode_blocks(raw, starts[block:stop] - starts[block]).astype("<u4").tobytes())
                    block = stop
                part, have = have[:left], have[left:]
                crc, left = zlib.crc32(part, crc), left - len(part)
            yield doc_id if ok else None, at, n, crc
            at += n


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of all documents into files in folder. Returns the manifest: shard, path, n_docs, n_ids, start (ids before the file)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, rows, out = encoder(tokenizer).encode_all, TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                out = out or FileWriter(f"{folder}/{task:06d}-{len(rows):04d}-{uuid.uuid4().hex}.ids")
                out.add(doc_id, ids)
                if out.n_ids >= FILE_IDS:
                    rows.append((task, len(rows), out.path, *out.close()))
                    out = None
        if out:
            rows.append((task, len(rows), out.path, *out.close()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["task", "part", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = cut(ordered.mapInArrow(giving_back(part), "task long, part long, path string, n_docs long, n_ids long"), "token-files")
    before = W.orderBy("task", "part")  # a row for each file
    manifest = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return manifest.withColumn("shard", F.row_number().over(before) - 1)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the manifest's files."""

    def part(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc_id, start + at, n, crc) for doc_id, at, n, crc in read_file(path)]
                if rows:
                    kinds = (pa.int64(),) * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    files = files.repartition(max(1, files.count()), "path")  # files are bounded, so a task for each
    return files.mapInArrow(giving_back(part), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"))
