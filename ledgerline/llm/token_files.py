"""Token ids in files of patched frame-of-reference blocks.

Ids stand in ascending order of doc_id, cut into blocks of 128. Of a block the minimum is
stored once; what is left is packed at the width that holds nine values in ten, and the high
bits of the others go to an exception list. A file is a run of segments (4,096 blocks packed
together), then an index and its length:

    segment   u32 blocks, ids | u32 minimum and first packed word, u8 width, u8 exceptions of
              each block | u64 packed words | u8 places and u32 high bits of exceptions
    index     u64 segments, documents | u64 start of each segment | i64 id, u8 known and u64 first
              token of each document

so any block is found from the index and its segment's starts without decoding others.

Documents are range-partitioned by id, one file per partition, so that files in order hold
all ids in order. A task writes under a name of its own, and only names in the stored list of
files count: a repeated task leaves an unlisted file, nothing wrong.

Null and empty texts are one end id. A null doc_id comes first; rows that repeat an id follow
each other. An empty table gives no file and no row. Other columns may have any name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, reading, shared_folder, stored, writing
from ledgerline.llm.tokens import default_path, document_ids, encoder

BLOCK = 128
SEGMENT = 4096 * BLOCK
PERCENTILE = 0.9
MAGIC = b"PFOR0001"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 2*width words.

    Lanes are handled as contiguous rows, one value of every block at a time.
    """
    lanes = np.ascontiguousarray(values.T)
    words = np.zeros((2 * width, len(values)), dtype=np.uint64)
    for lane in range(BLOCK if width else 0):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return words.T


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    lanes = np.zeros((BLOCK, len(words)), dtype=np.uint64)
    for lane in range(BLOCK if width else 0):
        word, shift = divmod(lane * width, 64)
        np.right_shift(columns[word], np.uint64(shift), out=lanes[lane])
        if shift + width > 64:
            lanes[lane] |= columns[word + 1] << np.uint64(64 - shift)
    lanes &= np.uint64((1 << width) - 1)
    return lanes.T


def encode_segment(ids: np.ndarray) -> bytes:
    """At most SEGMENT ids; a short last block is filled with its last id."""
    count = len(ids)
    blocks = -(-count // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1], dtype=np.uint64)
    grid[:count] = ids
    grid = grid.reshape(blocks, BLOCK)
    minimum = grid.min(axis=1)
    delta = grid - minimum[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = bit_lengths(np.partition(delta, at, axis=1)[:, at])
    high = delta >> width[:, None].astype(np.uint64)
    row, place = np.nonzero(high)
    low = delta & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    starts = np.concatenate([[0], np.cumsum(2 * width)])
    words = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(width):
        mine = np.nonzero(width == w)[0]
        words[(starts[mine][:, None] + np.arange(2 * w)).ravel()] = packed(low[mine], int(w)).ravel()
    return b"".join(
        [
            struct.pack("<II", blocks, count),
            minimum.astype("<u4").tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            width.astype("u1").tobytes(),
            np.bincount(row, minlength=blocks).astype("u1").tobytes(),
            words.astype("<u8").tobytes(),
            place.astype("u1").tobytes(),
            high[row, place].astype("<u4").tobytes(),
        ]
    )


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive) of a segment."""
    blocks, count = struct.unpack_from("<II", data)
    last = blocks if last is None else min(last, blocks)
    at = 8
    minimum = np.frombuffer(data, "<u4", blocks, at)[first:last].astype(np.uint64)
    starts = np.frombuffer(data, "<u4", blocks, at + 4 * blocks).astype(np.int64)
    width = np.frombuffer(data, "u1", blocks, at + 8 * blocks).astype(np.int64)
    patches = np.concatenate([[0], np.cumsum(np.frombuffer(data, "u1", blocks, at + 9 * blocks), dtype=np.int64)])
    at += 10 * blocks
    n_words = int(starts[-1] + 2 * width[-1])
    words = np.frombuffer(data, "<u8", n_words, at)
    at += 8 * n_words
    place = np.frombuffer(data, "u1", int(patches[-1]), at)[patches[first] : patches[last]]
    high = np.frombuffer(data, "<u4", int(patches[-1]), at + int(patches[-1]))[patches[first] : patches[last]]
    values = np.zeros((last - first, BLOCK), dtype=np.uint64)
    for w in np.unique(width[first:last]):
        mine = np.nonzero(width[first:last] == w)[0]
        values[mine] = unpacked(words[starts[first + mine][:, None] + np.arange(2 * w)], int(w))
    row = np.repeat(np.arange(last - first), np.diff(patches[first : last + 1]))
    values[row, place] |= high.astype(np.uint64) << width[first + row].astype(np.uint64)
    values += minimum[:, None]
    return values.ravel()[: count - first * BLOCK].astype("<u4")


class FileWriter:
    """Documents in order into one file; holds one segment of ids and the index."""

    def __init__(self, out):
        self.out, self.size = out, 0
        self.waiting, self.held, self.tokens = [], 0, 0
        self.segments, self.ids, self.known, self.starts = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.tokens)
        self.tokens += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * SEGMENT:
            self._write_segments(everything=False)

    def _write_segments(self, everything: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        at = 0
        while len(ids) - at >= SEGMENT or (everything and at < len(ids)):
            data = encode_segment(ids[at : at + SEGMENT])
            self.segments.append(self.size)
            self._write(data)
            at += SEGMENT
        self.waiting = [ids[at:].tobytes()]
        self.held = len(self.waiting[0])

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._write_segments(everything=True)
        index = b"".join(
            [
                struct.pack("<QQ", len(self.segments), len(self.ids)),
                np.array([*self.segments, self.size], "<u8").tobytes(),
                np.array(self.ids, "<i8").tobytes(),
                np.array(self.known, "u1").tobytes(),
                np.array([*self.starts, self.tokens], "<u8").tobytes(),
            ]
        )
        self._write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class FileReader:
    """Index of one file, and its ids by range reads."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        tail = file.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<Q", tail[:8])
        index = file.read_at(length, end - 16 - length)
        segments, docs = struct.unpack_from("<QQ", index)
        self.segments = np.frombuffer(index, "<u8", segments + 1, 16)
        at = 16 + 8 * (segments + 1)
        self.ids = np.frombuffer(index, "<i8", docs, at)
        self.known = np.frombuffer(index, "u1", docs, at + 8 * docs).astype(bool)
        self.starts = np.frombuffer(index, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def segment(self, number: int) -> bytes:
        start, end = int(self.segments[number]), int(self.segments[number + 1])
        return self.file.read_at(end - start, start)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end (exclusive), decoding only the blocks that hold them."""
        found = []
        for number in range(start // SEGMENT, -(-end // SEGMENT)):
            base = number * SEGMENT
            first = max(0, start - base) // BLOCK
            last = -(-min(SEGMENT, end - base) // BLOCK)
            ids = decode_segment(self.segment(number), first, last)
            begin = base + first * BLOCK
            found.append(ids[max(0, start - begin) : end - begin])
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, number of ids, their crc32), one segment in memory at a time."""
        doc, crc = 0, 0
        for number in range(len(self.segments) - 1):
            base = number * SEGMENT
            ids = decode_segment(self.segment(number))
            data, at, end = memoryview(ids.tobytes()), base, base + len(ids)
            while doc < len(self.ids) and at < end:
                stop = min(end, int(self.starts[doc + 1]))
                crc = zlib.crc32(data[4 * (at - base) : 4 * (stop - base)], crc)
                at = stop
                if stop == self.starts[doc + 1]:
                    yield (
                        int(self.ids[doc]) if self.known[doc] else None,
                        int(self.starts[doc]),
                        int(stop - self.starts[doc]),
                        crc,
                    )
                    doc, crc = doc + 1, 0


FILES = "file_no int, address string, n_docs long, n_tokens long, n_bytes long"


def write_token_files(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files; the stored list of them, one row per file, in order of file_no."""
    folder, path = shared_folder(spark, "token-files"), path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number, writer = encoder(path), TaskContext.get().partitionId(), None
        address = f"{folder}/part-{number:05d}-{uuid.uuid4().hex}.pfor"
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or FileWriter(writing(address))
                writer.add(doc, document_ids(tool, text))
        if writer:
            writer.close()
            row = {
                "file_no": [number],
                "address": [address],
                "n_docs": [len(writer.ids)],
                "n_tokens": [writer.tokens],
                "n_bytes": [writer.size],
            }
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(spark, ordered.mapInArrow(write, FILES), "token-file-list")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("address", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for address, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                with reading(address) as file:
                    for doc, start, count, crc in FileReader(file).documents():
                        rows.append((doc, base + start, count, crc))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # One row per file: a task for each, whatever the few bytes of the list suggest.
    tasks = max(1, files.count())
    return listed.repartition(tasks, "address").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(spark, documents(spark, sf_dir)))
