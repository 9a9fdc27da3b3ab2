"""Token ids in fixed-width bit-packed segments (operator 3).

A segment is a byte string that holds the ids of consecutive documents, each id in the fewest bits that the
vocabulary needs. All integers are little-endian; packed ids are big-endian bit fields.

====================  =====================================================================
``MPK1``              magic
u32 x 4               bits per id, ids per block, documents, blocks
u64 x 2               ids in the segment, ids of the same partition before the segment
i64 x documents       doc_id (0 where null)
u8 x documents        1 where doc_id is null
u64 x documents       end of each document, in ids from the segment's start
u64 x (blocks + 1)    byte offset of each block in the payload
payload               blocks, each padded to a whole byte
====================  =====================================================================

Any run of ids is read from its own blocks alone (`read_ids`). Segments lie as rows of a Parquet table in the
shared folder, keyed by (part, seg) in the order of the documents, so that any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm import vocab
from mnemospark.llm.bulk import SLICE_CHARS, slices, string_column
from mnemospark.llm.shared import new_path

HEAD = struct.Struct("<4sIIIIQQ")
BLOCK_IDS = 65_536
#: Ids in a segment, about; bounds the rows of the table and a reader's memory.
SEGMENT_IDS = 4_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, each in so many bits; one that does not fit is refused."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def write_segment(ids: np.ndarray, doc_ids: list, ends: np.ndarray, before: int, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[k : k + block_ids], bits) for k in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [
            HEAD.pack(b"MPK1", bits, block_ids, len(doc_ids), len(blocks), len(ids), before),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            null.tobytes(),
            np.asarray(ends, "<u8").tobytes(),
            offsets.tobytes(),
            *blocks,
        ]
    )


class Segment:
    """Reads a segment; nothing is unpacked before it is asked for."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, docs, blocks, self.n_ids, self.before = HEAD.unpack_from(data)
        if magic != b"MPK1":
            raise ValueError("not a packed segment")
        at = HEAD.size
        ids = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.ends = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
        self.payload = memoryview(data)[at + 17 * docs + 8 * (blocks + 1) :]

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        out = []
        for k in range(first, last + 1):
            count = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], count, self.bits))
        ids = np.concatenate(out)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, drops_space: bool, end_id: int, vocabulary: int, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode ``docs`` (doc_id, text) and write segments to ``path`` in ascending doc_id order.

    Null doc_ids come first, equal ones by their text. A null or empty text is the end id alone. One range
    shuffle of the texts; each task then packs its own run and keeps one segment in memory.
    """
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.json_encoder(tokenizer, drops_space)
        part = TaskContext.get().partitionId()
        held, ids, ends, seg, before, size = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = write_segment(np.concatenate(ids), held, np.concatenate(ends), before, bits)
            return pa.RecordBatch.from_pydict({"part": [part], "seg": [seg], "n_ids": [size], "data": pa.array([data], pa.large_binary())}, schema=out)

        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for a, b in slices(texts, min(SLICE_CHARS, 2 * segment_ids)):
                flat, offsets = encoder.encode(texts.slice(a, b - a))
                flat, offsets = np.insert(flat, offsets[1:], end_id), offsets + np.arange(len(offsets))
                ids.append(flat)
                ends.append(size + offsets[1:])
                held += doc_ids[a:b]
                size += len(flat)
                if size >= segment_ids:
                    yield flush()
                    seg, before = seg + 1, before + size
                    held, ids, ends, size = [], [], [], 0
        if held:
            yield flush()

    out = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("data", pa.large_binary())])
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, seg int, n_ids long, data binary").write.parquet(path)


def read_token_files(docs_path: DataFrame) -> DataFrame:
    """One row for each document of the segments: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Each segment knows the ids before it in its own
    partition; the partitions' totals (one row each, so as many as the writing job had tasks) are summed up and
    broadcast.
    """
    parts = docs_path.groupBy("part").agg(F.sum("n_ids").alias("total"))
    bases = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.column(2)[row].as_py())
                ids = s.read_ids(0, s.n_ids).astype("<u4")
                starts = np.concatenate([[0], s.ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), s.ends.tolist())]
                part = np.full(len(crc), batch.column(0)[row].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(s.doc_ids, pa.int64()), pa.array(starts + s.before), pa.array(s.ends - starts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = docs_path.select("part", "seg", "data").mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of every text with an end id and read the files back. Ids are as wide as the tokenizer's greatest one needs.

    Null and empty texts are the end id alone, repeated rows are written each, and other columns are not kept.
    """
    spark = docs.sparkSession
    path, tokenizer = new_path(spark, "tokens"), tokenizer or vocab.default_path("word_bpe_49k.json")
    write_token_files(docs, path, tokenizer, drops_space=True, end_id=1, vocabulary=1 + max(1, vocab.greatest_id(tokenizer)))
    return read_token_files(spark.read.schema("part int, seg int, n_ids long, data binary").parquet(path))
