"""Byte-level BPE ids, their character offsets, and back (operator 5)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.llm import vocab
from mnemospark.llm.bulk import slices, string_column


def offsets(text: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last code point of each token, from the tokens' byte widths.

    A token that holds only a part of a character covers that character, as its neighbour does.
    """
    raw = np.frombuffer(text, np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(widths)
    return character[ends - widths], character[ends - 1] + 1


def decode_bytes(ids: list[int], table: list[bytes]) -> bytes:
    """The ids' bytes. A character may be split between tokens, so text is made of whole sequences only."""
    return b"".join(map(table.__getitem__, ids))


def decode_text(ids: list[int], table: list[bytes]) -> str:
    """Text of the ids; bytes that are no character (a cut sequence) become U+FFFD."""
    return decode_bytes(ids, table).decode("utf-8", "replace")


def encode(docs: DataFrame, ranks: str | None = None, with_offsets: bool = True) -> DataFrame:
    """doc_id, ids, and starts and ends in code points, of every text.

    Null and empty texts have no ids. Rows stay as they are, repeated ones too; other columns are not kept.
    """
    path = ranks or vocab.default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = vocab.rank_encoder(path)
        width = np.array([len(t) for t in table], np.int64)
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts, 1_000_000 if with_offsets else 4_000_000):
                flat, at = encoder.encode(texts.slice(a, b - a))
                columns = [doc_ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))]
                names = ["doc_id", "ids"]
                if with_offsets:
                    both = [offsets((x or "").encode(), width[flat[i:j]]) for x, i, j in zip(texts.slice(a, b - a).to_pylist(), at, at[1:])]
                    for k, name in enumerate(("starts", "ends")):
                        values = np.concatenate([x[k] for x in both]) if both else np.zeros(0)
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32))))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if with_offsets else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encode every text, decode its ids again, and tell both by digest; the ids never leave the worker.

    ``same`` says whether the decoded bytes are the text's own, ``offsets_crc32`` is that of the tokens' starts and then ends in code points (little-endian
    32-bit integers), ``split_tokens`` counts tokens that share a character with the one before. Null texts count as empty ones.
    """
    path = ranks or vocab.default_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = vocab.rank_encoder(path)
        decimal = [str(i) for i in range(len(table))]
        width = np.array([len(t) for t in table], np.int64)
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts):
                flat, at = encoder.encode(texts.slice(a, b - a))
                shown, back, same, places, split = [], [], [], [], []
                for text, i, j in zip(texts.slice(a, b - a).to_pylist(), at.tolist(), at[1:].tolist()):
                    ids = flat[i:j].tolist()
                    shown.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded = decode_bytes(ids, table)
                    back.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == (text or "").encode())
                    starts, ends = offsets(decoded, width[flat[i:j]])
                    places.append(zlib.crc32(ends.astype("<i4"), zlib.crc32(starts.astype("<i4"))))
                    split.append(int((starts[1:] < ends[:-1]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(np.diff(at)), pa.array(shown, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_()), pa.array(places, pa.int64()), pa.array(split, pa.int64())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same", "offsets_crc32", "split_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean, offsets_crc32 long, split_tokens long")
