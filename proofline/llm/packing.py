"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into ``n // size`` pieces of ``size`` tokens (a power of two) and one piece for every
binary digit of the rest, largest first. Every piece is a sequence of its own: no sequence crosses documents and none is
padded. Sequences of equal length go to one bucket, from which batches are drawn.

Tokenising is a map over the scan; nothing is shuffled. The ids are those of the ``tokenizers`` file. Its byte-level
vocabulary is also run by tiktoken, about five times faster with the same ids; texts that hold the string of a special
token, and stretches without a safe cut, go through ``tokenizers`` itself. Long texts are encoded in pieces cut before
a single blank between two other characters, where the pre-tokenizer always cuts too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 100_000
#: The pre-tokenizer pattern of byte-level BPE vocabularies of this kind, and the printable bytes that
#: stand for themselves in the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Ids of whole texts, plus the end mark."""

    def __init__(self, path: str, end_id: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(special)
        self.end = np.array([end_id], np.uint32)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = None
        if spec["model"].get("type") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            byte_of = {chr(b): b for b in PRINTABLE}
            byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return self.end
        if self.fast is None or any(s in text for s in self.special):
            return np.concatenate((self._slow(text), self.end))
        parts, at = [], 0
        while at < len(text):
            end = self._cut(text, at)
            part = text[at:end]
            parts.append(self._slow(part) if len(part) > 2 * PIECE_CHARS else np.array(self.fast.encode_ordinary(part), np.uint32))
            at = end
        return np.concatenate([*parts, self.end])

    @staticmethod
    def _cut(text: str, at: int) -> int:
        """The end of the piece that starts at ``at``."""
        end = at + PIECE_CHARS
        while end < len(text) - 1:
            end = text.find(" ", end)
            if end < 0 or end == len(text) - 1:
                break
            if not text[end - 1].isspace() and not text[end + 1].isspace():
                return end
            end += 1
        return len(text)


def piece_lengths(n: int, size: int) -> list[int]:
    """Binary decomposition of n, largest first, with no part above ``size``."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 2, -1, -1) if (n % size) >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, with_ids: bool = True,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    ``tokenizer_path`` is a file every worker can read. A null or empty text is the end mark alone. Repeated rows and
    ids give pieces of their own; a null id stays null. Other columns are not read. ``sequence_id`` is unique within one
    run over the same files. ``with_ids=False`` leaves the ids out.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    id_type = docs.schema[doc_id].dataType
    schema = f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, end_id)
        for batch in batches:
            ids_in, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):  # bounds the ids in memory
                rows, start, length, crc, total, ids = [], [], [], [], [], []
                for i in range(lo, min(lo + 256, batch.num_rows)):
                    tokens = encoder.encode(texts[i].as_py() or "").astype("<u4")
                    at = 0
                    for n in piece_lengths(len(tokens), size):
                        piece = tokens[at:at + n]
                        rows.append(i), start.append(at), length.append(n), total.append(len(tokens))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                        at += n
                cols = [ids_in.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    tail = ["ids"] if with_ids else []
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
                      F.col("length").cast("int").alias("bucket"), *tail)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet, one folder per length, so that a reader takes batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
