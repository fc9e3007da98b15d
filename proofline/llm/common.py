"""Helpers of this subpackage: shared folders, staged tables, folds, byte-level word hashing.

The NumPy helpers work on the buffers of an Arrow string column, a slice of at most about a megabyte at a time, so
their memory does not grow with the batch. They run inside Spark tasks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.session import shared_dir

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a normalised word: letters, digits and every byte of a non-ASCII character.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, gives real sizes to the planner."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold crc32(id as text) mod 4 = 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts the bytes into pieces of about ``limit``, at document ends or at bytes marked in ``breaks``."""
    at, total = 0, len(data)
    while at < total:
        end = min(total, at + limit)
        if end < total:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:  # one long document: cut it after a break byte, or take the rest of an endless word
                stop = int(offsets[k + 1])
                while end < stop and not breaks[data[end - 1]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of every word (maximal run of ``wordlike`` bytes, A-Z lower-cased), in order."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in slices(data, offsets, ~wordlike):
        raw = data[lo:hi]
        inside = wordlike[raw]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
        before[cuts] = False
        after[cuts - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        n = len(raw)
        with np.errstate(over="ignore"):
            power = np.full(n, _BASE)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
            back = np.full(n, _INVERSE)
            back[0] = 1
            np.multiply.accumulate(back, out=back)
            h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        docs.append(np.searchsorted(offsets, starts + lo, "right") - 1)
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def shingle_hashes(docs: np.ndarray, words: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every k-word shingle in order; a document of fewer words gives one for all of them."""
    counts = np.bincount(docs, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    with np.errstate(over="ignore"):
        m = len(words) - k + 1
        if m > 0:
            h = np.zeros(m, np.uint64)
            for j in range(k):
                h = (h + words[j:m + j]) * _BASE
            good = docs[:m] == docs[k - 1:]
            out_d, out_h = docs[:m][good], mix(h[good])
        else:
            out_d, out_h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            hs = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                here = counts[short] > j
                at = first[short[here]] + j
                hs[here] = (hs[here] + words[at]) * _BASE
            out_d = np.concatenate((out_d, short))
            out_h = np.concatenate((out_h, mix(hs + counts[short].astype(np.uint64))))
            order = np.argsort(out_d, kind="stable")
            out_d, out_h = out_d[order], out_h[order]
    return out_d, out_h
