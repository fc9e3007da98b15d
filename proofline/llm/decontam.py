"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact check.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; a shingle is ``k`` words. Every
window of every text, as many shingles long as an item (every length of an item is a window size), gets a 64-bit
SimHash: per bit, the majority over the window's shingles, counted with repetition. Windows are computed from running
sums with several counters packed in one 64-bit word. A window with too few shingles of any item cannot be similar, nor
can its neighbours, and gets none; that costs a running sum of a bitmap per size and loses nothing.

Fingerprints are cut into four blocks of 16 bits. A fingerprint within ``radius`` of an item's agrees with it in some
block up to ``radius // 4`` bits, so four tables from block values to items find every fingerprint within the radius. A table
has each item under all block values near its own, sorted, behind a bit map of the values that occur.
Candidates are checked with the weighted similarity of the shingles, sum of minima over sum of maxima of the
multiplicities, at the item's own length and at the neighbouring starts.

The items are the query set: they are broadcast in blocks of at most ``BLOCK_ITEMS``, each a map over the documents
without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDLIKE, shingle_hashes, text_buffers, word_hashes

#: The tables of an item take about 11 kB.
BLOCK_ITEMS = 8_000
_SLICE = 1 << 18
_DDL = "item_id bigint, similarity double, start_word bigint, n_words bigint"


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts in order, their bounds per text, and the number of words per text."""
    data, offsets = text_buffers(texts)
    doc, words = word_hashes(data, offsets, WORDLIKE)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    doc, h = shingle_hashes(doc, words, n, k)
    return h, np.searchsorted(doc, np.arange(n + 1)), counts


class Lanes:
    """Running sums of the hash bits, several counters to a 64-bit word, for fingerprints of any window size."""

    def __init__(self, h: np.ndarray):
        self.h, self.sums = h, {}
        self.buffer = np.empty(len(h) + 1, np.uint64)

    def _fields(self, field: int, ones: np.uint64) -> list[np.ndarray]:
        if field not in self.sums:
            lanes = []
            with np.errstate(over="ignore"):
                for j in range(field):
                    lane = np.zeros(len(self.h) + 1, np.uint64)
                    np.cumsum((self.h >> np.uint64(j)) & ones, out=lane[1:])
                    lanes.append(lane)
            self.sums[field] = lanes
        return self.sums[field]

    def fingerprints(self, size: int, starts: np.ndarray | None = None) -> np.ndarray:
        """SimHash of every ``size`` consecutive hashes, or of those that begin at ``starts``."""
        field = 8 if size < 256 else 16 if size < 65536 else 32
        ones = np.uint64(sum(1 << i for i in range(0, 64, field)))
        add = ones * np.uint64((1 << (field - 1)) - 1 - size // 2)
        high = ones << np.uint64(field - 1)
        out = np.zeros(len(self.h) - size + 1 if starts is None else len(starts), np.uint64)
        x = self.buffer[:len(out)]
        with np.errstate(over="ignore"):
            for j, lane in enumerate(self._fields(field, ones)):
                if starts is None:
                    np.subtract(lane[size:], lane[:-size], out=x)
                else:
                    np.subtract(lane[starts + size], lane[starts], out=x)
                np.add(x, add, out=x)
                np.bitwise_and(x, high, out=x)
                np.right_shift(x, np.uint64(field - 1 - j), out=x)
                np.bitwise_or(out, x, out=out)
        return out


def _fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    return Lanes(h).fingerprints(size)


def _neighbours(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    masks = np.arange(1 << 16, dtype=np.uint16)
    return masks[np.bitwise_count(masks) <= radius]


class Items:
    """The query set, ready for the search: by window size, the four block tables and the items they name."""

    def __init__(self, ids: list[int], texts: list[str], k: int, radius: int):
        self.k, self.radius = k, radius
        h, bounds, words = _shingles(pa.array(texts, pa.large_string()), k)
        keep = [i for i in range(len(ids)) if bounds[i + 1] > bounds[i]]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.words = np.array([words[i] for i in keep], np.int64)
        self.hashes = [h[bounds[i]:bounds[i + 1]] for i in keep]
        self.sets = [np.unique(x, return_counts=True) for x in self.hashes]
        self.prints = np.array([_fingerprints(x, len(x))[0] for x in self.hashes], np.uint64)
        lengths = np.array([len(x) for x in self.hashes], np.int64)
        sizes = np.unique(lengths[self.words >= k]) if len(keep) else np.zeros(0, np.int64)
        # marks the shingles of the items; a mark that another shingle shares lets a window through, no more
        marks = np.concatenate([np.zeros(0, np.uint64), *(x for x, w in zip(self.hashes, self.words) if w >= k)])
        self.marked = np.zeros(1 << min(27, max(16, int(len(marks) * 16).bit_length())), bool)
        self.marked[marks & np.uint64(len(self.marked) - 1)] = True
        masks = _neighbours(radius // 4)
        self.classes = []
        for size in sizes:
            members = np.flatnonzero((lengths == size) & (self.words >= k))
            tables = []
            for b in range(4):
                block = ((self.prints[members] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
                value = (block[:, None] ^ masks).ravel()
                order = np.argsort(value, kind="stable")
                occurs = np.zeros(1 << 16, bool)
                occurs[value] = True
                tables.append((np.packbits(occurs, bitorder="little"), value[order], (order // len(masks)).astype(np.uint16)))
            self.classes.append((int(size), tables, members))
        # an item below k words is one hash; its windows are looked up exactly
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(self.words < k):
            self.short.setdefault(int(self.words[i]), {}).setdefault(int(self.hashes[i][0]), []).append(int(i))

    def _candidates(self, fp: np.ndarray, tables: list, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at_all, item_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        blocks = fp.astype("<u8", copy=False).view("<u2").reshape(-1, 4)
        for b, (occurs, values, lists) in enumerate(tables):
            v = np.ascontiguousarray(blocks[:, b])
            at = np.flatnonzero(occurs.take(v >> 3) >> (v & 7).astype(np.uint8) & 1)
            if not len(at):
                continue
            first = np.searchsorted(values, v[at])
            n = np.searchsorted(values, v[at], "right") - first
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = members[lists[np.repeat(first, n) + offset]]
            at = np.repeat(at, n)
            near = np.bitwise_count(fp[at] ^ self.prints[item]) <= self.radius
            at_all.append(at[near])
            item_all.append(item[near])
        return np.concatenate(at_all), np.concatenate(item_all)

    def similarity(self, item: int, window: np.ndarray) -> float:
        own, counts = self.sets[item]
        other, others = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        both = np.minimum(counts[at], others)[own[at] == other].sum()
        return float(both / (len(self.hashes[item]) + len(window) - both))

    def search(self, h: np.ndarray, bounds: np.ndarray, words: np.ndarray, threshold: float) -> dict[int, dict[int, tuple[float, int]]]:
        """row -> item -> (similarity, start) for a slice of texts; ``words`` is the number of words per text."""
        found: dict[int, dict[int, tuple[float, int]]] = {}
        if not self.classes or not len(h):
            return found
        length = np.diff(bounds)
        row_of = np.repeat(np.arange(len(length)), length)
        marked = self.marked[h & np.uint64(len(self.marked) - 1)] & (words[row_of] >= self.k)
        sums = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        marks = sums[bounds[1:]] - sums[bounds[:-1]]
        lanes = Lanes(h)
        for size, tables, members in self.classes:
            rows = np.flatnonzero(marks >= threshold * size)
            # the best window of an item may be up to two starts from the one whose fingerprint is near
            starts = [np.arange(bounds[r], bounds[r + 1] - size + 1) for r in rows if length[r] >= size]
            pairs = []
            if starts:
                at = np.concatenate(starts)
                at = at[sums[at + size] - sums[at] >= threshold * size - 2]
                where, item = self._candidates(lanes.fingerprints(size, at), tables, members)
                pairs.append(np.stack((at[where], item)))
            # a text shorter than the window is one window
            for r in rows[length[rows] < size]:
                where, item = self._candidates(_fingerprints(h[bounds[r]:bounds[r + 1]], int(length[r])), tables, members)
                pairs.append(np.stack((where + bounds[r], item)))
            if not pairs:
                continue
            slack = 2
            todo: dict[tuple[int, int], set[int]] = {}
            for p, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
                r = int(row_of[p])
                last = max(int(bounds[r]), int(bounds[r + 1]) - len(self.hashes[i]))
                todo.setdefault((r, i), set()).update(range(max(int(bounds[r]), p - slack), min(last, p + slack) + 1))
            for (r, i), starts in todo.items():
                lo, m = min(starts), len(self.hashes[i])
                span = h[lo:min(max(starts) + m, int(bounds[r + 1]))]
                inside = np.isin(span, self.sets[i][0])
                if inside.sum() < threshold * m:
                    continue
                own = np.concatenate(([0], np.cumsum(inside)))
                for s in sorted(starts):
                    end = min(s + m, int(bounds[r + 1]))
                    if own[end - lo] - own[s - lo] >= threshold * m:
                        value = self.similarity(i, h[s:end])
                        if value >= threshold and value > found.setdefault(r, {}).get(i, (0.0, 0))[0]:
                            found[r][i] = (value, s - int(bounds[r]))
        return {r: x for r, x in found.items() if x}

    def leaks(self, texts: pa.Array, threshold: float) -> list[list[tuple]]:
        """Per text, (item_id, similarity, start_word, n_words) of its leaks."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        lengths = np.diff(text_buffers(texts)[1])
        lo = 0
        while lo < len(texts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]), _SLICE, "right")))
            part = texts.slice(lo, hi - lo)
            h, bounds, words = _shingles(part, self.k)
            found = self.search(h, bounds, words, threshold)
            for width, wanted in self.short.items():
                if width == self.k:
                    continue
                data, offsets = text_buffers(part)
                doc, w = word_hashes(data, offsets, WORDLIKE)
                enough = np.bincount(doc, minlength=hi - lo) >= width
                # runs of ``width`` words hash as a whole text of that many words does
                first = np.flatnonzero((doc[:len(doc) - width + 1] == doc[width - 1:]) & enough[doc[:len(doc) - width + 1]]) if len(doc) >= width else []
                begin = np.searchsorted(doc, np.arange(hi - lo))
                if len(first):
                    runs = np.concatenate([w[first + j] for j in range(width)]).reshape(width, -1).T.ravel()
                    _, hs = shingle_hashes(np.repeat(np.arange(len(first)), width), runs, len(first), self.k)
                    for f in np.flatnonzero(np.isin(hs, np.array(list(wanted), np.uint64))):
                        r = int(doc[first[f]])
                        for i in wanted[int(hs[f])]:
                            found.setdefault(r, {}).setdefault(i, (1.0, int(first[f] - begin[r])))
            for r, hits in found.items():
                out[lo + r] = sorted((int(self.ids[i]), v, s, int(self.words[i])) for i, (v, s) in hits.items())
            lo = hi
        return out


def _blocks(items: DataFrame, item_id: str, text: str, k: int, radius: int) -> Iterator[Items]:
    """Item blocks, each collected on its own."""
    rows = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("id"), F.lower(text).alias("text")).distinct()
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").toPandas()
        yield Items(part["id"].tolist(), part["text"].tolist(), k, radius)


def with_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 15, text: str = "text",
               item_id: str = "item_id", item_text: str = "text", column: str = "leaks") -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, similarity, start_word, n_words), one entry per item found.

    All rows and columns stay, whatever their names; an existing ``leaks`` column is replaced. ``start_word`` is the
    first word of the most similar window, the earliest of equals; a text shorter than the item is one window. A null or
    empty text has no leaks; items without words, id or text are left out. An item below ``k`` words is looked for
    exactly. Items that share an id are searched one by one.
    """
    plain = docs.drop(column)
    spark = docs.sparkSession
    out = plain.select(F.struct("*").alias("_row"), F.lower(text).alias("_text"), F.array().cast(f"array<struct<{_struct()}>>").alias(column))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
    for block in _blocks(items, item_id, item_text, k, radius):
        model = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = model.value.leaks(batch.column("_text"), threshold)
                before = batch.column(column).to_pylist()
                rows = [[*(tuple(x.values()) for x in old), *new] for old, new in zip(before, made)]
                leaks = pa.array([[dict(zip(("item_id", "similarity", "start_word", "n_words"), x)) for x in r] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), leaks], names=["_row", "_text", column])

        out = out.mapInArrow(run, out.schema)
    return out.select("_row.*", column)


def _struct() -> str:
    return ", ".join(f"{a}:{b}" for a, b in (x.split() for x in _DDL.split(", ")))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: one row per document row and item found in it."""
    rows = with_leaks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **options)
    return rows.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
