"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters or runs of other visible characters. A document's features are its tokens, pairs of
neighbouring tokens, and pairs of token shapes (lower, capitalised, upper case, digits, signs; or "same as before"), all
hashed to ``2 ** bits`` places. A feature's value is ln(1 + count), and a document's values have length one, so very
long texts weigh like short ones. A text without tokens has only the constant.

Training uses a bounded sample of labelled rows (``max_train``, the smallest hashes of the id), dealt to groups of about
``GROUP_ROWS``. Each group runs per-coordinate FTRL-proximal over its rows several times; the weights of the groups are
averaged in Spark. The result has at most ``2 ** bits`` numbers and is broadcast. Scoring is a
map: sparse dot products of whole texts with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORDLIKE, mix, slices, text_buffers, word_hashes

GROUP_ROWS = 2500
_SIGNS = ~(WHITE | WORDLIKE)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and shape of every token in order."""
    docs, hashes, shapes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi in slices(data, offsets, WHITE):
        raw, local = data[lo:hi], np.clip(offsets - lo, 0, hi - lo)
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
        parts = []
        for mask, sign in ((WORDLIKE, 0), (_SIGNS, 1)):
            starts, ends = _runs(mask[raw], cuts)
            _, h = word_hashes(raw, local, mask)
            if sign:
                shape = np.full(len(starts), 4, np.uint64)
            else:
                upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
                n_upper = upper[ends] - upper[starts]
                shape = np.select([_DIGIT[raw[starts]], n_upper == 0, (n_upper == 1) & _UPPER[raw[starts]] & (ends - starts > 1)],
                                  [3, 0, 1], 2).astype(np.uint64)
            parts.append((starts, h, shape))
        starts = np.concatenate([p[0] for p in parts])
        order = np.argsort(starts, kind="stable")
        docs.append(np.searchsorted(offsets, starts[order] + lo, "right") - 1)
        hashes.append(np.concatenate([p[1] for p in parts])[order])
        shapes.append(np.concatenate([p[2] for p in parts])[order])
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(shapes)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and value of every distinct feature, by document; place 0 is the constant."""
    n_docs = len(offsets) - 1
    doc, h, shape = _tokens(data, offsets)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        places, owners = [mix(h) >> shift], [doc]
        if len(doc) > 1:
            same = doc[1:] == doc[:-1]
            repeated = (h[1:] == h[:-1]).astype(np.uint64)
            pair = mix(h[:-1] * np.uint64(3) + mix(h[1:] + np.uint64(1)))
            look = mix(shape[:-1] * np.uint64(64) + shape[1:] * np.uint64(8) + repeated + np.uint64(1 << 40))
            for x in (pair, look):
                places.append(x[same] >> shift)
                owners.append(doc[1:][same])
    keys = np.concatenate(owners).astype(np.int64) * (1 << bits) + np.concatenate(places).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    owner, place = keys >> bits, keys & ((1 << bits) - 1)
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(owner, value * value, n_docs))
    return owner, place, value / norm[owner]


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str, max_train: int = 20_000, bits: int = 18, epochs: int = 6,
          alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, doc_id: str = "doc_id",
          text: str = "text") -> np.ndarray:
    """Weights, the last one the constant's. Rows without a label or id are left out; labels are 0 or 1.

    At most ``max_train`` label rows are used. With no labelled row all weights are zero and every score is 0.5.
    """
    sample = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
              .orderBy(F.xxhash64("id"), "id", "y").limit(max_train))
    groups = max(1, -(-sample.count() // GROUP_ROWS))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.select("id", "text", "y", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).alias("g"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        y = table["y"].to_numpy()
        owner, place, value = features(*text_buffers(table["text"]), bits)
        bounds = np.searchsorted(owner, np.arange(len(y) + 1))
        model = Ftrl(bits, alpha, beta, l1, l2)
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                lo, hi = bounds[i], bounds[i + 1]
                model.update(np.append(place[lo:hi], 1 << bits), np.append(value[lo:hi], 1.0), y[i])
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(at, pa.int32()), "w": w[at], "n": pa.array(np.full(len(at), 1), pa.int32())})

    parts = rows.groupBy("g").applyInArrow(fit, "place int, w double, n int")
    found = parts.groupBy("place").agg(F.sum("w").alias("w"), F.max("n").alias("n")).toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[found["place"].to_numpy(int)] = found["w"].to_numpy(float) / groups
    return weights


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) and the columns named in ``keep``, one row per row of ``docs``."""
    bits = int(len(weights) - 1).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    schema = source.select("doc_id", "_keep").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            logit = np.full(batch.num_rows, float(w[-1]))
            lo = 0
            while lo < batch.num_rows:  # a slice of whole documents at a time
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 21), "right")) - 1)
                owner, place, value = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits)
                logit[lo:hi] += np.bincount(owner, w[place] * value, hi - lo)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(1.0 / (1.0 + np.exp(-logit)))],
                                             names=["doc_id", "_keep", "score"])

    return source.mapInArrow(run, schema).select("doc_id", "score", *[F.col(f"_keep.{c}").alias(c) for c in keep])
