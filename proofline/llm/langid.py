"""Language identification: each document is a mixture of languages.

Character trigrams (letters lower-cased, everything else one blank, the middle a letter) are hashed to a fixed number of
buckets. Training counts them per language over all labelled training rows; the counts are summed in Spark and the
table of log-likelihoods, languages x buckets, is broadcast: its size does not depend on the data.

For a document, expectation-maximisation estimates the proportions of all languages from its n-gram likelihoods. Then
nested sets (the best language, the best two, ...) are fitted again, and the set with the highest log-likelihood minus
``penalty * (languages - 1) * ln(n)`` is taken. The prediction is the language of the largest proportion, the score that
proportion. Whole texts are read, in slices; all documents of a slice are fitted at once with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SLICE_CHARS = 1 << 19
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Bucket of every trigram with a letter in the middle; the text stands between blanks."""
    letters = _is_letter()[codes]
    padded = np.full(len(codes) + 2, 32, np.uint32)
    padded[1:-1] = np.where(letters, codes, 32)
    x = padded[:-2].astype(np.uint64) * np.uint64(0x9E3779B1) + padded[1:-1].astype(np.uint64) * np.uint64(0x85EBCA77)
    x = (x + padded[2:].astype(np.uint64) * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (x[letters] >> np.uint64(48)).astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, buckets) pieces; a long text comes in several."""
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), SLICE_CHARS):
            with np.errstate(over="ignore"):
                yield i, _grams(_codes(text[at:at + SLICE_CHARS]))


def _counted(pieces: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row * BUCKETS + bucket, and their counts."""
    keys = np.concatenate([i * BUCKETS + g for i, g in pieces])
    return np.unique(keys, return_counts=True)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", alpha: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods (buckets x languages), from rows with a non-null language.

    Every partition sends one row per language and bucket it has seen; the sums are at most languages x ``BUCKETS``
    rows. No labelled row gives no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, grams in _slices(batch.column(1).to_pylist()):
                total = sums.setdefault(names[i], np.zeros(BUCKETS, np.int64))
                total += np.bincount(grams, minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique()) if len(counts) else []
    table = np.full((BUCKETS, len(names)), alpha)
    table[counts["bucket"].to_numpy(int), np.searchsorted(names, counts["lang"].to_numpy(str)) if names else []] += counts["n"].to_numpy(float)
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, n: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document, from a start that may exclude languages with zeros."""
    docs, langs = share.shape
    total = np.bincount(doc, n, docs)
    for _ in range(rounds):
        joint = share[doc] * like
        joint *= (n / joint.sum(axis=1))[:, None]
        for j in range(langs):
            share[:, j] = np.bincount(doc, joint[:, j], docs)
        share /= total[:, None]
    fit = np.bincount(doc, n * np.log((share[doc] * like).sum(axis=1)), docs)
    return share, fit


def mixtures(counts: np.ndarray, doc: np.ndarray, logs: np.ndarray, n_docs: int, penalty: float, rounds: int) -> np.ndarray:
    """Proportions (documents x languages) of the chosen sets; ``counts`` and ``logs`` have a row per distinct n-gram."""
    langs = logs.shape[1]
    top = logs.max(axis=1)
    like = np.exp(logs - top[:, None]).astype(np.float64)
    n = counts.astype(np.float64)
    base = np.bincount(doc, n * top, n_docs)
    share, _ = _em(like, n, doc, np.full((n_docs, langs), 1.0 / langs), rounds)
    alone = np.stack([np.bincount(doc, n * (logs[:, j] - top), n_docs) for j in range(langs)], axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    # the set of one language needs no fit; it is the one that explains the document best alone
    first = alone.argmax(axis=1)
    best = np.zeros((n_docs, langs))
    best[np.arange(n_docs), first] = 1.0
    best_value = base + alone.max(axis=1)
    price = penalty * np.log(np.bincount(doc, n, n_docs) + 1.0)
    for size in range(2, langs + 1):
        # a document whose next share is below one in a hundred cannot pay for a further language, which ends the
        # search after a hundred at the latest
        rows = np.flatnonzero(share[np.arange(n_docs), order[:, size - 1]] > 0.01)
        if not len(rows):
            break
        number = np.full(n_docs, -1)
        number[rows] = np.arange(len(rows))
        use = number[doc] >= 0
        start = np.zeros((len(rows), langs))
        for k in range(size):
            start[np.arange(len(rows)), order[rows, k]] = share[rows, order[rows, k]] + 1e-9
        start /= start.sum(axis=1, keepdims=True)
        fitted, value = _em(like[use], n[use], number[doc[use]], start, rounds)
        value = base[rows] + value - price[rows] * (size - 1)
        better = value > best_value[rows]
        best[rows[better]], best_value[rows[better]] = fitted[better], value[better]
    return best


def predict(docs: DataFrame, names: list[str], logs: np.ndarray, doc_id: str = "doc_id", text: str = "text",
            keep: tuple[str, ...] = (), penalty: float = 3.0, rounds: int = 6) -> DataFrame:
    """doc_id, lang_pred, score, shares (proportion per language of the chosen set), and the columns named in ``keep``.

    A null text or one without letters is ``und`` with score 0; so is every row if no language was learned. Repeated rows
    are rated one by one. Sets of any number of languages are tried, in the order of their first shares.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((names, logs))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    schema = (source.select("doc_id", "_keep").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
              .withColumn("shares", F.create_map().cast("map<string,double>")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        limit = SLICE_CHARS * 16 // max(16, len(names))  # the fit holds a number per n-gram and language

        def rated(keys: np.ndarray, counts: np.ndarray, pred: list, score: list, shares: list) -> None:
            if not len(keys) or not names:
                return
            rows, doc = np.unique(keys // BUCKETS, return_inverse=True)
            best = mixtures(counts, doc, logs[keys % BUCKETS].astype(np.float64), len(rows), penalty, rounds)
            for r, row in zip(rows.tolist(), best):
                j = int(row.argmax())
                pred[r], score[r] = names[j], min(1.0, float(row[j]))
                shares[r] = [(names[k], float(row[k])) for k in np.flatnonzero(row > 0)]

        for batch in batches:
            n = batch.num_rows
            pred, score, shares = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            texts = batch.column(1).to_pylist()
            pieces, held = [], 0
            for i, text in enumerate(texts):
                if len(text or "") > SLICE_CHARS:  # a very long text is rated alone, from dense counts
                    dense = sum(np.bincount(g, minlength=BUCKETS) for _, g in _slices([text]))
                    at = np.flatnonzero(dense)
                    rated(i * BUCKETS + at, dense[at], pred, score, shares)
                    continue
                for _, grams in _slices([text]):
                    pieces.append((i, grams))
                    held += len(grams)
                if held > limit:
                    rated(*_counted(pieces), pred, score, shares)
                    pieces, held = [], 0
            if pieces:
                rated(*_counted(pieces), pred, score, shares)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "_keep", "lang_pred", "score", "shares"])

    return source.mapInArrow(run, schema).select("doc_id", "lang_pred", "score", "shares", *[F.col(f"_keep.{c}").alias(c) for c in keep])
