"""Source divergence audit: which sources of a language use words differently, and which words set them apart.

A term is a run of letters A-Z, lower-cased, and of characters outside ASCII. A language keeps the terms that at least
``least`` of its documents hold. They are found by iceberg prefix refinement:

1. Each level counts, per language, the distinct documents of every term prefix of a fixed number of bytes, over all
   documents. A term that is shorter counts as it is. Prefixes below the threshold go, and with them every term they
   begin, so the long tail of rare terms is never counted or shuffled as whole terms.
2. The next level takes four times the length and counts only terms that are longer than the level before and whose shorter
   prefix is left; shorter terms were counted as they are. The refinement ends when no prefix that is left begins a longer
   term: complete terms remain, each among the keys left by the level that first took it whole.
3. Only those are counted as strings, by language and source, and held against the threshold once more.

Between levels the prefixes that are left travel as a bit map of ``2 ** FILTER_BITS`` bits, whatever their number. A
prefix is named by 48 bits of a hash. Clashes in either can only let a term through that step 3 then rejects, so the
result is exact.

Probabilities are integers in billionths, so every sum is exact and independent of order. The pairs of sources are
computed in blocks of terms and chunks of sources; a block is a dense table of bounded size inside one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _BASE, _INVERSE, LOWER, SLICE_BYTES, mix, slices, staged, text_buffers

FILTER_BITS = 26
FIRST_LENGTH = 4
GROWTH = 4
BLOCK_TERMS = 4096
CHUNK_SOURCES = 64
FLUSH_TERMS = 1_000_000
FLUSH_DOCS = 1 << 15
UNIT = 1_000_000_000
#: Bytes of a term: letters and every byte of a character outside ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in some bytes; no term passes a document end in ``cuts``."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = TERM[raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    touching = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    starts[touching] = True
    ends[touching - 1] = True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Hasher:
    """Hashes of byte ranges from running sums; the powers are made once."""

    def __init__(self):
        self.power = self.back = np.zeros(0, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(raw):
            n = max(len(raw), SLICE_BYTES) + 1
            with np.errstate(over="ignore"):
                self.power, self.back = np.full(n, _BASE), np.full(n, _INVERSE)
                self.power[0] = self.back[0] = 1
                np.multiply.accumulate(self.power, out=self.power)
                np.multiply.accumulate(self.back, out=self.back)
        out = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.power[:len(raw)], out=out[1:])
        return out

    def prefixes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, salt: np.ndarray) -> np.ndarray:
        """48-bit keys of the first ``length`` bytes of each range, or of all of it."""
        stops = np.minimum(starts + length, ends)
        with np.errstate(over="ignore"):
            h = (sums[stops] - sums[starts]) * self.back[starts] + (stops - starts).view(np.uint64) ^ salt
            return ((h ^ (h >> np.uint64(32))) * _BASE) >> np.uint64(16)

    def whole(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the ranges."""
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).view(np.uint64))


def passes(keys: np.ndarray, bit_map: np.ndarray, bits: int) -> np.ndarray:
    """True where the bit of a 48-bit key is set."""
    at = keys >> np.uint64(48 - bits)
    return (bit_map[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, bytes, row, start, end) of all terms, a slice at a time."""
    for lo, hi in slices(data, offsets, ~TERM):
        raw = data[lo:hi]
        starts, ends = spans(raw, offsets[(offsets > lo) & (offsets < hi)] - lo)
        yield lo, raw, np.searchsorted(offsets, starts + lo, "right") - 1, starts, ends


def _tally(packed: list[np.ndarray]) -> pa.RecordBatch:
    """Documents per key from ``key << 16 | document << 1 | longer``."""
    all_ = np.sort(np.concatenate(packed))
    keys = all_ >> np.uint64(16)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    pair = all_ >> np.uint64(1)
    new = np.ones(len(pair), np.int64)
    new[1:] = pair[1:] != pair[:-1]
    docs = np.add.reduceat(new, first) if len(first) else np.zeros(0, np.int64)
    longer = np.maximum.reduceat(all_ & np.uint64(1), first) if len(first) else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(keys[first].astype(np.int64)), pa.array(docs), pa.array(longer == 1)], ["key", "docs", "longer"])


def _counter(length: int, before: int, bit_map: Broadcast | None, bits: int):
    """Rows (salt, text) to (key, docs, longer): prefixes of ``length`` bytes of terms longer than ``before``, whose first ``before`` bytes are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            salts = batch.column("salt").to_numpy().view(np.uint64)
            packed, held, low, last = [], 0, 0, -1
            for _, raw, row, starts, ends in _terms(*text_buffers(batch.column("text"))):
                at = 0
                while at < len(row):  # at most FLUSH_DOCS documents before a tally
                    stop = int(np.searchsorted(row, low + FLUSH_DOCS))
                    if stop <= at or (held > FLUSH_TERMS and row[at] > last):
                        if packed:
                            yield _tally(packed)
                        packed, held, low = [], 0, int(row[at])
                        continue
                    sums = hasher.sums(raw) if at == 0 else sums
                    r, s, e = row[at:stop], starts[at:stop], ends[at:stop]
                    last = int(r[-1])
                    if bit_map is not None:
                        longer = e - s > before
                        r, s, e = r[longer], s[longer], e[longer]
                        left = passes(hasher.prefixes(sums, s, e, before, salts[r]), bit_map.value, bits)
                        r, s, e = r[left], s[left], e[left]
                        if not len(r):
                            at = stop
                            continue
                    key = hasher.prefixes(sums, s, e, length, salts[r])
                    packed.append(key << np.uint64(16) | (r - low).view(np.uint64) << np.uint64(1) | (e - s > length).astype(np.uint64))
                    held += len(packed[-1])
                    if len(packed) > 1 and held > 4 * FLUSH_TERMS:  # one very long document
                        packed = [np.unique(np.concatenate(packed))]
                        held = len(packed[0])
                    at = stop
            if packed:
                yield _tally(packed)

    return run


def _bit_map(alive: DataFrame, bits: int) -> np.ndarray:
    """The keys as a bit map, put together in Spark; at most ``2 ** bits / 64`` numbers arrive."""
    at = alive.select(F.shiftright("key", 48 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("ones")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("ones").to_numpy().view(np.uint64)
    return out


def _strings(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lowered[at]))


class Held:
    """Occurrences of terms: group and row, hash, place in the bytes of the batch, how often."""

    def __init__(self):
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.n, self.last = 0, -1

    def add(self, group: np.ndarray, row: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> None:
        self.columns.append((group, row, h, start, size, n))
        self.n, self.last = self.n + len(row), int(row[-1])

    def runs(self, by_row: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """All columns sorted by group and term (and row), the first of each run, and rows per run of a term."""
        group, row, h, start, size, n = map(np.concatenate, zip(*self.columns))
        with np.errstate(over="ignore"):
            order = np.argsort(mix(h + group.astype(np.uint64) * _BASE))
        group, row, h, start, size, n = (c[order] for c in (group, row, h, start, size, n))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
        run = np.cumsum(new) - 1
        if by_row:
            order = np.lexsort((row, run))
            group, row, h, start, size, n, run = (c[order] for c in (group, row, h, start, size, n, run))
            new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
        pairs = np.sort(run.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64))
        distinct = np.ones(len(pairs), bool)
        distinct[1:] = pairs[1:] != pairs[:-1]
        docs = np.bincount((pairs[distinct] >> np.uint64(32)).astype(np.int64), minlength=int(run[-1]) + 1)
        return (group, row, h, start, size, n), np.flatnonzero(new), docs

    def shrink(self) -> None:
        """Sums repeats within a document, for one that is very long."""
        columns, first, _ = self.runs(by_row=True)
        self.columns = [(*(c[first] for c in columns[:5]), np.add.reduceat(columns[5], first))]
        self.n = len(first)


def _counted(length: int, bit_map: Broadcast, bits: int):
    """Rows (lang, source, salt, text) to (lang, source, term, count, docs) of the terms that are left.

    Within a batch a term is named by its 64-bit hash; its length and its first eight bytes are compared too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            salts = batch.column("salt").to_numpy().view(np.uint64)
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            data, offsets = text_buffers(batch.column("text"))
            padded = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
            heads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

            def flush(held: Held) -> pa.RecordBatch:
                (group, _, _, start, size, n), first, docs = held.runs(by_row=False)
                run_of = np.repeat(first, np.diff(first, append=len(group)))
                shift = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
                if ((size != size[run_of]) | ((heads[start] ^ heads[start[run_of]]) << shift != 0)).any():
                    raise ArithmeticError("two terms of a batch have one hash")
                group = group[first]
                return pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))),
                     _strings(padded, start[first], start[first] + size[first]).cast(pa.string()), pa.array(np.add.reduceat(n, first)), pa.array(docs)],
                    ["lang", "source", "term", "count", "docs"])

            held = Held()
            for lo, raw, row, starts, ends in _terms(data, offsets):
                sums = hasher.sums(raw)
                left = passes(hasher.prefixes(sums, starts, ends, length, salts[row]), bit_map.value, bits)
                row, starts, ends = row[left], starts[left], ends[left]
                if not len(row):
                    continue
                if held.n > FLUSH_TERMS and row[0] > held.last:
                    yield flush(held)
                    held = Held()
                held.add(codes[row], row.astype(np.int64), hasher.whole(sums, starts, ends), starts + lo, ends - starts, np.ones(len(row), np.int64))
                if held.n > 2 * FLUSH_TERMS and len(held.columns) > 1:
                    held.shrink()
            if held.n:
                yield flush(held)

    return run


def frequent_terms(docs: DataFrame, least: int = 3, first_length: int = FIRST_LENGTH, bits: int = FILTER_BITS) -> DataFrame:
    """lang, source, term, count, docs of all terms that may reach ``least`` documents of their language.

    Takes ``lang, source, text`` without nulls. Every row is a document. Terms below the threshold that clashes of hashes
    let through are still in the result.
    """
    spark = docs.sparkSession
    rows = docs.select("lang", "source", F.xxhash64("lang").alias("salt"), "text")
    length, before, bit_map = first_length, 0, None
    settled = np.zeros(1 << (bits - 6), np.uint64)
    while True:
        seen = rows.select("salt", "text").mapInArrow(_counter(length, before, bit_map, bits), "key bigint, docs bigint, longer boolean")
        seen = seen.groupBy("key").agg(F.sum("docs").alias("docs"), F.bool_or("longer").alias("longer"))
        alive = staged(seen.filter(F.col("docs") >= least).select("key", "longer"), "prefixes")
        left = _bit_map(alive, bits)
        settled |= left
        if alive.filter("longer").isEmpty():
            break
        bit_map = spark.sparkContext.broadcast(left)
        before, length = length, GROWTH * length
    found = rows.mapInArrow(_counted(length, spark.sparkContext.broadcast(settled), bits), "lang string, source string, term string, count bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """SQL for ``1 + floor(UNIT * (count + 1) / total)``, in long arithmetic where that is exact."""
    wide = f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0)) div CAST({total} AS DECIMAL(20,0))"
    return f"1 + CASE WHEN {count} < {(1 << 63) // UNIT - 1} THEN ({UNIT}L * ({count} + 1)) div {total} ELSE {wide} END"


def _block(table: pa.Table) -> pa.Table:
    """Sums over the terms of a block for the pairs between two chunks of sources."""
    heads = table.filter(pc.is_null(table.column("term")))
    cells = table.filter(pc.is_valid(table.column("term")))
    sources = heads.column("source").combine_chunks()
    chunk = heads.column("chunk").to_numpy()
    base = heads.column("p").to_numpy()
    terms = int(heads.column("terms")[0].as_py())
    codes = cells.column("term").combine_chunks().dictionary_encode()
    p = np.tile(base, (len(codes.dictionary), 1))
    p[codes.indices.to_numpy(zero_copy_only=False), pc.index_in(cells.column("source").combine_chunks(), sources).to_numpy(zero_copy_only=False)] = cells.column("p").to_numpy()
    lang = table.column("lang")[0].as_py()
    across = chunk.min() != chunk.max()
    g_all, h_all, value = [], [], []
    for h in range(len(sources)):
        other = np.flatnonzero(chunk != chunk[h] if across else np.arange(len(sources)) != h)
        q = p[:, h:h + 1]
        apart = p[:, other] - q
        rest = (terms - len(p)) * ((base[other] - base[h]) ** 2 // base[h])
        value.append((apart * apart // q).sum(axis=0) + rest)
        g_all.append(other)
        h_all.append(np.full(len(other), h))
    g, h = np.concatenate(g_all).astype(np.int64), np.concatenate(h_all).astype(np.int64)
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": sources.take(pa.array(g)).cast(pa.string()),
                     "item": sources.take(pa.array(h)).cast(pa.string()), "value": pa.array(np.concatenate(value).astype(np.int64))})


def audit(docs: DataFrame, least: int = 3, top_terms: int = 200, block_terms: int = BLOCK_TERMS, chunk_sources: int = CHUNK_SOURCES, **options) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    With ``p`` the share of a kept term in a group (in billionths, one added to each count) and ``q`` that of the item,
    ``f = floor((p - q)^2 / q)``. Part ``pair``: items are all other sources of the language, the value sums ``f`` over the
    kept terms (0 without kept terms), all ranks. Part ``term``: items are the group's own terms that it uses more than
    its language does, ``q`` being the language's share, only the first ``top_terms`` ranks. Ranks go by value, then by
    the bytes of the item.

    Null ``lang``, ``source`` and ``text`` are empty texts; the empty language and the empty source are groups like
    others. Every row is a document, also a repeated one. A language with one source has no pairs. Whole texts count,
    however long. Other columns are not looked at. An empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = staged(frequent_terms(docs, least, **options), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
    kept = staged(kept.filter(F.col("docs") >= least).select("lang", "term", "lang_count"), "kept")
    counts = staged(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    by_lang = Window.partitionBy("lang")
    groups = groups.fillna(0, ["n", "v", "lang_n"]).select(
        "*", ((F.row_number().over(by_lang.orderBy("source")) - 1) / chunk_sources).cast("int").alias("chunk"),
        F.ceil(F.count("*").over(by_lang) / chunk_sources).cast("int").alias("chunks"), F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int").alias("blocks"))
    groups = staged(groups, "groups")

    cells = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("count", "(n + v)")))
    q = F.expr(share("lang_count", "(lang_n + v)"))
    terms = cells.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    spread = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sizes = (kept.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", block).agg(F.count("*").alias("terms")))
    heads = (groups.withColumn("p", F.when(F.col("v") > 0, F.expr(share("0L", "(n + v)"))).otherwise(1).cast("bigint"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left").fillna(0, ["terms"]))
    columns = ["lang", "block", F.least("chunk", "x").alias("a"), F.greatest("chunk", "x").alias("b"), "chunk", "source", "term", "p", "terms"]
    heads = heads.withColumn("x", spread).withColumn("term", F.lit(None).cast("string")).select(*columns)
    cells = cells.withColumn("block", block).withColumn("x", spread).withColumn("terms", F.lit(None).cast("bigint")).select(*columns)
    pairs = heads.unionByName(cells).groupBy("lang", "block", "a", "b").applyInArrow(_block, "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def oracle(least: int = 3, top_terms: int = 200) -> str:
    """DuckDB SQL for the rows of :func:`audit` over ``documents``: every kept term in every group."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
 k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {least}),
 g AS (SELECT DISTINCT lang, source FROM d),
 dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  UNION ALL SELECT lang, NULL, term, n FROM k),
 p AS MATERIALIZED (SELECT *, CAST(1 + ({UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS HUGEINT) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
 pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y ON x.term = y.term
   WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
 tm AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, ((x.p - y.p) * (x.p - y.p)) // y.p AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND y.source IS NULL
  WHERE x.source IS NOT NULL AND x.n > 0 AND x.p > y.p),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top_terms}"""
