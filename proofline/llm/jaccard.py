"""Self-join of documents on the Jaccard similarity of their word n-grams, by T-occurrence search with DivideSkip.

1. Sets. Every text becomes its set of shingle hashes. Texts of equal sets are one node; exact copies need no search.
2. Frequencies. Shingles are dealt by hash range, in compact blobs (eight bytes a shingle), and counted over sets.
   Shingles in more than ``1 / HOT_SHARE`` of the documents are found in the first pass, a number that only depends on
   the mean set size; they are sent past the counting, so no range holds a hot one. A shingle that occurs once is dropped: it
   never adds to an overlap, only to a set's size.
3. Lists. Two sets of the required similarity share a shingle among the rarest ``n - ceil(t n) + 1`` of both. Every node is
   at home in the longest such list it stands in; nodes of one home are that home's index. A node asks every home that
   comes after its own in (length, key) and has a member of a possible size in one of the node's own lists. So each pair
   of nodes meets at most once, and whatever shares no list never meets: nothing is closed into groups beforehand.
4. Cells. A home of many shingles is cut by set size (sizes further than one step apart cannot link), then by hash; the
   queries to a cell come in waves. Each (cell, wave) is a task of bounded size, and no pair is left out.
5. Search, within a task. For a query set the longest inverted lists are put aside (L of them, by the DivideSkip rule),
   the short ones are merged with a heap, and documents found at least T - L times in those are completed by binary
   probes into the long lists. Where the short lists together hold over ``HEAP_ENTRIES`` entries they are counted in
   an array instead, with the same result.

The results are links that span the components, at most one per node and task, and each node's number of links, never
all pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, shingle_hashes, slices, staged, text_buffers, word_hashes
from .graph import components

HOT_SHARE = 128
RANGE_SHINGLES = 2_000_000
CELL_SHINGLES = 1_000_000
HEAP_ENTRIES = 1024
_INFINITE = np.int32(2**31 - 1)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, bounds) for slices of rows: distinct hashes by row, sorted."""
    data, offsets = text_buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 22), "right")) - 1)
        part = offsets[lo:hi + 1] - offsets[lo]
        doc, words = word_hashes(data[offsets[lo]:offsets[hi]], part, ~WHITE)
        doc, h = shingle_hashes(doc, words, hi - lo, k)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[first], h[first]
        yield lo, h, np.searchsorted(doc, np.arange(hi - lo + 1))
        lo = hi


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit identity of each set, independent of order; 0 for an empty one."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(32)))))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def document_nodes(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) per row, node null for an empty set; and (shingle, n) of shingles frequent in some batch."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row_batch(ids: pa.Array, n: np.ndarray, node: np.ndarray, shingle: np.ndarray | None) -> pa.RecordBatch:
            empty = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(node, mask=n == 0) if shingle is None else empty,
                 empty if shingle is None else pa.array(shingle.view(np.int64))], names=["doc_id", "n_shingles", "node", "shingle"])

        for batch in batches:
            seen, heavy = [], []
            for lo, h, bounds in _sets(batch.column(1), k):
                n, node = np.diff(bounds), _signatures(h, bounds)
                yield row_batch(batch.column(0).slice(lo, len(n)), n, node, None)
                own, at = np.unique(node, return_index=True)
                at.sort()
                values, counts = np.unique(np.concatenate([h[bounds[i]:bounds[i + 1]] for i in at] or [h]), return_counts=True)
                often = counts >= max(2, len(n) // HOT_SHARE)
                seen.append(values[often])
                heavy.append(counts[often])
            values, where = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_inverse=True)
            total = np.bincount(where, np.concatenate(heavy or [np.zeros(0)]), len(values)).astype(np.int64)
            often = total >= max(16, batch.num_rows // HOT_SHARE)
            if often.any():
                yield row_batch(pa.nulls(int(often.sum()), batch.column(0).type), total[often], np.zeros(int(often.sum()), np.int64), values[often])

    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_shingles bigint, node bigint, shingle bigint"), "nodes")
    return (rows.filter("shingle IS NULL").select("doc_id", "n_shingles", "node"),
            rows.filter("shingle IS NOT NULL").select("shingle", F.col("n_shingles").alias("n")))


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


#: ``slice`` numbers a run of documents of one map task; ``at`` are positions in its list of nodes. The head row of a
#: slice (r < 0) has that list and the set sizes; the other rows have shingles of one range.
_BLOB = pa.schema([("r", pa.int32()), ("slice", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()),
                   ("keys", pa.binary()), ("dfs", pa.binary())])
_BLOB_DDL = "r int, slice bigint, nodes binary, sizes binary, at binary, keys binary, dfs binary"


def _positions(at: np.ndarray) -> bytes:
    """Two bytes each where they suffice, else four."""
    return at.astype("<u2" if not len(at) or at.max() < 1 << 16 else "<u4").tobytes()


def _from_positions(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def candidate_sets(docs: DataFrame, hot: np.ndarray, ranges: int, k: int, num: int, den: int, text: str = "text") -> DataFrame:
    """(node, n, keys array<bigint>, n_prefix) for nodes that can have a partner at all.

    ``keys`` are the shingles that occur more than once, rarest first; ``n_prefix`` of them lie in the prefix. A set
    counts once per slice, so copies of a text may count several times; the order is the same for all sets, which is
    all that the prefix needs.
    """
    model = docs.sparkSession.sparkContext.broadcast(np.sort(hot))
    width = np.uint64(ranges)
    # the range takes the upper bits of a hash, as many as it needs, the blobs the others; range 0 is left to hot shingles
    low = np.uint64(64 - max(16, ranges.bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent = model.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sent = np.zeros(0, np.int64)
            for _, h, bounds in _sets(batch.column(0), k):
                node = _signatures(h, bounds)
                own, first = np.unique(node, return_index=True)
                first = first[(np.diff(bounds)[first] > 0) & ~np.isin(own, sent)]
                sent = np.union1d(sent, node[first])
                if not len(first):
                    continue
                n = np.diff(bounds)[first]
                h = np.concatenate([h[bounds[i]:bounds[i + 1]] for i in first])
                at = np.repeat(np.arange(len(first)), n)
                where = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
                is_hot = frequent[where] == h if len(frequent) else np.zeros(len(h), bool)
                # hot shingles pass by the counting, with the head of their slice
                rows: list[tuple] = [(-1 - number % ranges, number, node[first].tobytes(), n.astype(np.int32).tobytes(),
                                      _positions(at[is_hot]), _six(where[is_hot].astype(np.uint64)), np.full(is_hot.sum(), _INFINITE).tobytes())]
                h, at = h[~is_hot], at[~is_hot]
                r = ((h >> low) % width).astype(np.int32)
                order = np.argsort(r, kind="stable")  # within a range still by node
                r, h, at = r[order], h[order] & mask, at[order]
                starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else []
                for lo, hi in zip(starts, np.append(starts[1:], len(r))):
                    rows.append((int(r[lo]), number, None, None, _positions(at[lo:hi]), _six(h[lo:hi]), None))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOB)], schema=_BLOB)

    def count(table: pa.Table) -> pa.Table:
        if table["r"][0].as_py() < 0:
            return table.select(_BLOB.names).cast(_BLOB)
        keys = [_from_six(x) for x in table["keys"].to_pylist()]
        at = np.concatenate([_from_positions(x, len(y)) for x, y in zip(table["at"].to_pylist(), keys)])
        row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        group = np.cumsum(first) - 1
        df = np.empty(len(keys), np.int32)
        df[order] = np.bincount(group)[group]
        keep = np.flatnonzero(df >= 2)
        row, at, keys, df = row[keep], at[keep], keys[keep], df[keep]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        number, r = table["slice"].to_numpy(), table["r"][0].as_py()
        rows = [(r, int(number[row[lo]]), None, None, _positions(at[lo:hi]), _six(keys[lo:hi]), df[lo:hi].tobytes())
                for lo, hi in zip(starts, np.append(starts[1:], len(row)))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_BLOB), _BLOB)], schema=_BLOB)

    def rank(table: pa.Table) -> pa.Table:
        node = size = None
        at, keys, df = [], [], []
        for row in zip(*(table[c].to_pylist() for c in ("r", "nodes", "sizes", "at", "keys", "dfs"))):
            if row[0] < 0:
                node, size = np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32).astype(np.int64)
            keys.append(_from_six(row[4]))
            if row[0] >= 0:  # a shingle is known by its range and the lower bits, a hot one by its place in the model
                keys[-1] = keys[-1] | np.uint64(row[0] + 1) << low
            at.append(_from_positions(row[3], len(keys[-1])))
            df.append(np.frombuffer(row[5], np.int32))
        at, keys, df = np.concatenate(at), np.concatenate(keys), np.concatenate(df)
        order = np.lexsort((keys, df, at))
        at, keys, df = at[order], keys[order], df[order]
        bounds = np.searchsorted(at, np.arange(len(node) + 1))
        shared = np.diff(bounds)
        prefix = size - (num * size + den - 1) // den + 1 - (size - shared)  # the shingles of this node alone come first
        prefix = np.minimum(prefix, shared)
        use = np.flatnonzero(prefix > 0)
        pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in use] or [np.zeros(0, np.int64)])
        ends = np.concatenate(([0], np.cumsum(shared[use])))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[pick].view(np.int64)))
        return pa.table({"node": node[use], "n": size[use], "keys": lists, "n_prefix": pa.array(prefix[use], pa.int32())})

    counted = docs.select(F.col(text).alias("text")).mapInArrow(deal, _BLOB_DDL).groupBy("r").applyInArrow(count, _BLOB_DDL)
    ranked = counted.groupBy("slice").applyInArrow(rank, "node bigint, n bigint, keys array<bigint>, n_prefix int")
    # a set that several slices hold has the same shingles and frequencies in each
    return ranked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "keys", "n_prefix")])


class Labels:
    """Components of 0..n-1, each named by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        found = self.of[others]
        if (found != self.of[i]).any():
            names = np.unique(np.append(found, self.of[i]))
            self.of[np.isin(self.of, names)] = names[0]


def _counts(short: list[np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists within lo..hi, ascending, and in how many lists each stands."""
    if sum(map(len, short)) > HEAP_ENTRIES:
        times = np.bincount(np.concatenate(short) - lo, minlength=hi - lo)
        found = np.flatnonzero(times)
        return found + lo, times[found]
    found, times = [], []
    for j in heapq.merge(*(x.tolist() for x in short)):
        if found and found[-1] == j:
            times[-1] += 1
        else:
            found.append(j)
            times.append(1)
    return np.array(found, np.int64), np.array(times, np.int64)


def divide_skip(sizes: np.ndarray, sets: list[np.ndarray], query: np.ndarray, index: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(q, partners) of every query that has some: all pairs (query, index) with den * overlap >= num * union, each once.

    ``sizes`` are full set sizes; ``sets`` hold the shingles that can be shared. A row may be both query and index.
    """
    order = np.flatnonzero(index)[np.argsort(sizes[index], kind="stable")]  # the index, shortest set first
    count = len(order)
    place = np.full(len(sizes), -1)
    place[order] = np.arange(count)
    known, rank = np.unique(np.concatenate([sets[i] for i in order] or [np.zeros(0, np.int64)]), return_inverse=True)
    if not len(known):
        return
    # an entry of the inverted lists is (list, place in the order); all lists lie one behind the other
    entries = np.sort(rank * count + np.repeat(np.arange(count), [len(sets[i]) for i in order]))
    index_sizes = sizes[order]
    for q in np.flatnonzero(query):
        n = int(sizes[q])
        shortest = (num * n + den - 1) // den
        lo = int(np.searchsorted(index_sizes, shortest))
        hi = int(np.searchsorted(index_sizes, n * den // num, "right"))
        if place[q] >= 0:
            hi = min(hi, int(place[q]))  # both ways is once too often
        if lo >= hi:
            continue
        at = np.minimum(np.searchsorted(known, sets[q]), len(known) - 1)
        lists = at[known[at] == sets[q]]
        starts, ends = np.searchsorted(entries, lists * count + lo), np.searchsorted(entries, lists * count + hi)
        length = ends - starts
        least = -(-num * (n + shortest) // (num + den))  # T for the shortest partner
        used = np.flatnonzero(length)
        if len(used) < least:
            continue
        used = used[np.argsort(length[used], kind="stable")]
        aside = min(least - 1, int(least / (0.0085 * np.log2(length[used[-1]] + 1) + 1)), len(used) - 1)
        short, long = used[:len(used) - aside], lists[used[len(used) - aside:]]
        found, times = _counts([entries[starts[i]:ends[i]] - lists[i] * count for i in short], lo, hi)
        enough = times >= least - aside
        found, times = found[enough], times[enough]
        step = max(1, (1 << 18) // max(1, len(found)))
        for k in range(0, len(long) if len(found) else 0, step):  # all are needed for the exact count
            wanted = long[k:k + step, None] * count + found
            times = times + (entries[np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)] == wanted).sum(axis=0)
        linked = found[den * times >= num * (n + index_sizes[found] - times)]
        if len(linked):
            yield int(q), order[linked]


def _linked(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links found in one bin of tasks: a node, the first node of its component in the task, the documents it links with there."""
    group = group.sort_by([("task", "ascending"), ("node", "ascending")])
    task, node = group["task"].to_numpy(), group["node"].to_numpy()
    sizes, role, copies = group["n"].to_numpy(), group["role"].to_numpy(), group["copies"].to_numpy()
    keys = group["keys"].combine_chunks()
    bounds, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(starts, np.append(starts[1:], len(task))):
        if hi - lo < 2:
            continue
        labels, links = Labels(hi - lo), np.zeros(hi - lo, np.int64)
        sets = [flat[bounds[i]:bounds[i + 1]] for i in range(lo, hi)]
        for q, partners in divide_skip(sizes[lo:hi], sets, role[lo:hi] != 1, role[lo:hi] != 2, num, den):
            labels.join(q, partners)
            links[q] += copies[lo + partners].sum()
            links[partners] += copies[lo + q]
        some = np.flatnonzero(links)
        out.append((node[lo + some], node[lo + labels.of[some]], links[some]))
    a, b, n = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"a": a, "b": b, "links": n})


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, links) per node and task: b is a node of the same component, ``links`` the rows that node a links with.

    ``sets``: node, n, keys, n_prefix, copies. The edges (a, b) span the components of the exact similarity graph, the
    sums of ``links`` by a are exact.
    """
    step = math.log(den / num) * (1 + 1e-9) if num < den else 1e-6

    def size_step(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / step).cast("int")

    postings = sets.select("node", "n", F.size("keys").cast("bigint").alias("m"), F.explode(F.slice("keys", 1, F.col("n_prefix"))).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
    home = F.max(F.struct("length", "key")).over(Window.partitionBy("node"))
    placed = staged(postings.join(lists, "key").select("node", "n", "m", "key", home.alias("home")), "placed")
    members = staged(placed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "m", "home")]), "members")

    there = placed.groupBy("key", F.col("home").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asks = placed.join(there, "key").filter(
        (F.col("other") > F.col("home")) & (num * F.col("n") <= den * F.col("hi")) & (num * F.col("lo") <= den * F.col("n")))
    asks = asks.select("node", "m", F.col("other").alias("home"), size_step(F.col("n")).alias("own")).distinct()

    large = members.groupBy("home").agg(F.sum("m").alias("total")).filter(F.col("total") > CELL_SHINGLES).select("home")
    cells = members.join(large, "home").groupBy("home", size_step(F.col("n")).alias("s")).agg(
        F.ceil(F.sum("m") / CELL_SHINGLES).cast("int").alias("blocks"))
    cells = staged(cells, "cells")
    index = members.withColumn("own", size_step(F.col("n"))).join(cells.withColumnRenamed("s", "own"), ["home", "own"], "left")
    cut = F.col("blocks").isNotNull()
    index = staged(index.select("node", "m", "home", F.when(cut, F.col("own")).otherwise(-1).alias("s"),
                                F.when(cut, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int").alias("block")), "index")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    inside = index.filter("s >= 0").select("node", "m", "home", F.col("s").alias("own"), F.col("block").alias("own_block")).join(cells, "home").filter(
        "s = own OR s = own + 1").select("node", "m", "home", "own", "own_block", "s", every.alias("block")).filter("s > own OR block > own_block")
    outside = asks.join(cells, "home", "left").filter("s IS NULL OR abs(s - own) <= 1").select(
        "node", "m", "home", F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("blocks", F.lit(1)).alias("blocks")).select(
        "node", "m", "home", "s", every.alias("block"))
    asked = staged(inside.select("node", "m", "home", "s", "block").unionByName(outside), "asked")
    cell = ["home", "s", "block"]
    waves = staged(asked.groupBy(*cell).agg((F.floor(F.sum("m") / CELL_SHINGLES) + 1).cast("int").alias("waves")), "waves")
    wave = F.explode(F.sequence(F.lit(0), F.coalesce("waves", F.lit(1)) - 1))
    rows = index.join(waves, cell, "left").select("node", "m", *cell, wave.alias("wave")).withColumn("role", F.when(F.col("wave") == 0, 0).otherwise(1))
    rows = rows.unionByName(asked.join(waves, cell).select(
        "node", "m", *cell, F.pmod(F.xxhash64("node", F.lit(1)), F.col("waves")).cast("int").alias("wave"), F.lit(2).alias("role")))
    tasks = staged(rows.select("node", "m", F.xxhash64("home", "s", "block", "wave").alias("task"), (F.col("s") >= 0).alias("alone"), "role"), "tasks")
    bins = (tasks.agg(F.sum("m").alias("total")).first()["total"] or 0) // RANGE_SHINGLES + 8
    own_bin = F.when(F.col("alone"), F.col("task")).otherwise(F.pmod("task", F.lit(bins)))
    dealt = tasks.join(sets.select("node", "n", "keys", "copies"), "node").select(own_bin.alias("bin"), "task", "node", "n", "keys", "copies", "role")
    return staged(dealt.groupBy("bin").applyInArrow(lambda t: _linked(t, num, den), "a bigint, b bigint, links bigint"), "links")


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, one row per row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence
    of a shorter text. Two texts link if ``den * intersection >= num * union``. ``component_id`` is the smallest doc_id
    reachable by links, the own one included; ``n_links`` counts the other rows it links with. A null or blank text has an empty set and links with nothing. Repeated
    rows are copies of each other. A null id is a row that never names a component unless all its members are null.
    """
    nodes, heavy = document_nodes(docs, k, doc_id, text)
    stats = nodes.agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total")).first()
    least = max(2, stats["docs"] // HOT_SHARE)
    hot = heavy.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # at most HOT_SHARE times the mean set size of them
    hot = np.array([r["shingle"] for r in hot.select("shingle").collect()], np.int64).view(np.uint64)
    ranges = int(max(16, (stats["total"] or 0) // RANGE_SHINGLES + 1))
    classes = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    repeated = staged(classes.filter("copies > 1"), "repeated")
    sets = candidate_sets(docs, hot, ranges, k, num, den, text).join(repeated.select("node", "copies"), "node", "left")
    found = links(staged(sets.withColumn("copies", F.coalesce("copies", F.lit(1))), "sets"), num, den)
    joined = components(found.filter("a <> b").select("a", "b").distinct())
    named = classes.join(joined, "node").groupBy("component").agg(F.min("least").alias("name"))
    linked = joined.join(staged(named, "named"), "component").select("node", "name")
    linked = linked.join(found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node")
    copies = repeated.join(linked, "node", "full").select(
        "node", F.coalesce("name", "least").alias("name"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    names = staged(copies, "names")
    return nodes.join(names, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def oracle(k: int, num: int, den: int, source: str = "documents") -> str:
    """DuckDB SQL for :func:`similar_documents`: all sets, all shared shingles, all links, transitive closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
 sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i + {k - 1}], ' ') FOR i IN range(1, len(ws) - {k - 2})]) END AS s FROM w),
 n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
 flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sh),
 pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
 sym AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b)
 SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = doc_id), doc_id)) AS component_id,
  (SELECT count(*) FROM sym WHERE sym.a = doc_id) AS n_links FROM n"""
