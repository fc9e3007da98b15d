"""Exact top-k search by inner product: a Voronoi kNN join.

A component ``x`` of a vector becomes ``floor(256 * x)``; the score of two vectors is the inner product of these
integers. The largest inner products of a query are its nearest neighbours once every data vector gets one more
coordinate ``sqrt(M^2 - |x|^2)`` (``M`` the longest data vector) and every query a zero there, so the join works with
distances in that space:

1. Pivots are distinct vectors of a bounded sample. Every vector goes to the cell of its nearest pivot, once as data and,
   if it is a query, once as a query. The sample only decides how well the cells fit; every row takes part.
2. Summaries: of each data cell the number of rows and the ``k + 1`` smallest distances to its pivot, of each query
   cell the number of rows and the largest distance. They hold ``pivots x (k + 1)`` numbers, whatever the input.
3. Bounds: for a query cell the ``k + 1`` smallest sums "radius of the query cell + distance of the pivots + distance of
   a data row to its pivot" bound the distance of the k-th neighbour (one of them may be the query's own row). By the
   triangle inequality only data rows whose distance to their own pivot lies in an interval can come that close.
4. Query cells are chained to groups of at most ``group_queries`` rows; a larger cell is cut by row. A data row is sent
   to the groups whose interval it meets, and there to one of several blocks; the queries of a group are sent to all its
   blocks. A task streams the data of a block past the queries, with a running top-k, so its memory is bounded by the
   queries of one group, not by the data.
5. The best of the blocks are ranked per query.

In many dimensions distances concentrate and the intervals of step 3 let most rows through: the join is then the whole
query set against all rows, in blocks, and stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from proofline.session import task_parallelism

from .common import staged

SAMPLE = 4096
SLICE_ROWS = 2048
QUERY_ROWS = 512
LOWEST = np.iinfo(np.int64).min


def encoded(table: DataFrame, vec_id: str, embedding: str, is_query: Column) -> DataFrame:
    """rid, vec_id, v (integers), query; rows without a usable vector are left out."""
    x = F.col(embedding)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 256.0).cast("bigint"))
    return (table.filter(F.coalesce(usable, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("query")))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, dtype: type = np.float64) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(dtype)
    out = np.zeros((len(sizes), dims), dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The additional coordinate of data vectors."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))])


def flattened(pivots: np.ndarray) -> np.ndarray:
    """The same pivots where the queries lie."""
    return np.column_stack([pivots[:, :-1], np.zeros(len(pivots))])


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance of each row."""
    square = np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0.0)
    cell = square.argmin(1)
    return cell, np.sqrt(square[np.arange(len(x)), cell])


def with_cells(rows: DataFrame, pivots: np.ndarray, longest: float, dims: int) -> DataFrame:
    """``rows`` with cell and distance as data (``cell``, ``far``) and, of queries, as a query (``qcell``, ``qfar``)."""
    flat = flattened(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                x = lifted(matrix(batch.column("v"), dims), longest)
                cell, far = nearest(x, pivots)
                x[:, -1] = 0.0
                qcell, qfar = nearest(x, flat)
                extra = {"cell": cell.astype(np.int32), "far": far, "qcell": qcell.astype(np.int32), "qfar": qfar}
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra.values())], [*batch.schema.names, *extra])

    schema = T.StructType(rows.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()),
                                                T.StructField("qcell", T.IntegerType()), T.StructField("qfar", T.DoubleType())])
    return rows.mapInArrow(cells, schema)


def bounds(pivots: np.ndarray, nearest_rows: dict[int, list[float]], radius: dict[int, float], k: int) -> dict[tuple[int, int], tuple[float, float]]:
    """(query cell, data cell) -> the interval of distances to the pivot in which a data row can matter."""
    apart = np.sqrt(((flattened(pivots)[:, None, :] - pivots[None, :, :]) ** 2).sum(2))
    out = {}
    for i, reach in radius.items():
        sums = sorted(reach + apart[i, j] + d for j, distances in nearest_rows.items() for d in distances)
        kth = sums[k] if len(sums) > k else np.inf
        slack = 1e-6 * (1.0 + apart[i].max() + reach + (kth if np.isfinite(kth) else 0.0))  # rounding never drops a row
        for j in nearest_rows:
            out[i, j] = (apart[i, j] - reach - kth - slack, apart[i, j] + reach + kth + slack)
    return out


def grouped_cells(pivots: np.ndarray, counts: dict[int, int], group_queries: int) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Rows (query cell, part, group) and the number of parts of each cell: neighbouring cells share a group."""
    left, order = set(counts), []
    while left:  # a chain of nearest pivots
        i = min(left) if not order else min(left, key=lambda j: (((pivots[order[-1]] - pivots[j]) ** 2).sum(), j))
        order.append(i)
        left.remove(i)
    rows, parts, group, filled = [], {}, 0, 0
    for i in order:
        parts[i] = -(-counts[i] // group_queries)
        if filled and (parts[i] > 1 or filled + counts[i] > group_queries):
            group, filled = group + 1, 0
        for p in range(parts[i]):
            rows.append((i, p, group))
            if parts[i] > 1:
                group += 1
        filled = 0 if parts[i] > 1 else filled + counts[i]
    return rows, parts


class Running:
    """Running top-k of the queries of one block."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
        order = np.argsort(rids)
        self.rids, self.ids, self.q, self.k = rids[order], ids[order], q[order], k
        n = len(order)
        # missing entries: the lowest score and the largest id; a null vec_id is the largest id too
        self.score = np.full((n, k), LOWEST, np.int64)
        self.vec = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.null = np.zeros((n, k), bool)
        self.some = np.zeros((n, k), bool)

    def add(self, rids: np.ndarray, ids: np.ndarray, nulls: np.ndarray, x: np.ndarray) -> None:
        own = np.searchsorted(self.rids, rids)
        own_at = np.flatnonzero((own < len(self.rids)) & (self.rids[np.minimum(own, len(self.rids) - 1)] == rids))
        for lo in range(0, len(self.q), QUERY_ROWS):
            s = self.q[lo:lo + QUERY_ROWS] @ x.T
            if s.dtype == object:  # products beyond 64 bits
                s = np.clip(s, LOWEST, np.iinfo(np.int64).max).astype(np.int64)
            valid = None
            mine = own_at[(own[own_at] >= lo) & (own[own_at] < lo + len(s))]
            if len(mine):
                valid = np.ones(s.shape, bool)
                valid[own[mine] - lo, mine] = False
            last = self.score[lo:lo + len(s), -1]
            full = self.some[lo:lo + len(s), -1]
            good = (s >= last[:, None]) | ~full[:, None]
            if valid is not None:
                good &= valid
            if good.sum() > 16 * self.k * len(s) and s.shape[1] > self.k + 1:
                # one more than k: the query's own row may be among them
                least = np.partition(s, s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1]
                good &= s >= least[:, None]
            at, col = np.nonzero(good)
            if len(at):
                self._merge(lo, at, s[at, col], ids[col], nulls[col])

    def _merge(self, lo: int, at: np.ndarray, score: np.ndarray, vec: np.ndarray, null: np.ndarray) -> None:
        rows = np.unique(at)
        old = self.some[lo + rows]
        i, j = np.nonzero(old)
        at = np.concatenate([at, rows[i]])
        score = np.concatenate([score.astype(np.int64), self.score[lo + rows[i], j]])
        vec = np.concatenate([vec, self.vec[lo + rows[i], j]])
        null = np.concatenate([null, self.null[lo + rows[i], j]])
        order = np.lexsort((vec, null, ~score, at))  # ~score falls as the score rises, without overflow
        at, score, vec, null = at[order], score[order], vec[order], null[order]
        first = np.searchsorted(at, at)
        place = np.arange(len(at)) - first
        keep = place < self.k
        at, place = lo + at[keep], place[keep]
        self.some[lo + rows] = False
        self.score[at, place], self.vec[at, place], self.null[at, place], self.some[at, place] = score[keep], vec[keep], null[keep], True

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.some)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rids[i]), pa.array(self.ids[i]), pa.array(self.vec[i, j], mask=self.null[i, j]), pa.array(self.score[i, j])],
            ["rid", "query_id", "vec_id", "score"])


def solve(dims: int, dtype: type, k: int):
    """A function over rows sorted by (g, block, data): the queries of a block come before its data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queries, running = None, [], None
        for batch in batches:
            g, block, data = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "block", "data"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(block) != 0) | (np.diff(data) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                if (g[lo], block[lo]) != here:
                    if running is not None:
                        yield running.result()
                    here, queries, running = (g[lo], block[lo]), [], None
                part = batch.slice(lo, hi - lo)
                rids = part.column("rid").to_numpy()
                nulls = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                if not data[lo]:
                    queries.append((rids, ids, matrix(part.column("v"), dims, dtype)))
                    continue
                if running is None and queries:
                    running = Running(*(np.concatenate(c) for c in zip(*queries)), k)
                    queries = []
                for at in range(0, hi - lo if running is not None else 0, SLICE_ROWS):
                    end = at + SLICE_ROWS
                    running.add(rids[at:end], ids[at:end], nulls[at:end], matrix(part.column("v").slice(at, SLICE_ROWS), dims, dtype))
        if running is not None:
            yield running.result()

    return run


def top_k(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = 128,
          group_queries: int = 65536, block_rows: int = 131072) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each row that ``is_query`` names, all if there are fewer.

    Candidates are all rows but the query's own row: a row with the same ``vec_id``, or an exact copy, is a candidate.
    Ties go to the smaller ``vec_id``, a null one last. Rows whose vector is null or holds a null or a component that is
    not finite take no part, neither as queries nor as candidates; a query without candidates has no row. Vectors of
    different lengths are compared as if the shorter ended in zeros, an empty one scores zero. Components of 2^55 and
    more, and scores outside 64 bits, stop at the limits of a long. Other columns are not looked at.
    """
    spark = table.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = staged(encoded(table, vec_id, embedding, is_query), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    most = rows.agg(F.count("*").alias("rows"), F.count_if("query").alias("queries"), F.max(F.size("v")).alias("dims"), F.max(norm).alias("longest"),
                    F.max(F.array_max(F.transform("v", F.abs))).alias("size")).first()
    if not most.queries or most.rows < 2:
        return spark.createDataFrame([], out)
    dims, size = max(most.dims, 1), max(most.size or 0, 1)
    exact = size * size * dims
    dtype = np.float64 if exact < 1 << 53 else np.int64 if exact < 1 << 63 else object
    kind = "smallint" if size < 1 << 15 else "int" if size < 1 << 31 else "bigint"
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("v").toArrow()
    _, first = np.unique(chosen := matrix(sample.column("v"), dims), axis=0, return_index=True)
    centres = lifted(chosen[np.sort(first)[:pivots]], most.longest)
    cells = staged(with_cells(rows.withColumn("v", F.col("v").cast(f"array<{kind}>")), centres, most.longest, dims), "cells")

    close = F.row_number().over(Window.partitionBy("cell").orderBy("far", "rid"))
    nearest_rows: dict[int, list[float]] = {}
    for r in cells.select("cell", "far", "rid").withColumn("n", close).filter(F.col("n") <= k + 1).select("cell", "far").collect():
        nearest_rows.setdefault(r.cell, []).append(r.far)
    asked = {r.qcell: r for r in cells.filter("query").groupBy("qcell").agg(F.count("*").alias("n"), F.max("qfar").alias("radius")).collect()}
    interval = bounds(centres, nearest_rows, {i: r.radius for i, r in asked.items()}, k)
    groups, parts = grouped_cells(centres, {i: r.n for i, r in asked.items()}, group_queries)
    span: dict[tuple[int, int], list[float]] = {}
    for i, _, g in groups:
        for j in nearest_rows:
            lo, hi = interval[i, j] if dtype is not object else (-np.inf, np.inf)  # clipped scores tie: nothing is ruled out
            old = span.get((j, g), (np.inf, -np.inf))
            span[j, g] = (min(lo, old[0]), max(hi, old[1]))

    n_blocks = max(-(-most.rows // block_rows), min(task_parallelism(spark), -(-most.rows // 4096)))
    places = spark.createDataFrame(groups, "qcell int, part int, g int")
    pieces = spark.createDataFrame(list(parts.items()), "qcell int, parts int")
    queries = (cells.filter("query").select("rid", "vec_id", "v", "qcell").join(pieces, "qcell")
               .withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).join(places, ["qcell", "part"])
               .select("g", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(False).alias("data"), "rid", "vec_id", "v"))
    reach = spark.createDataFrame([(j, g, float(lo), float(hi)) for (j, g), (lo, hi) in span.items()], "cell int, g int, lo double, hi double")
    data = (cells.join(reach, "cell").filter((F.col("far") >= F.col("lo")) & (F.col("far") <= F.col("hi")))
            .select("g", F.pmod(F.xxhash64("rid", "g"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(True).alias("data"), "rid", "vec_id", "v"))
    dealt = queries.unionByName(data).repartition("g", "block").sortWithinPartitions("g", "block", "data")
    best = dealt.mapInArrow(solve(dims, dtype, k), "rid bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for the rows of :func:`top_k` with the queries ``vec_id % every = 0``."""
    return f"""WITH v AS (SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(CAST(e AS DOUBLE) * 256) AS DOUBLE) FOR e IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.rid <> d.rid WHERE q.vec_id % {every} = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
