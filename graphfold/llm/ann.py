"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised with a codebook of
its own. A pair of centroids is a cell. A query walks the cells in the order of
summed squared distance, with a heap over the two sorted lists, until they hold
enough vectors; then all entries of those cells are compared with it exactly.

The codebooks are fitted on the TRAIN_ROWS vectors with the smallest hashes of
their ids; every vector is indexed. How many entries a query's cells must hold is
measured and not set: for PROBES of those vectors the exact neighbours are found
by a scan of all entries, and the walk is long enough to meet TARGET of them.
Clustered vectors need few cells; vectors that are close to uniform on a sphere
need a large share of all. Entries are grouped by their first centroid, and a
group of more than PART entries is dealt to several, so that none grows with the
input.

Edge cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without an id.
Equal distances go to the smaller id. With fewer candidates than asked for, all
are returned. A row is not its own neighbour, but another row of its id is a
candidate like any other. An id that several query rows have is one query, for
the least of their vectors. Extra columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import arrow_rows, materialize, table

TRAIN_ROWS, CENTROIDS, ROUNDS = 20_000, 128, 12
PROBES, TARGET, PART = 128, 0.96, 4_000


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).where(F.coalesce(ok, F.lit(False)))
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (most[0]["n"] if most else 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced rows; an empty cluster takes the row that is farthest from its centroid."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = squared(x, c)
        near = d.argmin(1)
        size = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, x[:, j], k) / np.maximum(size, 1)
        for j in np.flatnonzero(size == 0):
            c[j] = x[d.min(1).argmax()]
    return c


def walk(near: np.ndarray, far: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells by rising near[i] + far[j] until they hold `enough` entries."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, done, got, out = [(near[a[0]] + far[b[0]], 0, 0)], np.zeros(len(a), np.int64), 0, []
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = int(a[i]) * len(far) + int(b[j])
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        # the pair to the right and the one below, each once its other predecessor is done
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (near[a[i]] + far[b[j + 1]], i, j + 1))
        if i + 1 < len(a) and (j == 0 or done[i + 1] == j) and done[i + 1] <= j:
            heapq.heappush(heap, (near[a[i + 1]] + far[b[j]], i + 1, j))
    return out


class MultiIndex:
    """The codebooks, how many entries each cell holds, the table of entries (vec_id, vector, cell), their number, and how
    many entries a query's cells must hold."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, entries: DataFrame, rows: int, enough: int = 0):
        self.books, self.held, self.entries, self.rows, self.enough = books, held, entries, rows, enough

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return squared(v[:, :half], self.books[0]), squared(v[:, half:], self.books[1])


def calibrate(index: MultiIndex, ids: np.ndarray, probes: np.ndarray, k: int, target: float) -> int:
    """How many entries the cells of a walk must hold so that the walks of the probes meet target of their k nearest."""
    shared = index.entries.sparkSession.sparkContext.broadcast((ids, probes))  # PROBES vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, probes = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int32))] * len(ids)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                d, own, cell = squared(probes, matrix(batch.column("vector"))), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                for i, (held, cells) in enumerate(best):
                    other = np.flatnonzero(own != ids[i])
                    held, cells = np.concatenate([held, d[i, other]]), np.concatenate([cells, cell[other]])
                    at = _least(held, k)
                    best[i] = held[at], cells[at]
        for i, (held, cells) in enumerate(best):
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int32()), pa.array(held), pa.array(cells, pa.int32())], names=["probe", "d", "cell"])

    found = arrow_rows(index.entries.select("vec_id", "vector", "cell"), nearest, [("probe", T.IntegerType()), ("d", T.DoubleType()), ("cell", T.IntegerType())])
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("d", "cell"))).where(F.col("r") <= k)
    wanted: dict[int, list[int]] = {}
    for r in found.select("probe", "cell").collect():  # k rows a probe
        wanted.setdefault(r["probe"], []).append(r["cell"])
    needed, (d1, d2) = [], index.distances(probes)
    for i, cells in wanted.items():
        order = np.array(walk(d1[i], d2[i], index.held, index.rows))
        before = dict(zip(order.tolist(), (np.cumsum(index.held[order]) - index.held[order]).tolist(), strict=True))
        needed += [before[c] + 1 for c in cells]
    return int(np.quantile(needed, target, method="higher")) if needed else 0


def build(rows: DataFrame, centroids: int = CENTROIDS, train_rows: int = TRAIN_ROWS, probes: int = PROBES, k: int = 10, target: float = TARGET) -> MultiIndex | None:
    """Indexes every row of (vec_id, vector); None if there is none."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).toArrow()
    if not sample.num_rows:
        return None
    x = matrix(sample.column("vector"))
    half = (x.shape[1] + 1) // 2
    books = codebook(x[:, :half], centroids), codebook(x[:, half:], centroids)
    shared = rows.sparkSession.sparkContext.broadcast(books)  # 2 * centroids rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("vector"))
                cell = squared(v[:, :half], first).argmin(1) * len(second) + squared(v[:, half:], second).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    kinds = [("vec_id", T.LongType()), ("vector", T.ArrayType(T.DoubleType())), ("cell", T.IntegerType())]
    entries = materialize(arrow_rows(rows, assign, kinds), "ann_entries")
    held = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        held[r["cell"]] = r["count"]
    index = MultiIndex(books, held, entries, int(held.sum()))
    index.enough = calibrate(index, sample.column("vec_id").to_numpy()[:probes], x[:probes], k, target)
    return index


def search(index: MultiIndex, queries: DataFrame, k: int = 10, enough: int | None = None) -> DataFrame:
    """The k nearest entries of each query (vec_id, vector) among those of its cells, which hold `enough` entries at
    least (by default as many as were measured), without the query's own row."""
    spark, half, second = queries.sparkSession, index.books[0].shape[1], len(index.books[1])
    parts = np.maximum(1, -(-index.held.reshape(-1, second).sum(axis=1) // PART))
    shared = spark.sparkContext.broadcast((index.books, index.held, parts))
    enough = max(index.enough if enough is None else enough, k + 1)
    group = [("first", T.IntegerType()), ("part", T.IntegerType())]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and first centroid the second centroids of the cells to look into."""
        books, held, parts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("vector"))
            d1, d2 = squared(v[:, :half], books[0]), squared(v[:, half:], books[1])
            for i, query in enumerate(batch.column("vec_id").to_pylist()):
                by_first: dict[int, list[int]] = {}
                for cell in walk(d1[i], d2[i], held, enough):
                    by_first.setdefault(cell // second, []).append(cell % second)
                rows = [(f, p, s) for f, s in by_first.items() for p in range(parts[f])]
                if rows:
                    f, p, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(f), pa.int64()), pa.array([v[i]] * len(f), pa.list_(pa.float64())), pa.array(s, pa.list_(pa.int32())), pa.array(f, pa.int32()), pa.array(p, pa.int32())], names=["query_id", "vector", "seconds", "first", "part"])

    asked = arrow_rows(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), ask, [("query_id", T.LongType()), ("vector", T.ArrayType(T.DoubleType())), ("seconds", T.ArrayType(T.IntegerType())), *group])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value[2]
        for batch in batches:
            ids, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts[cell // second].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cell % second, pa.int32()), pa.array(cell // second, pa.int32()), pa.array(part.astype(np.int32))], names=["vec_id", "vector", "second", "first", "part"])

    entries = arrow_rows(index.entries.select("vec_id", "vector", "cell"), split, [("vec_id", T.LongType()), ("vector", T.ArrayType(T.DoubleType())), ("second", T.IntegerType()), *group])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and held.num_rows:
            q, v = matrix(asked.column("vector")), matrix(held.column("vector"))
            ids, cell = held.column("vec_id").to_numpy(), held.column("second").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v, cell = ids[order], v[order], cell[order]
            for query, x, seconds in zip(asked.column("query_id").to_pylist(), q, asked.column("seconds").to_pylist(), strict=True):
                wanted = np.zeros(second, bool)
                wanted[seconds] = True
                at = np.flatnonzero(wanted[cell])
                d = v[at] - x
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                # equal rows of an id share a cell and a part: one of them is the query itself
                if len(own := np.flatnonzero((ids[at] == query) & (d == 0))):
                    at, d = np.delete(at, own[0]), np.delete(d, own[0])
                best = _least(d, k)
                out.append((np.full(len(best), query), ids[at[best]], d[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = asked.groupBy("first", "part").cogroup(entries.groupBy("first", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest with their ties in order of position."""
    if len(d) <= k:
        return np.argsort(d, kind="stable")
    limit = np.partition(d, k - 1)[k - 1]
    at = np.flatnonzero(d <= limit)
    return at[np.argsort(d[at], kind="stable")][:k]


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.entries.where(F.col("vec_id") % 100 == 0))


def exact_neighbours(spark, sf_dir: str) -> DataFrame:
    """op10_nearest with walks through all cells: the exact neighbours, by the same index and queries."""
    index = build(valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search(index, index.entries.where(F.col("vec_id") % 100 == 0), enough=index.rows)
    return found.withColumn("score", F.round("score", 6))
