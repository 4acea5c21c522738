"""Exact nearest chunks by cosine similarity: one scan, matrix products in Arrow batches, k rows a task and query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.plans.ship import ship

#: Queries that a task multiplies at once, and that one scan serves, block after block; more are served by further scans.
BLOCK, SERVED = 1024, 65_536
#: Products that are held at once.
CELLS = 1 << 21


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without a direction become NaN."""
    n = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(n > 0, n, np.nan)[:, None]


def cosines(column: pa.Array, queries: np.ndarray) -> np.ndarray:
    """Cosine of each vector to each query (unit rows); NaN for a vector of another length, with nulls, or without a direction."""
    out = np.full((len(column), len(queries)), np.nan)
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), queries.shape[1]), False).to_numpy(zero_copy_only=False))
    if len(fits):
        flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[fits] = _unit(flat.reshape(len(fits), -1)) @ queries.T
    return out


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores and of all that equal the last of them; NaN is none."""
    at = np.flatnonzero(~np.isnan(score))
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at


def scores(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    """The columns of chunks but the embedding, with the cosine; rows without a direction go."""
    ship(chunks.sparkSession)
    q = _unit(np.array([query], np.float64))
    kept = [f for f in chunks.schema.fields if f.name not in ("embedding", "score")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = cosines(batch.column("embedding"), q)[:, 0]
            at = pa.array(np.flatnonzero(~np.isnan(score)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), pa.array(score).take(at)], names=[*names, "score"])

    rows = chunks.where(F.col("embedding").isNotNull()).select(*names, "embedding")
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def knn(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k best chunks with their score, of equal scores those with smaller ids."""
    rows = chunks if where is None else chunks.where(where)
    ship(rows.sparkSession)
    q = _unit(np.array([query], np.float64))
    kept = [f for f in rows.schema.fields if f.name not in ("embedding", "score")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            score = cosines(batch.column("embedding"), q)[:, 0]
            at = pa.array(_best(score, k))
            new = pa.table([*(batch.column(n).take(at) for n in names), pa.array(score).take(at)], names=[*names, "score"])
            held = new if held is None else pa.concat_tables([held, new])
            held = held.take(pa.array(_best(held.column("score").to_numpy(), k)))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    found = rows.where(F.col("embedding").isNotNull()).select(*names, "embedding").mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
    return found.orderBy(F.desc("score"), "id").limit(k)


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, query_id, score, rank): the k best chunks for each row of queries (query_id, vector). Up to SERVED of them are
    broadcast and share one scan; each task keeps k rows a query, and ties, before anything is shuffled."""
    spark = ship(chunks.sparkSession)
    rows = chunks.where(F.col("embedding").isNotNull()).select("id", "embedding")
    of_query = queries.schema["query_id"]
    schema = T.StructType([chunks.schema["id"], of_query, T.StructField("score", T.DoubleType())])
    scans, found = max(1, -(-queries.count() // SERVED)), None

    def nearest(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            step = max(1, CELLS // max(1, min(BLOCK, len(vectors))))
            held: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0), None)] * len(vectors)
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    for first in range(0, len(vectors), BLOCK):
                        score = cosines(batch.column("embedding"), vectors[first : first + BLOCK])
                        for j in range(score.shape[1]):
                            at = _best(score[:, j], k)
                            s, x = held[first + j]
                            new = batch.column("id").take(pa.array(at))
                            s, x = np.concatenate([s, score[at, j]]), new if x is None else pa.concat_arrays([x, new])
                            at = _best(s, k)
                            held[first + j] = s[at], x.take(pa.array(at))
            for j, (s, x) in enumerate(held):
                if len(s):
                    yield pa.RecordBatch.from_arrays([x, ids.take(pa.array([j] * len(s))), pa.array(s)], names=["id", "query_id", "score"])

        return run

    for b in range(scans):
        some = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(scans)) == b)).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        vectors = _unit(np.array(some.column("vector").to_pylist(), np.float64))
        part = rows.mapInArrow(nearest(spark.sparkContext.broadcast((some.column("query_id").chunk(0), vectors))), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
