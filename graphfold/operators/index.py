"""An inverted file over chunk vectors: cells of a coarse quantiser as partitions, of which a search reads a few."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.errors import Invalid
from graphfold.operators.topk import _unit, knn_batch
from graphfold.plans.ship import ship

#: Rows that the quantiser is fitted on, rounds of that, and rows that a cell holds on average where cells are not given.
SAMPLE, ROUNDS, CELL_ROWS, CELLS = 20_000, 10, 500, 4_096


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by k-means on unit rows; an empty cell takes the row that is farthest from its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (score := x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        lost = np.bincount(near, minlength=k) == 0
        total[lost] = x[score.max(1).argsort()[: lost.sum()]]
        c = np.nan_to_num(_unit(total))
    return c


@dataclass
class VectorIndex:
    """Unit centroids, the rows of each cell, the folder of the entries (id, node_id, kind, embedding, cell), the time since
    when chunks are not in it, and how many cells a search reads if it is not told."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    held: np.ndarray
    since: str
    breadth: int

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, breadth: int = 64, sample: int = SAMPLE) -> VectorIndex:
        """Indexes every chunk with a direction. The quantiser is fitted on the `sample` rows with the smallest hashes of
        their ids; vectors of another length than most of those are left out, as they match no query."""
        spark = ship(chunks.sparkSession)
        rows = chunks.where(F.col("embedding").isNotNull()).select("id", "node_id", "kind", "embedding")
        since = spark.sql("SELECT CAST(current_timestamp() AS STRING) AS t").first()["t"]
        some = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").select("embedding").limit(sample).collect()]
        some = [v for v in some if None not in v and any(v)]
        if not some:
            raise Invalid("no chunk has an embedding")
        sizes = [len(v) for v in some]
        dim = max(set(sizes), key=sizes.count)
        x = _unit(np.array([v for v in some if len(v) == dim], np.float64))
        k = min(cells or max(1, min(CELLS, rows.count() // CELL_ROWS)), len(x))
        shared = spark.sparkContext.broadcast(_fit(x, k))  # at most CELLS rows

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, near = [], []
                for i, v in enumerate(batch.column("embedding").to_pylist()):
                    if len(v) == shared.value.shape[1] and None not in v and any(v):
                        at.append(i), near.append(int((shared.value @ np.array(v)).argmax()))
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near, pa.int32())], names=[*taken.schema.names, "cell"])

        folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        entries = rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
        entries.hint("rebalance", "cell").write.partitionBy("cell").parquet(folder)
        index = cls(spark, folder, shared.value, np.zeros(k, np.int64), since, breadth)
        for r in index.entries.groupBy("cell").count().collect():  # at most CELLS rows
            index.held[r["cell"]] = r["count"]
        return index

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def cells(self, query: Sequence[float], breadth: int | None = None) -> list[int]:
        """The cells nearest to a query."""
        order = np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")
        return [int(c) for c in order[: breadth or self.breadth]]

    def share(self, query: Sequence[float], breadth: int | None = None) -> float:
        """The share of all entries that a search reads."""
        return float(self.held[self.cells(query, breadth)].sum() / max(1, self.held.sum()))

    def near(self, query: Sequence[float], chunks: DataFrame | None = None, breadth: int | None = None) -> DataFrame:
        """Candidates (id, node_id, kind, embedding): the entries of the nearest cells, of which only the partitions are
        read. With chunks, those that are gone are left out, and those written since the index was built come too."""
        found = self.entries.where(F.col("cell").isin(self.cells(query, breadth))).drop("cell")
        if chunks is None:
            return found
        if "updated_at" not in chunks.columns:
            return found
        late = chunks.where(F.col("updated_at") >= F.lit(self.since).cast("timestamp")).select(*found.columns)
        return found.join(late.select("id"), "id", "left_anti").unionByName(late)

    def calibrate(self, queries: DataFrame, k: int = 10, target: float = 0.95) -> int:
        """Sets the breadth with which a bounded number of queries (query_id, vector) find `target` of their exact k nearest."""
        best = knn_batch(self.entries.select("id", "embedding"), queries, k).join(self.entries.select("id", "cell"), "id").select("query_id", "cell").collect()
        vectors = {r["query_id"]: r["vector"] for r in queries.collect()}
        place = {q: {c: i + 1 for i, c in enumerate(self.cells(v, len(self.centroids)))} for q, v in vectors.items()}
        needed = [place[r["query_id"]][r["cell"]] for r in best]
        self.breadth = int(np.quantile(needed, target, method="higher")) if needed else self.breadth
        return self.breadth
