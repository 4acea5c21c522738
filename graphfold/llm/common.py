"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.plans.ship import ship
from graphfold.plans.written import discard, materialize, shared_dir

#: Arrow batches are cut into slices of about this many bytes of text, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20
#: Values that attach() broadcasts at most.
HEAD = 4096

__all__ = ["arrow_rows", "attach", "discard", "materialize", "shared_dir", "slices", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """df.mapInArrow(fn); a worker that has ended a task gives back the memory that Arrow holds for it."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice take about limit bytes; a longer text gets a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def attach(rows: DataFrame, values: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """rows with the columns of values (materialized, one row for each key, no null in a key), null where the key is missing.

    The HEAD values of the largest `size`, the number of their rows, are broadcast and the others meet their rows in a
    merge join, where none has more than one of HEAD + 1 parts of all. Rows that the broadcast has served are spread
    there by the columns of `spread`. Column `size` itself is left out.
    """
    named = [c for c in values.columns if c not in (*keys, size)]
    if values.count() <= HEAD:
        return rows.join(F.broadcast(values.drop(size)), keys, "left")
    head = materialize(values.orderBy(F.desc(size), *keys).limit(HEAD), "attach_head")
    rest = values.join(F.broadcast(head.select(*keys)), keys, "left_anti")
    head = head.select(*keys, F.lit(True).alias("__head"), *(F.col(c).alias(f"__head_{c}") for c in named))
    out = rows.join(F.broadcast(head), keys, "left").withColumn("__spread", F.when(F.col("__head"), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    out = out.join(rest.drop(size).withColumn("__spread", F.lit(0).cast("long")).hint("merge"), [*keys, "__spread"], "left")
    found = [F.when(F.col("__head"), F.col(f"__head_{c}")).otherwise(F.col(c)).alias(c) for c in named]
    return out.select(*rows.columns, *found)
