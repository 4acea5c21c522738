"""The ingest queue as a stream: new document files are ingested micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphfold.plans.schemas import DOCUMENTS


def documents_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest_stream(docs: DataFrame, checkpoint: str, ingest: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hands each batch to ingest(df, batch_id). A batch may come again after a failure, so ingest writes under the
    batch's number; repeated ids within a batch count once."""

    def each(df: DataFrame, batch: int) -> None:
        df = df.dropDuplicates(["id"]).persist()
        try:
            ingest(df, batch)
        finally:
            df.unpersist()

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
