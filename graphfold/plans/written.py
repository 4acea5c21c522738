"""Tables that cut the lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from graphfold.errors import EngineError

#: With this setting a query's shuffle files go as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where all of Spark runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphfold-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_LOCK, _WRITES = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread writes, and what it was before when the last one has ended."""
    with _LOCK:
        if not _WRITES["n"]:
            _WRITES["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _WRITES["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES["n"] -= 1
            if not _WRITES["n"]:
                spark.conf.set(CLEANUP, _WRITES["before"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: later steps do not recompute it, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphfold/{uuid.uuid4().hex}/{name}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def there(spark: SparkSession, path: str) -> bool:
    """Whether a folder has not been cleared away."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from materialize(), once all that comes of it is written itself."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
