"""Runs of characters by hash, and a sieve of fixed size that tells what a table does not hold before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.plans.ship import ship

#: Lengths of the runs that names are looked up by: a name by the longest that fits in it, none below the first.
LENGTHS = (3, 6, 12, 24)
#: A sieve has 2 ** SIEVE_BITS slots of a bit each, 16 MB.
SIEVE_BITS = 27
#: Characters that are hashed at once, but for longer texts.
STEP = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of LENGTHS: it, the hashes of all runs of so many characters, and the numbers of their texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    had = 1
    for n in LENGTHS:
        size = len(h) - (n - had)
        if size <= 0:
            return
        h = _mix(sum(h[j * had : j * had + size] * _FACTORS[j] for j in range(n // had)))
        had = n
        at = np.flatnonzero(left[:size] >= n)
        yield n, h[at], row[at]


def _shares(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about STEP characters."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > STEP:
            yield start, i
            start, total = i, 0
        total += len(t)
    if texts:
        yield start, len(texts)


def sieve(rows: DataFrame, column: str):
    """A broadcast array of bits with one for each hash (a long) in a column: at most 2 ** (SIEVE_BITS - 6) words reach the driver."""
    slot = F.shiftrightunsigned(F.col(column), 64 - SIEVE_BITS)
    words = rows.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a sieve may hold."""
    slot = h >> np.uint64(64 - SIEVE_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def sifted(rows: DataFrame, column: str, sieve) -> DataFrame:
    """rows but those whose hash (a long) a sieve does not hold."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(sieve.value, batch.column(column).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def runs(rows: DataFrame, key: str, text: str, longest: bool = False, sieve=None) -> DataFrame:
    """(key, run) for the texts of rows: a hash of each of their runs, or of those of the longest length that fits, once a
    row. With a sieve, only what it may hold leaves the task."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _shares(texts):
                some = texts[lo:hi]
                size = np.array([len(t) for t in some])
                found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for n, h, row in hashes(some):
                    if longest:
                        at = (size[row] < 2 * n) | (n == LENGTHS[-1])
                        h, row = h[at], row[at]
                    if sieve is not None:
                        at = held(sieve.value, h)
                        h, row = h[at], row[at]
                    found.append(h)
                    places.append(row)
                h, row = np.concatenate(found), np.concatenate(places)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first] + lo)), pa.array(h[first].view(np.int64))], names=[key, "run"])

    return rows.select(key, text).mapInArrow(run, T.StructType([rows.schema[key], T.StructField("run", T.LongType())]))
