"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.plans.written import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).collect()[0]
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another: the smallest id that it reaches.

    Alternates large stars (each node's larger neighbours go to its smallest one)
    and small stars (its smaller neighbours do) until nothing changes, which takes
    a number of rounds in the order of the logarithm of the node count, whatever
    the diameter. Minima are combined before each shuffle, and adaptive execution splits
    the partitions of a node with very many edges where they are joined with its minimum.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = materialize(e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "components")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "components")
        discard(e)
        e, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # stars now: every node has one edge, to its component's smallest id
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
