"""Property-graph operators over edge tables (id, src, dst, type)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.errors import Invalid
from graphfold.plans.written import discard, materialize

DIRECTIONS = ("out", "in", "both")


def other_endpoint(node: Column, src: str = "src", dst: str = "dst") -> Column:
    """The end of an edge that is not the node; null if neither is."""
    return F.when(F.col(src) == node, F.col(dst)).when(F.col(dst) == node, F.col(src))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour) in both directions; parallel edges repeat."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src"))


@dataclass
class Adjacency:
    """Edges that are kept by both ends: `out` and `into` read those whose source or target is among nodes (node), so that a
    hop does not scan the others; `table` has all of them."""

    table: DataFrame
    out: Callable[[DataFrame], DataFrame]
    into: Callable[[DataFrame], DataFrame]

    @property
    def columns(self) -> list[str]:
        return self.table.columns


def edge_filter(edges: DataFrame | Adjacency, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame | Adjacency:
    """Edge types to keep or to leave out; an empty list filters nothing."""
    if isinstance(edges, Adjacency):
        keep = lambda df: edge_filter(df, include, exclude)
        return Adjacency(keep(edges.table), lambda nodes: keep(edges.out(nodes)), lambda nodes: keep(edges.into(nodes)))
    if include:
        edges = edges.where(F.col("type").isin(*include))
    return edges.where(~F.col("type").isin(*exclude)) if exclude else edges


def incident(edges: DataFrame | Adjacency, frontier: DataFrame, direction: str = "both") -> DataFrame:
    """Edges that leave (`out`), enter (`in`) or touch the frontier (node): what an adjacency holds of it, or one scan of a
    table."""
    if direction not in DIRECTIONS:
        raise Invalid(f"direction is one of {DIRECTIONS}")
    f = frontier.select(F.col("node").alias("__node")).distinct()
    if isinstance(edges, Adjacency):
        if direction != "both":
            return (edges.out if direction == "out" else edges.into)(frontier)
        # an edge with both ends in the frontier comes once, by its source
        into = edges.into(frontier)
        return edges.out(frontier).unionByName(into.join(f, into["src"] == f["__node"], "left_anti"))
    if direction != "both":
        return edges.join(f, edges["src" if direction == "out" else "dst"] == f["__node"], "left_semi")
    # both ends are looked up in turn: no join on OR, and no edge comes twice
    end = lambda c: f.select(F.col("__node").alias(c))
    found = edges.join(end("__s"), F.col("src") == F.col("__s"), "left").join(end("__d"), F.col("dst") == F.col("__d"), "left")
    return found.where(F.col("__s").isNotNull() | F.col("__d").isNotNull()).select(*edges.columns)


def step(touched: DataFrame, visited: DataFrame, direction: str = "both") -> DataFrame:
    """The nodes at the other ends of touched edges that are not visited."""
    if direction == "out":
        ends = touched.select(F.col("dst").alias("node"))
    elif direction == "in":
        ends = touched.select(F.col("src").alias("node"))
    else:
        ends = touched.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.distinct().join(visited.select("node"), "node", "left_anti")


@dataclass
class Expansion:
    """Nodes with the hop at which they were met (seeds: 0), and the edges that were walked."""

    nodes: DataFrame
    edges: DataFrame


#: A frontier of up to so many rows becomes a local table, which joins by broadcast; a larger one is written.
SMALL = 10_000


def held(df: DataFrame, rows: pa.Table) -> DataFrame:
    """Few rows of df as a local table. Its size is known, so that larger tables which meet it are not shuffled."""
    return df.sparkSession.createDataFrame(rows, df.schema)


def settle(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df computed once: as a local table if it is small, which is checked, else as a table in the shared folder. What the
    check has computed is kept for the write."""
    df.persist()
    try:
        rows = df.limit(small + 1).toArrow()
        return held(df, rows) if rows.num_rows <= small else materialize(df, "settled")
    finally:
        df.unpersist()


def expand(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, direction: str = "both") -> Expansion:
    """Breadth first from seeds (node). Each hop settles the edges that it walks; the next frontier is their other ends."""
    frontier = settle(seeds.select("node").distinct())
    nodes, walked = frontier.select("node", F.lit(0).alias("hop")), (edges.table if isinstance(edges, Adjacency) else edges).limit(0)
    for hop in range(1, hops + 1):
        touched = settle(incident(edges, frontier, direction))
        walked = touched if hop == 1 else walked.unionByName(touched)
        frontier = settle(step(touched, nodes, direction))
        nodes = nodes.unionByName(frontier.select("node", F.lit(hop).alias("hop")))
    return Expansion(nodes, walked.dropDuplicates(["id"]) if hops > 1 else walked)


def expand_many(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(query, node, hop) for seeds (query, node) of many queries: one pass over the edges a hop serves all of them. A node
    has a row for each query that reaches it, with the least hop."""
    pairs = adjacency(edges)
    known = materialize(seeds.select("query", "node").distinct().withColumn("hop", F.lit(0)), "walks")
    for hop in range(1, hops + 1):
        edge_of = known.where(F.col("hop") == hop - 1).join(pairs, "node").select("query", F.col("neighbour").alias("node")).distinct()
        fresh = edge_of.join(known.select("query", "node"), ["query", "node"], "left_anti").withColumn("hop", F.lit(hop))
        after = materialize(known.unionByName(fresh), "walks")
        discard(known)
        known = after
    return known


def bfs(edges: DataFrame | Adjacency, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(node, hop): the least number of edges from a seed, up to max_hops."""
    return expand(edges, seeds, max_hops).nodes


def neighbors(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: str, direction: str = "both", edge_type: str | None = None, depth: int = 1) -> Expansion:
    """A node's surroundings to a depth of 0 to 5. Edges between nodes of the last level are not walked. Unknown nodes have none."""
    if not 0 <= depth <= 5:
        raise Invalid("depth lies in 0..5")
    seed = nodes.where(F.col("id") == node_id).select(F.col("id").alias("node"))
    found = expand(edge_filter(edges, [edge_type] if edge_type else None), seed, depth, direction)
    return Expansion(nodes.join(found.nodes.withColumnRenamed("node", "id"), "id"), found.edges)
