"""Communities: connected components of the entity graph, with labels, prompts and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.operators.components import connected_components
from graphfold.operators.resolution import stable_id
from graphfold.plans.schemas import COMMUNITY_SUMMARY, MENTIONS, SCAFFOLD
from graphfold.plans.written import materialize

SUMMARY_SYSTEM = "Describe in a few sentences what connects these entities and which facts stand out. Use only what is given."
#: How many members, descriptions and relationships a prompt shows, and how long a description.
MEMBERS, DESCRIPTIONS, RELATIONS, DESCRIPTION_CHARS = 40, 20, 40, 240


def entity_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between entities, other than mentions."""
    entities = nodes.where(~F.col("type").isin(*SCAFFOLD)).select(F.col("id").alias("__e"))
    e = edges.where(F.col("type") != MENTIONS)
    return e.join(entities, e["src"] == entities["__e"], "left_semi").join(entities, e["dst"] == entities["__e"], "left_semi")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; edges to unknown nodes do not count, and a node without edges is its own component."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = connected_components(known)
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def sizes(membership: DataFrame, min_size: int = 1) -> DataFrame:
    """(component, member_count, label): numbered by falling size, then by smallest id. Ranges are numbered each by
    itself, and then moved on by what the ranges before them hold."""
    n = membership.groupBy("component").agg(F.count("*").alias("member_count")).where(F.col("member_count") >= min_size)
    order = [F.desc("member_count"), F.asc("component")]
    ranges = materialize(n.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "communities")
    before, held = [F.lit(0)], 0
    for r in ranges.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        before.insert(0, F.when(F.col("__range") == r["__range"], held))
        held += r["count"]
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.coalesce(*before)
    return ranges.select("component", "member_count", F.concat(F.lit("community_"), number.cast("string")).alias("label"))


def prompts(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, prompt): the first members with descriptions and the first relationships of each component."""
    m = membership.join(nodes.select("id", "name", "type", F.coalesce(F.col("description") if "description" in nodes.columns else F.lit(None).cast("string"), F.lit("")).alias("description")), "id")
    place = F.row_number().over(Window.partitionBy("component").orderBy("name", "id"))
    top = m.withColumn("r", place).where(F.col("r") <= MEMBERS)
    described = F.when((F.col("r") <= DESCRIPTIONS) & (F.trim("description") != ""), F.concat(F.lit("  about "), "name", F.lit(": "), F.substring(F.trim("description"), 1, DESCRIPTION_CHARS)))
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")"))
    members = top.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line"), described.alias("about")))).alias("m"))
    ends = m.select("id", "name", "component")
    e = edges.join(ends.select(F.col("id").alias("src"), F.col("name").alias("s"), "component"), "src").join(ends.select(F.col("id").alias("dst"), F.col("name").alias("d")), "dst")
    first = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    e = e.withColumn("r", first).where(F.col("r") <= RELATIONS).withColumn("rel", F.concat(F.lit("- "), "s", F.lit(" -["), "type", F.lit("]-> "), "d"))
    relations = e.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", "rel"))).alias("rels"))
    text = F.concat(
        F.lit("Entities:\n"),
        F.array_join(F.concat(F.transform("m", lambda x: x["line"]), F.filter(F.transform("m", lambda x: x["about"]), lambda x: x.isNotNull())), "\n"),
        F.lit("\n\nRelationships:\n"),
        F.coalesce(F.array_join(F.transform("rels", lambda x: x["rel"]), "\n"), F.lit("(none)")),
    )
    return members.join(relations, "component", "left").select("component", text.alias("prompt"))


@dataclass
class Communities:
    communities: DataFrame
    members: DataFrame
    nodes: DataFrame
    chunks: DataFrame


def rebuild(nodes: DataFrame, edges: DataFrame, config: EngineConfig, summarise, embed) -> Communities:
    """All communities anew: components of entities with at least the least size, each with a node and a summary chunk.

    summarise adds `reply` to rows with a prompt, embed adds `embedding` to rows with a text.
    """
    entities = nodes.where(~F.col("type").isin(*SCAFFOLD))
    inner = entity_edges(nodes, edges)
    membership = components(entities, inner)
    kept = sizes(membership, config.community_min_size)
    of_kept = membership.join(kept.select("component"), "component", "left_semi")
    # written once: what follows refers to the replies often, and a model is asked once
    c = materialize(summarise(kept.join(prompts(of_kept, entities, inner), "component")).withColumn("summary", F.trim("reply")), "summaries")
    c = c.withColumns({"id": stable_id(F.lit("community"), F.col("component")), "node_id": stable_id(F.lit("community node"), F.col("component"))})
    new_nodes = c.select(F.col("node_id").alias("id"), F.lit("community").alias("type"), F.col("label").alias("name"), "member_count")
    chunks = materialize(embed(c.where(F.coalesce("summary", F.lit("")) != "").select(stable_id(F.lit("community chunk"), F.col("component")).alias("id"), "node_id", F.lit(COMMUNITY_SUMMARY).alias("kind"), F.col("summary").alias("text"))), "summary_chunks")
    members = of_kept.join(c.select("component", F.col("id").alias("community_id")), "component").select("community_id", F.col("id").alias("node_id"))
    return Communities(c.select("id", "label", "summary", "node_id", F.col("member_count").cast("int").alias("member_count")), members, new_nodes, chunks)


def clear(communities: DataFrame, nodes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and chunks without those of communities; community nodes that were made by hand stay."""
    gone = communities.where(F.col("node_id").isNotNull()).select("node_id").distinct()
    return nodes.join(gone, nodes["id"] == gone["node_id"], "left_anti"), chunks.join(gone, "node_id", "left_anti")


def members_of(community_id: str, members: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(members.where(F.col("community_id") == community_id), nodes["id"] == members["node_id"], "left_semi").orderBy("name", "id")
