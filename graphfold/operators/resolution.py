"""Entity resolution and graph upserts, as set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfold.functions.text import normalize_name, normalize_type
from graphfold.plans.schemas import ENTITY_DESCRIPTION, MENTIONS
from graphfold.plans.ship import ship


def stable_id(*parts: Column) -> Column:
    """An id that a recomputed plan gives again."""
    return F.md5(F.concat_ws("\x1f", *parts))


def merge_aliases(ordered: Column) -> Column:
    """Distinct spellings in the order of first use."""
    return F.array_distinct(ordered)


#: Bytes of text from which on a filter of its runs answers most questions for what it does not hold, and its slots.
LONG, SLOTS = 1 << 16, 1 << 24


class Folded:
    """Descriptions joined by line ends; one that the text so far contains is left out. Most of what a long text does not
    contain is told by a filter of its runs of eight bytes, in time of the description; the rest is searched for."""

    def __init__(self) -> None:
        self.text, self.runs = bytearray(), None

    @staticmethod
    def _slots(text: bytes) -> np.ndarray:
        runs = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)
        words = np.ascontiguousarray(runs).view("<u8").ravel()
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOTS

    def add(self, description: str | None) -> None:
        d = (description or "").encode()
        if not d:
            return
        if self.text:
            new = self.runs is not None and len(d) >= 8 and not self.runs[self._slots(d)].all()
            if not new and d in self.text:
                return
            self.text += b"\n"
        before = len(self.text)
        self.text += d
        if self.runs is None and len(self.text) >= LONG:
            self.runs, before = np.zeros(SLOTS, bool), 8
        if self.runs is not None:
            self.runs[self._slots(bytes(self.text[max(0, before - 8) :]))] = True


def fold_descriptions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(…keys, description): each key's descriptions, which come sorted and are not held, only the text that they make."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = None, Folded()
        for batch in batches:
            done: list[tuple] = []
            for *key, d in zip(*(batch.column(c).to_pylist() for c in (*keys, "description")), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, text.text.decode()))
                    now, text = key, Folded()
                text.add(d)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=[*keys, "description"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (*now, text.text.decode())], names=[*keys, "description"])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*(F.col(k).cast("string").alias(k) for k in keys), "description")
    return ordered.mapInArrow(run, ", ".join(f"{k} string" for k in (*keys, "description")))


def resolve(mentions: DataFrame, existing: DataFrame | None = None, describe: bool = True) -> DataFrame:
    """Nodes from mentions (doc_id, ord, item, name, type, description): one for each normalised type and name.

    The first spelling names the node, aliases and descriptions are folded in the
    order (doc_id, ord, item); described_by is the first document with a description. A node of existing (id, type, name,
    normalized_name, aliases, description) with that type and name, or else normalised name, keeps its id and name, and
    its folds come first. Without describe, descriptions are left as they are and those of mentions are not folded.
    """
    key = ["type_key", "name_key"]
    keyed = mentions.withColumns({"type_key": normalize_type(F.col("type")), "name_key": normalize_name(F.col("name")), "description": F.coalesce("description", F.lit(""))}).where(F.col("name_key") != "")
    # equal spellings with equal descriptions count once, at their first place, before anything is ordered
    first = keyed.groupBy(*key, "name", "description").agg(F.min(F.struct("doc_id", "ord", "item")).alias("at"))
    spelt = first.groupBy(*key, "name").agg(F.min("at").alias("at")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("m"))  # distinct spellings
    nodes = spelt.select(*key, F.transform("m", lambda x: x["name"]).alias("names"))
    told = first.where(F.col("description") != "").groupBy(*key, "description").agg(F.min("at").alias("at"))
    described = told.groupBy(*key).agg(F.min("at")["doc_id"].alias("described_by"))
    rows = told.select(*key, F.lit(1).alias("p"), "at", "description")
    fold = lambda rows: fold_descriptions(rows, key, ["p", "at"])
    text = F.coalesce("description", F.lit("")).alias("description")
    if existing is None:
        j = nodes.join(described, key, "left").join(fold(rows), key, "left") if describe else nodes.withColumns({c: F.lit(None).cast("string") for c in ("described_by", "description")})
        return j.select(
            stable_id(F.col("type_key"), F.col("name_key")).alias("id"), F.col("type_key").alias("type"), F.element_at("names", 1).alias("name"),
            text, merge_aliases(F.col("names")).alias("aliases"), F.col("name_key").alias("normalized_name"), F.lit(True).alias("created"), "described_by",
        )
    old = existing.select("id", "type", "name", "normalized_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("description", F.lit("")).alias("description"))
    by_name = old.select(F.col("type").alias("type_key"), F.lower(F.trim("name")).alias("name_key"), F.struct(F.lit(0).alias("p"), "id", "name", "aliases", "description").alias("o"))
    by_key = old.select(F.col("type").alias("type_key"), F.col("normalized_name").alias("name_key"), F.struct(F.lit(1).alias("p"), "id", "name", "aliases", "description").alias("o"))
    found = by_name.unionByName(by_key).join(nodes.select(*key), key, "left_semi").groupBy(*key).agg(F.min("o").alias("o"))
    held = found.select(*key, F.lit(0).alias("p"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.col("o.description").alias("description"))
    if describe:
        j = nodes.join(found, key, "left").join(described, key, "left").join(fold(held.unionByName(rows)), key, "left")
    else:
        j = nodes.join(found, key, "left").withColumns({"described_by": F.lit(None).cast("string"), "description": F.col("o.description")})
    has = F.col("o").isNotNull()
    return j.select(
        F.coalesce("o.id", stable_id(F.col("type_key"), F.col("name_key"))).alias("id"), F.col("type_key").alias("type"), F.coalesce("o.name", F.element_at("names", 1)).alias("name"),
        text, merge_aliases(F.when(has, F.concat("o.aliases", "names")).otherwise(F.col("names"))).alias("aliases"), F.col("name_key").alias("normalized_name"), (~has).alias("created"), "described_by",
    )


def mention_edges(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from document nodes (document_node_id) to the nodes they mention; chunk_id is that of the last mention."""
    keyed = mentions.select("document_node_id", "chunk_id", "ord", "item", normalize_type(F.col("type")).alias("type"), normalize_name(F.col("name")).alias("normalized_name"))
    hit = keyed.join(nodes.select(F.col("id").alias("dst"), "type", "normalized_name"), ["type", "normalized_name"])
    return upsert_edges(hit.select(F.col("document_node_id").alias("src"), F.col("document_node_id").alias("doc_id"), "dst", F.lit(MENTIONS).alias("type"), "chunk_id", F.lit("").alias("description"), F.struct("ord", "item").alias("at")))


def _with_end(relations: DataFrame, named: DataFrame, column: str, end: str) -> DataFrame:
    """relations with the id of the entity of named (doc_id, ord, item, normalized_name, id) that a column names, as `end`;
    those without one go. Mentions and relations of a name in a document are sorted together, so that one shuffle and one
    sort find the first of the chunk and of the document."""
    asked = relations.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = asked.unionByName(named.select("doc_id", "ord", "item", F.col("normalized_name").alias(column), F.col("id").alias("__hit")), allowMissingColumns=True)
    relation = F.col("__hit").isNull()
    first = lambda keys, order: F.first("__hit", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    in_doc, in_chunk = first(["doc_id", column], ["ord", relation, "item"]), first(["doc_id", column, "ord"], [relation, "item"])
    found = rows.withColumn(end, F.coalesce(F.when(F.col("ord").isNotNull(), in_chunk), in_doc))
    return found.where(relation & F.col(end).isNotNull()).drop("__hit", column)


def relation_edges(relations: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges for relations (doc_id, ord, item, source, target, type, description). An end is the first entity of that
    name in the same chunk, or else in the document, whatever its type; open ends and loops go."""
    named = mentions.select("doc_id", "ord", "item", normalize_type(F.col("type")).alias("type"), normalize_name(F.col("name")).alias("normalized_name")).join(nodes.select("id", "type", "normalized_name"), ["type", "normalized_name"])
    named = named.where(F.col("doc_id").isNotNull())
    out = relations.select("doc_id", "ord", "item", normalize_name(F.col("source")).alias("s"), normalize_name(F.col("target")).alias("t"), "type", "description")
    out = _with_end(_with_end(out, named, "s", "src"), named, "t", "dst").where(F.col("src") != F.col("dst"))
    return upsert_edges(out.select("src", "dst", "type", "doc_id", F.lit(None).cast("string").alias("chunk_id"), F.coalesce("description", F.lit("")).alias("description"), F.struct("doc_id", "ord", "item").alias("at")))


def upsert_edges(incoming: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type) of incoming (…, chunk_id, description, at): values that are not empty overwrite,
    the last wins. With a doc_id, the first document of each edge is kept."""
    first = ["doc_id"] if "doc_id" in incoming.columns else []
    last = lambda c: F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at")))
    e = incoming.groupBy("src", "dst", "type").agg(last("chunk_id").alias("chunk_id"), last("description").alias("description"), *(F.min(c).alias(c) for c in first))
    return e.select(stable_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "src", "dst", "type", F.nullif("chunk_id", F.lit("")).alias("chunk_id"), F.nullif("description", F.lit("")).alias("description"), *first)


def merge_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with incoming edges (id, src, dst, type, chunk_id, description): new triples are added, known ones updated."""
    first = ["doc_id"] if "doc_id" in incoming.columns else []
    old = existing.select("id", "src", "dst", "type", "chunk_id", "description")
    both = old.withColumn("p", F.lit(0)).unionByName(incoming.select(*old.columns, *first).withColumn("p", F.lit(1)), allowMissingColumns=True)
    pick = lambda c: F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("p")))
    return both.groupBy("src", "dst", "type").agg(F.min_by("id", "p").alias("id"), pick("chunk_id").alias("chunk_id"), pick("description").alias("description"), (F.min("p") == 1).alias("created"), *(F.min(c).alias(c) for c in first))


def description_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The entity_description chunks to write: for nodes with a description and no such chunk, or one with another text
    (stale says which; only those and new ones are embedded again)."""
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("id"))
    old = chunks.where(F.col("kind") == ENTITY_DESCRIPTION).withColumn("r", rank).where(F.col("r") == 1).select("node_id", F.col("id").alias("old_id"), F.col("text").alias("old_text"))
    n = nodes.where(F.trim(F.coalesce("description", F.lit(""))) != "").select(F.col("id").alias("node_id"), F.trim("description").alias("text"), *(["described_by"] if "described_by" in nodes.columns else []))
    j = n.join(old, "node_id", "left").where(F.col("old_text").isNull() | (F.col("old_text") != F.col("text")))
    return j.select(F.coalesce("old_id", stable_id(F.col("node_id"), F.lit(ENTITY_DESCRIPTION))).alias("id"), "node_id", F.lit(ENTITY_DESCRIPTION).alias("kind"), "text", F.col("old_id").isNotNull().alias("stale"), *(c for c in n.columns if c == "described_by"))
