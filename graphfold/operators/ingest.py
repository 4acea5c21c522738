"""Ingest: documents to chunks, extractions, entities and edges of a stored graph, one durable write a stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.functions.text import strip
from graphfold.operators import extraction, resolution
from graphfold.operators.chunking import chunk_documents
from graphfold.operators.retrieval import Graph
from graphfold.operators.tables import reembed_queue
from graphfold.plans.schemas import DOCUMENT_CHUNK, MENTIONS, SCAFFOLD
from graphfold.sources.clients import EmbeddingClient, LanguageClient, with_completions, with_embeddings

EXTRACT_SYSTEM = 'List the entities and their relationships in the text. Reply with one JSON object: {"entities": [{"name", "type", "description"}], "relationships": [{"source", "target", "type", "description"}]}.'


def document_nodes(docs: DataFrame) -> DataFrame:
    """docs (id, title, text, …) with a stripped title and the id of their node."""
    return docs.withColumns({"title": strip(F.col("title")), "node_id": resolution.stable_id(F.lit("document"), F.col("id"))})


def chunk(docs: DataFrame, config: EngineConfig) -> DataFrame:
    pieces = chunk_documents(docs, "node_id", "text", config.chunk_size, config.chunk_overlap)
    return pieces.select(resolution.stable_id(F.col("node_id"), F.col("ord").cast("string")).alias("id"), "node_id", F.lit(DOCUMENT_CHUNK).alias("kind"), "ord", "char_start", "char_end", "text")


def extract(chunks: DataFrame, client: LanguageClient, config: EngineConfig, strict: bool = True) -> DataFrame:
    """chunks with status, entities and relationships; with strict a bad reply fails the job."""
    asked = with_completions(chunks.withColumn("prompt", F.col("text")), client, config, EXTRACT_SYSTEM, concurrency=config.extraction_concurrency)
    if strict:
        asked = asked.withColumn("reply", F.when(F.col("reply_error").isNotNull(), F.raise_error("reply_error").cast("string")).otherwise(F.col("reply")))
    return extraction.parse(asked, "reply", strict)


def mentions(extracted: DataFrame) -> DataFrame:
    """A row for each extracted entity, with its place."""
    return extracted.select(F.col("node_id").alias("doc_id"), F.col("node_id").alias("document_node_id"), F.col("id").alias("chunk_id"), "ord", F.posexplode("entities").alias("item", "e")).select("doc_id", "document_node_id", "chunk_id", "ord", "item", "e.*")


def relations(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("node_id").alias("doc_id"), "ord", F.posexplode("relationships").alias("item", "r")).select("doc_id", "ord", "item", "r.*")


def totals(extracted: DataFrame, mention_edges: DataFrame, relation_edges: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row of progress. Entities are summed over chunks, so that one in two chunks counts twice; the others count new rows."""
    key = F.concat_ws("\x1f", F.col("e.type"), F.lower("e.name"))
    per_chunk = extracted.select("id", F.explode("entities").alias("e")).groupBy("id").agg(F.count_distinct(key).alias("n"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = per_chunk.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entities"))
    for df, name in ((mention_edges, "mentions"), (relation_edges, "relationships"), (descriptions, "description_chunks")):
        out = out.join(F.broadcast(one(df, name)), how="cross")  # one row each
    return out


def by_document(docs: DataFrame, chunks: DataFrame, extracted: DataFrame, created: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(node_id, …) with each document's own progress. created are new edges with the first document (doc_id) that gave
    them, descriptions new chunks with the first that described their entity (described_by); a document counts them as if
    documents had come one after another."""
    key = F.concat_ws("\x1f", F.col("e.type"), F.lower("e.name"))
    per_chunk = extracted.select("node_id", "id", F.explode("entities").alias("e")).groupBy("node_id", "id").agg(F.count_distinct(key).alias("n"))
    mention = F.col("type") == MENTIONS
    counts = {
        "chunks": chunks.groupBy("node_id").agg(F.count("*").alias("n")),
        "extractions": extracted.groupBy("node_id").agg(F.count("*").alias("n")),
        "entities": per_chunk.groupBy("node_id").agg(F.sum("n").alias("n")),
        "mentions": created.where(mention).groupBy(F.col("doc_id").alias("node_id")).agg(F.count("*").alias("n")),
        "relationships": created.where(~mention).groupBy(F.col("doc_id").alias("node_id")).agg(F.count("*").alias("n")),
        "description_chunks": descriptions.groupBy(F.col("described_by").alias("node_id")).agg(F.count("*").alias("n")),
    }
    long = [df.select("node_id", F.lit(name).alias("what"), "n") for name, df in counts.items()]
    rows = long[0]
    for df in long[1:]:
        rows = rows.unionByName(df)
    wide = rows.groupBy("node_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in counts))
    return docs.select("node_id").distinct().join(wide, "node_id", "left").fillna(0)


def unmentioned(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """For a reindex: edges without the mentions of the documents' nodes (node_id); entities and other edges stay."""
    gone = docs.select(F.col("node_id").alias("__gone")).distinct()
    return edges.join(gone, (edges["src"] == gone["__gone"]) & (edges["type"] == MENTIONS), "left_anti")


def new_rows(docs: DataFrame, documents: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending rows of documents and of jobs for docs (id, title, text, maybe source_uri). A known document is pending
    again; each call adds a job to it."""
    docs = document_nodes(docs).dropDuplicates(["id"])
    of = jobs.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    runs = of.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("runs"))
    job = docs.select("id").join(runs, "id", "left")
    job = job.select(resolution.stable_id(F.lit("job"), F.col("id"), F.coalesce("runs", F.lit(0)).cast("string")).alias("id"), F.col("id").alias("document_id"), F.lit("pending").alias("stage"), F.lit("pending").alias("status"))
    return docs.drop("node_id").withColumns({"status": F.lit("pending")}), job


def stamped(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with the values of rows (id, …) in the rows of these ids, nulls too; updated_at follows."""
    values = [c for c in rows.columns if c != "id"]
    hit = table.join(rows.select("id", *(F.col(c).alias(f"__{c}") for c in values), F.lit(True).alias("__hit")), "id", "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}").cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in values}
    return hit.withColumns(new | {"updated_at": F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_at"))}).select(*table.columns)


def upserted(table: DataFrame, rows: DataFrame, cleared: Sequence[str] = ()) -> DataFrame:
    """table with rows by id: new ones are added; of known ones, columns of rows that are not null replace the table's, and
    those of `cleared` become null."""
    named = [c for c in rows.columns if c != "id" and c in table.columns]
    both = table.join(rows.select("id", *(F.col(c).cast(table.schema[c].dataType).alias(f"__{c}") for c in named), F.lit(True).alias("__new")), "id", "full_outer")
    stamps = {c: F.when(F.col("__new") & (F.col(c).isNull() if c == "created_at" else F.lit(True)), F.current_timestamp()).otherwise(F.col(c)) for c in ("created_at", "updated_at") if c in table.columns}
    empty = {c: F.when(F.col("__new").isNull(), F.col(c)) for c in cleared}
    return both.withColumns({c: F.coalesce(f"__{c}", c) for c in named} | stamps | empty).select(*table.columns)


#: What a job says of its document's progress.
PROGRESS = ("chunks", "extractions", "entities", "mentions", "relationships", "description_chunks")


@dataclass
class Changes:
    """What a run adds to a graph: rows of nodes, edges and chunks to insert or update; the documents (id, node_id) that
    got through with their progress, and those that did not (id, node_id, stage, error, chunks)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    done: DataFrame
    failed: DataFrame


@dataclass
class Ingested:
    """The whole graph after a run, the run's totals, and the documents that failed (id, error)."""

    graph: Graph
    progress: dict
    failed: DataFrame


def _near(table: DataFrame, column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda nodes: table.join(nodes.select(F.col("node").alias("__node")).distinct(), table[column] == F.col("__node"), "left_semi")


def run(
    docs: DataFrame, stored: Graph, embedder: EmbeddingClient, model: LanguageClient, config: EngineConfig, write: Callable[[DataFrame, str], DataFrame],
    on_stage: Callable[[str], None] = lambda stage: None, edges_of: Callable[[DataFrame], DataFrame] | None = None, chunks_of: Callable[[DataFrame], DataFrame] | None = None,
) -> Changes:
    """What documents (id, title, text) add to a stored graph. write(df, name) makes a stage's table durable and returns
    it; on_stage hears each state; edges_of and chunks_of read the stored rows of some nodes (node).

    Entities that the graph holds keep their ids and names and take up aliases and descriptions; edges are merged with
    those of the same ends and type; only descriptions that are new or changed are embedded. A document of which a chunk
    cannot be embedded, or has no readable extraction, fails alone: its error travels with its rows, and nothing of it
    reaches the graph.
    """
    edges_of, chunks_of = edges_of or _near(stored.edges, "src"), chunks_of or _near(stored.chunks, "node_id")
    on_stage("chunking")
    docs = document_nodes(docs).dropDuplicates(["id"])
    chunks = write(with_embeddings(chunk(docs, config), embedder, config, strict=False), "chunks")
    lost = chunks.where(F.col("embedding_error").isNotNull())
    on_stage("extracting")
    asked = chunks.join(lost.select("node_id").distinct(), "node_id", "left_anti").drop("embedding", "embedding_error")
    extracted = write(extract(asked, model, config, strict=False), "extracted")
    bad = extracted.where(F.col("reply_error").isNotNull() | (F.col("status") != "ok"))
    why = F.coalesce("reply_error", F.concat(F.lit("extraction reply is "), "status"))
    errors = lost.select("node_id", "ord", F.lit("chunking").alias("stage"), F.col("embedding_error").alias("error")).unionByName(bad.select("node_id", "ord", F.lit("extracting").alias("stage"), why.alias("error")))
    failed = write(errors.groupBy("node_id").agg(F.min(F.struct("ord", "stage", "error")).alias("e")).select("node_id", "e.stage", F.substring("e.error", 1, 4000).alias("error")), "failed")
    on_stage("resolving")
    without = lambda df: df.join(failed.select("node_id"), "node_id", "left_anti")
    good_docs, good_chunks, extracted = without(docs), without(chunks), without(extracted)
    named = mentions(extracted)
    entities = write(resolution.resolve(named, stored.nodes.where(~F.col("type").isin(*SCAFFOLD))), "entities")
    cites = resolution.mention_edges(named, entities)
    incoming = write(cites.unionByName(resolution.relation_edges(relations(extracted), named, entities)), "incoming")
    known = edges_of(incoming.select(F.col("src").alias("node"))).join(incoming.select("src", "dst", "type"), ["src", "dst", "type"], "left_semi")
    merged = write(resolution.merge_edges(known, incoming), "merged")
    about = write(with_embeddings(resolution.description_chunks(entities, chunks_of(entities.select(F.col("id").alias("node")))), embedder, config), "descriptions")
    progress = by_document(good_docs, good_chunks, extracted, merged.where("created"), about.where(~F.col("stale")))
    nodes = good_docs.select(F.col("node_id").alias("id"), F.lit("document").alias("type"), F.col("title").alias("name")).unionByName(entities.drop("created", "described_by"), allowMissingColumns=True)
    both = good_chunks.drop("char_start", "char_end", "embedding_error").unionByName(about.drop("stale", "described_by"), allowMissingColumns=True)
    made = chunks.groupBy("node_id").agg(F.count("*").alias("chunks"))
    return Changes(
        nodes, merged.drop("created", "doc_id"), both, write(good_docs.select("id", "node_id").join(progress, "node_id"), "done"),
        docs.select("id", "node_id").join(failed, "node_id").join(made, "node_id", "left"),
    )


def reembedded(chunks: DataFrame, embedder: EmbeddingClient, config: EngineConfig, limit: int = 100) -> DataFrame:
    """(id, embedding) of the oldest chunks that lack an embedding."""
    return with_embeddings(reembed_queue(chunks, limit).select("id", "text"), embedder, config).select("id", "embedding")
