"""The tables of a graph, as Spark schemas. JSON properties are strings; what operators read of them has columns."""

from __future__ import annotations

#: Document states, in the order in which a job passes them; `failed` may follow any.
STATES = ("pending", "chunking", "extracting", "resolving", "building_communities", "ready", "failed")
JOB_STATES = ("pending", "running", "completed", "failed")
#: Types and kinds that operators treat in their own way.
SCAFFOLD = ("document", "community")
MENTIONS = "mentions"
DOCUMENT_CHUNK, ENTITY_DESCRIPTION, COMMUNITY_SUMMARY = "document_chunk", "entity_description", "community_summary"

_STAMPS = "created_at timestamp, updated_at timestamp"
NODES = f"id string, type string, name string, description string, aliases array<string>, normalized_name string, props string, {_STAMPS}"
EDGES = "id string, src string, dst string, type string, chunk_id string, description string, props string, created_at timestamp"
CHUNKS = f"id string, node_id string, kind string, ord int, text string, embedding array<float>, props string, {_STAMPS}"
DOCUMENTS = f"id string, title string, text string, source_uri string, status string, node_id string, error string, props string, {_STAMPS}"
JOBS = f"id string, document_id string, stage string, status string, chunks bigint, extractions bigint, entities bigint, mentions bigint, relationships bigint, description_chunks bigint, communities bigint, error string, {_STAMPS}"
COMMUNITIES = f"id string, label string, summary string, node_id string, member_count int, props string, {_STAMPS}"
MEMBERS = "community_id string, node_id string"

TABLES = {"nodes": NODES, "edges": EDGES, "chunks": CHUNKS, "documents": DOCUMENTS, "jobs": JOBS, "communities": COMMUNITIES, "members": MEMBERS}
