"""Inserts, updates, deletes, filters and pages of the graph's tables. Each returns a new table; a writer makes it a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.errors import Conflict, Invalid, NotFound
from graphfold.functions.text import contains_props, strip
from graphfold.operators.resolution import stable_id


def get(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("id") == key).limit(1)


def page(table: DataFrame, *order: Column, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """Sorted rows from offset on; id breaks ties."""
    if not 1 <= limit <= most or offset < 0:
        raise Invalid(f"limit lies in 1..{most} and offset is not negative")
    return table.orderBy(*order, "id").offset(offset).limit(limit)


def list_nodes(nodes: DataFrame, type: str | None = None, q: str | None = None, props: dict | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; q matches anywhere in the name, without regard to case, and may hold % and _ as wildcards; props must
    hold the given members."""
    if type:
        nodes = nodes.where(F.col("type") == type)
    if props:
        nodes = nodes.where(contains_props(F.col("props"), props))
    if q:
        nodes = nodes.where(F.col("name").ilike(f"%{q}%"))
    return page(nodes, F.desc("created_at"), limit=limit, offset=offset)


def list_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    for name, value in (("src", src), ("dst", dst), ("type", type)):
        if value:
            edges = edges.where(F.col(name) == value)
    return page(edges, F.desc("created_at"), limit=limit, offset=offset)


def list_chunks(chunks: DataFrame, node_id: str | None = None, limit: int = 100, offset: int = 0, include_embedding: bool = False) -> DataFrame:
    chunks = chunks.where(F.col("node_id") == node_id) if node_id else chunks
    return page(chunks if include_embedding else chunks.drop("embedding"), F.desc("created_at"), limit=limit, offset=offset)


def list_documents(documents: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(documents, F.desc("created_at"), limit=limit, offset=offset)


def list_communities(communities: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(communities, F.desc("member_count"), F.desc("created_at"), limit=limit, offset=offset)


def reembed_queue(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest chunks without an embedding."""
    return page(chunks.where(F.col("embedding").isNull()), F.asc("created_at"), limit=limit, most=limit)


def document_counts(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each document (id, node_id) with its numbers of chunks and mentions: two aggregates, joined once."""
    c = chunks.groupBy("node_id").agg(F.count("*").alias("chunk_count"))
    m = edges.where(F.col("type") == "mentions").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("mention_count"))
    return documents.join(c, "node_id", "left").join(m, "node_id", "left").fillna(0, ["chunk_count", "mention_count"])


def _raise_if(rows: DataFrame, error: type[Exception], what: str) -> None:
    bad = rows.limit(5).collect()
    if bad:
        raise error(f"{what}: " + ", ".join(str(r[0]) for r in bad))


def aligned(table: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the columns of table; stamps that they lack are now."""
    now = {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    return rows.select(*(F.col(c).cast(t) if c in rows.columns else now.get(c, F.lit(None)).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in table.schema.fields)))


def node_rows(rows: DataFrame) -> DataFrame:
    """rows with stripped types and names, and ids."""
    rows = rows.withColumns({"type": strip(F.col("type")), "name": strip(F.col("name"))})
    return rows if "id" in rows.columns else rows.withColumn("id", stable_id(F.col("type"), F.col("name")))


def insert_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    rows = node_rows(rows)
    _raise_if(rows.where((F.col("type") == "") | (F.col("name") == "") | F.col("type").isNull() | F.col("name").isNull()).select("id"), Invalid, "nodes need a type and a name")
    _raise_if(rows.select("id").join(nodes.select("id"), "id", "left_semi"), Conflict, "nodes exist")
    _raise_if(rows.groupBy("id").count().where("count > 1").select("id"), Conflict, "nodes are given twice")
    return nodes.unionByName(aligned(nodes, rows))


def edge_rows(rows: DataFrame) -> DataFrame:
    return rows if "id" in rows.columns else rows.withColumn("id", stable_id(F.col("src"), F.col("type"), F.col("dst")))


def insert_edges(nodes: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Loops are invalid, both ends must exist, and a triple may exist once."""
    rows = edge_rows(rows)
    _raise_if(rows.where((F.col("src") == F.col("dst")) | (strip(F.col("type")) == "")).select("id"), Invalid, "an edge needs a type and two different ends")
    ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    _raise_if(ends.join(nodes.select("id"), "id", "left_anti"), NotFound, "no such nodes")
    triple = ["src", "dst", "type"]
    _raise_if(rows.join(edges.select(*triple), triple, "left_semi").select("id"), Conflict, "edges exist")
    _raise_if(rows.groupBy(*triple).count().where("count > 1").select(F.concat_ws("|", *triple)), Conflict, "edges are given twice")
    return edges.unionByName(aligned(edges, rows))


def checked_chunks(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with ids; a blank text or one unknown node fails the whole batch."""
    if "id" not in rows.columns:
        rows = rows.withColumn("id", stable_id(F.col("node_id"), F.col("text")))
    _raise_if(rows.where(strip(F.coalesce("text", F.lit(""))) == "").select("id"), Invalid, "chunks need a text")
    _raise_if(rows.select(F.col("node_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti"), NotFound, "no such nodes")
    return rows


def insert_chunks(nodes: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    return chunks.unionByName(aligned(chunks, checked_chunks(nodes, rows)))


def check_known(table: DataFrame, patch: DataFrame) -> None:
    _raise_if(patch.select("id").join(table.select("id"), "id", "left_anti"), NotFound, "no such rows")


def update(table: DataFrame, patch: DataFrame) -> DataFrame:
    """Values of patch (id and some columns) that are not null replace the table's; updated_at follows on the rows concerned."""
    columns = [c for c in patch.columns if c != "id"]
    check_known(table, patch)
    p = patch.select("id", *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    j = table.join(p, "id", "left")
    out = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}
    if "updated_at" in table.columns:
        out["updated_at"] = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return j.withColumns(out).select(*table.columns)


def without(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """table without the rows whose column names one of ids (id)."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    return table.join(gone, table[column] == gone["__gone"], "left_anti")


def unlinked(table: DataFrame, ids: DataFrame) -> DataFrame:
    """table with node_id null where it names one of ids (id)."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    hit = table.join(gone, table["node_id"] == gone["__gone"], "left")
    return hit.withColumn("node_id", F.when(F.col("__gone").isNull(), F.col("node_id"))).drop("__gone").select(*table.columns)


def delete_with(ids: DataFrame, table: DataFrame, dependent: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """table without ids (id), and dependent without the rows whose column names one of them."""
    return without(table, ids), without(dependent, ids, column)


def delete_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, members: DataFrame | None = None, documents: DataFrame | None = None, communities: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the nodes of ids (id): edges, chunks and memberships go with them, documents and communities lose the link."""
    out = {"nodes": without(nodes, ids), "edges": without(without(edges, ids, "src"), ids, "dst"), "chunks": without(chunks, ids, "node_id")}
    if members is not None:
        out["members"] = without(members, ids, "node_id")
    if documents is not None:
        out["documents"] = unlinked(documents, ids)
    if communities is not None:
        out["communities"] = unlinked(communities, ids)
    return out
