"""One object for all that a user does with a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.errors import EngineError, NotFound
from graphfold.operators import community, graph, ingest, qa, retrieval, tables
from graphfold.operators.index import VectorIndex
from graphfold.plans.written import discard, materialize
from graphfold.sources.clients import EmbeddingClient, LanguageClient, embed_texts, with_completions, with_embeddings
from graphfold.sources.store import KEYS, Store


class Engine:
    """Reads and writes the tables of a store; searches, answers, ingests and rebuilds."""

    def __init__(self, spark: SparkSession, store: Store, embedder: EmbeddingClient, model: LanguageClient, config: EngineConfig | None = None):
        self.spark, self.store, self.embedder, self.model, self.config = spark, store, embedder, model, config or EngineConfig()
        self.index: VectorIndex | None = None

    def graph(self) -> retrieval.Graph:
        return retrieval.Graph(*(self.store.read(t) for t in ("nodes", "edges", "chunks")), self.store.near, self.index)

    def build_index(self, breadth: int = 64, cells: int | None = None) -> VectorIndex:
        """Indexes all chunks; searches read the `breadth` nearest cells from now on, and chunks that come later in full."""
        self.index = VectorIndex.build(self.store.read("chunks"), f"{self.store.path}/_index", cells, breadth)
        return self.index

    def get(self, table: str, key: str):
        rows = tables.get(self.store.lookup(table, [key]) if KEYS.get(table, "id") == "id" else self.store.read(table), key).collect()
        if not rows:
            raise NotFound(f"{table} has no {key}")
        return rows[0]

    def create_nodes(self, rows: DataFrame) -> DataFrame:
        rows, t = materialize(tables.node_rows(rows), "nodes"), self.store.begin()
        t.change("nodes", rows, lambda old: tables.insert_nodes(old, rows))
        t.commit()
        return self.store.read("nodes")

    def create_edges(self, rows: DataFrame) -> DataFrame:
        rows, t = materialize(tables.edge_rows(rows), "edges"), self.store.begin()
        nodes = t.read("nodes")
        t.change("edges", rows, lambda old: tables.insert_edges(nodes, old, rows))
        t.commit()
        return self.store.read("edges")

    def create_chunks(self, rows: DataFrame) -> DataFrame:
        """Rows are checked before anything is embedded, and each text is embedded once."""
        t = self.store.begin()
        nodes = t.read("nodes")
        rows = materialize(with_embeddings(tables.checked_chunks(nodes, rows), self.embedder, self.config), "embedded")
        t.change("chunks", rows, lambda old: tables.insert_chunks(nodes, old, rows))
        t.commit()
        return self.store.read("chunks")

    def update(self, table: str, patch: DataFrame) -> DataFrame:
        """A chunk whose text changes is embedded again."""
        if table == "chunks" and "text" in patch.columns:
            patch = materialize(with_embeddings(patch, self.embedder, self.config), "embedded")
        t = self.store.begin()
        tables.check_known(t.read(table), patch)
        t.change(table, patch, lambda old: tables.update(old, patch), on="id")
        t.commit()
        return self.store.read(table)

    #: What goes with a deleted row: table and column that names it.
    DEPENDENT = {"communities": ("members", "community_id"), "documents": ("jobs", "document_id")}

    def delete(self, table: str, ids: DataFrame) -> None:
        """Deletes rows and what depends on them, in one commit: of nodes their edges, chunks and memberships, of
        communities the memberships, of documents the jobs. Only buckets that hold such rows are written."""
        t = self.store.begin()
        gone = materialize(ids.select("id").distinct(), "gone")
        drop = lambda column: lambda old: tables.without(old, gone, column)
        named = lambda column: gone.select(F.col("id").alias(column))
        dependent = [("edges", "src"), ("edges", "dst"), ("chunks", "node_id"), ("members", "node_id")] if table == "nodes" else [self.DEPENDENT[table]] if table in self.DEPENDENT else []
        for name, column in [(table, "id"), *dependent]:
            t.change(name, named(column), drop(column), on=column)
        if table == "nodes":
            for name in ("documents", "communities"):
                t.change(name, named("node_id"), lambda old: tables.unlinked(old, gone), on="node_id")
        t.commit()

    def list_nodes(self, **how) -> DataFrame:
        return tables.list_nodes(self.store.read("nodes"), **how)

    def list_edges(self, **how) -> DataFrame:
        return tables.list_edges(self.store.read("edges"), **how)

    def list_chunks(self, **how) -> DataFrame:
        return tables.list_chunks(self.store.read("chunks"), **how)

    def list_documents(self, **how) -> DataFrame:
        """Documents with the numbers of their chunks and mentions."""
        page = tables.list_documents(self.store.read("documents"), **how)
        return tables.document_counts(page, self.store.read("chunks"), self.store.read("edges")).orderBy(F.desc("created_at"), "id")

    def list_communities(self, **how) -> DataFrame:
        return tables.list_communities(self.store.read("communities"), **how)

    def members_of(self, community_id: str) -> DataFrame:
        self.get("communities", community_id)
        return community.members_of(community_id, self.store.read("members"), self.store.read("nodes"))

    def reembed(self, limit: int = 100) -> DataFrame:
        """Embeds the oldest chunks that lack an embedding."""
        t = self.store.begin()
        fresh = materialize(ingest.reembedded(t.read("chunks"), self.embedder, self.config, limit), "reembedded")
        t.change("chunks", fresh, lambda old: tables.update(old, fresh), on="id")
        t.commit()
        return self.store.read("chunks")

    def neighbors(self, node_id: str, direction: str = "both", edge_type: str | None = None, depth: int = 1) -> graph.Expansion:
        self.get("nodes", node_id)
        g = self.graph()
        return graph.neighbors(g.nodes, g.walkable, node_id, direction, edge_type, depth)

    def search(self, query: str, **how) -> retrieval.Result:
        return retrieval.search(self.graph(), query, embed_texts(self.embedder, [query], self.config)[0], self.config, **how)

    def ask(self, question: str, **how) -> qa.Answer:
        return qa.ask(self.graph(), question, embed_texts(self.embedder, [question], self.config)[0], self.model, self.config, **how)

    def submit(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Writes pending documents and jobs for docs (id, title, text); returns the pending jobs. A batch (stream, number)
        that has been submitted before adds none."""
        t = self.store.begin(batch)
        if not t.repeated:
            docs = materialize(docs, "submitted")
            documents, jobs = (materialize(df, name) for df, name in zip(ingest.new_rows(docs, t.read("documents"), t.read("jobs")), ("documents", "jobs"), strict=True))
            t.change("documents", documents, lambda old: ingest.upserted(old, documents, ["error"]))
            t.change("jobs", jobs, lambda old: old.unionByName(tables.aligned(old, jobs)))
            t.commit()
        return self.store.read("jobs").where(F.col("status") == "pending")

    def _stamp(self, t, jobs: DataFrame, document: dict, job: dict) -> None:
        """Sets values in the rows of documents and of their jobs (id, document_id); values are columns of jobs or constants."""
        of = lambda values, rows: rows.select("id", *(F.col(v).alias(c) if isinstance(v, str) and v in rows.columns else F.lit(v).alias(c) for c, v in values.items()))
        rows = of(document, jobs.drop("id").withColumnRenamed("document_id", "id").dropDuplicates(["id"]))
        t.change("documents", rows, lambda old: ingest.stamped(old, rows))
        of_jobs = of(job, jobs)
        t.change("jobs", of_jobs, lambda old: ingest.stamped(old, of_jobs))

    def run_jobs(self, resume: bool = False) -> ingest.Ingested | None:
        """Runs all pending jobs in one pass: chunks, extractions, entities and edges of their documents are added to the
        stored graph in one commit, and the communities of the whole graph are built anew. Documents and jobs follow each
        stage. A document that fails says so with the error, as does its job, and leaves the graph as it was; the others
        go on, each with its own progress. Raises if none got through. With resume, jobs that a lost driver left running
        run again.
        """
        due = F.col("status").isin("pending", "running") if resume else F.col("status") == "pending"
        pending = materialize(self.store.read("jobs").where(due).select("id", "document_id"), "pending")
        if pending.isEmpty():
            return None
        of_jobs = pending.select(F.col("document_id").alias("node")).distinct()
        docs = materialize(self.store.near("documents", of_jobs).select("id", "title", "text"), "documents")
        written: list[DataFrame] = []

        def write(df: DataFrame, name: str) -> DataFrame:
            written.append(materialize(df, f"job_{name}"))
            return written[-1]

        def stamp(stage: str, jobs: DataFrame = pending) -> None:
            t = self.store.begin()
            self._stamp(t, jobs, {"status": stage}, {"stage": stage, "status": "running"})
            t.commit()

        try:
            made = ingest.run(docs, self.graph(), self.embedder, self.model, self.config, write, stamp, lambda nodes: self.store.near("edges", nodes), lambda nodes: self.store.near("chunks", nodes))
            named = lambda df: pending.join(df.withColumnRenamed("id", "document_id"), "document_id")
            failed, done = write(named(made.failed), "failures"), write(named(made.done), "finished")
            t = self.store.begin()
            self._stamp(t, failed, {"status": "failed", "error": "error"}, {"stage": "stage", "status": "failed", "error": "error", "chunks": "chunks"})
            t.commit()
            if done.isEmpty():
                raise EngineError(failed.orderBy("document_id").first()["error"])
            self._add(made)
            stamp("building_communities", done.select("id", "document_id"))
            communities = self.rebuild_communities().communities.count()
            t = self.store.begin()
            self._stamp(t, done.withColumn("communities", F.lit(communities)), {"status": "ready", "error": None}, {"stage": "ready", "status": "completed", "error": None, "communities": "communities"} | {c: c for c in ingest.PROGRESS})
            t.commit()
            totals = done.dropDuplicates(["document_id"]).agg(*(F.sum(c).alias(c) for c in ingest.PROGRESS)).collect()[0].asDict()
            bad = materialize(failed.select(F.col("document_id").alias("id"), "error").distinct(), "failed")
            return ingest.Ingested(self.graph(), totals, bad)
        except Exception as e:
            t = self.store.begin()
            open_ = t.read("jobs").where(F.col("status").isin("pending", "running")).join(pending.select("id"), "id", "left_semi").select("id", "document_id")
            self._stamp(t, materialize(open_, "open"), {"status": "failed", "error": str(e)[:4000]}, {"status": "failed", "error": str(e)[:4000]})
            t.commit()
            raise
        finally:
            for df in written:
                discard(df)

    def _add(self, made: ingest.Changes) -> None:
        """Writes what a run adds to the graph in one commit. Earlier chunks of its documents go."""
        t = self.store.begin()
        t.change("nodes", made.nodes, lambda old: ingest.upserted(old, made.nodes))
        t.change("edges", made.edges, lambda old: ingest.upserted(old, made.edges))
        of = made.done.select("node_id")
        t.change("chunks", of.union(made.chunks.select("node_id")), lambda old: ingest.upserted(old.join(of, "node_id", "left_anti").select(*old.columns), made.chunks))
        documents = made.done.select("id", "node_id")
        t.change("documents", documents, lambda old: ingest.upserted(old, documents))
        t.commit()

    def ingest(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> ingest.Ingested | None:
        """Submits documents (id, title, text) and runs their jobs. A batch (stream, number) that comes again, as after a
        lost driver, adds no jobs and runs what is left of its own."""
        self.submit(docs, batch)
        return self.run_jobs(resume=batch is not None)

    def reindex(self, ids: DataFrame) -> ingest.Ingested:
        """Runs documents (id) of the store again; their chunks and mentions go first, entities and descriptions stay."""
        t = self.store.begin()
        docs = materialize(t.read("documents").join(ids.select("id"), "id", "left_semi").select("id", "title", "text"), "documents")
        of = materialize(ingest.document_nodes(docs).select("node_id"), "document_nodes")
        t.change("chunks", of, lambda old: tables.without(old, of.withColumnRenamed("node_id", "id"), "node_id"))
        t.change("edges", of.select(F.col("node_id").alias("src")), lambda old: ingest.unmentioned(of, old))
        t.commit()
        return self.ingest(docs)

    def rebuild_communities(self) -> community.Communities:
        """Nodes, chunks, communities and members of communities anew, in one commit."""
        t = self.store.begin()
        nodes, chunks = t.read("nodes"), t.read("chunks")
        gone = materialize(t.read("communities").where(F.col("node_id").isNotNull()).select("node_id").distinct(), "communities")
        left, _ = community.clear(gone, nodes, chunks)
        made = community.rebuild(left, t.read("edges"), self.config, lambda df: with_completions(df, self.model, self.config, community.SUMMARY_SYSTEM, temperature=0.2), lambda df: with_embeddings(df, self.embedder, self.config))
        fresh = materialize(tables.aligned(nodes, made.nodes), "community_nodes")
        t.change("nodes", gone.select(F.col("node_id").alias("id")).union(fresh.select("id")), lambda old: tables.without(old, gone.withColumnRenamed("node_id", "id"), "id").unionByName(fresh))
        summaries = materialize(tables.aligned(chunks, made.chunks), "community_chunks")
        t.change("chunks", gone.union(summaries.select("node_id")), lambda old: tables.without(old, gone.withColumnRenamed("node_id", "id"), "node_id").unionByName(summaries))
        for name, new in (("communities", made.communities), ("members", made.members)):
            t.put(name, tables.aligned(t.read(name), new))
        t.commit()
        return made

    def health(self) -> dict[str, bool]:
        """Whether storage, embedder and model answer."""
        out = {}
        for name, probe in (("store", lambda: self.store.read("nodes").limit(1).count()), ("embedder", lambda: embed_texts(self.embedder, ["ping"], self.config)), ("model", lambda: self.model.complete("", "ping"))):
            try:
                probe()
                out[name] = True
            except Exception:
                out[name] = False
        return out | {"ok": all(out.values())}
