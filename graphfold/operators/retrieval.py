"""Retrieval modes over a graph: hybrid, local, global and automatic, with packing, sources and confidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.errors import Invalid
from graphfold.functions.text import excerpt, header_block, normalize_name, phrases, thematic
from graphfold.operators.graph import Adjacency, Expansion, edge_filter, expand, held, settle
from graphfold.operators.index import VectorIndex
from graphfold.operators.runs import LENGTHS, runs, sieve, sifted
from graphfold.operators.topk import knn, scores
from graphfold.plans.schemas import COMMUNITY_SUMMARY, ENTITY_DESCRIPTION, MENTIONS, SCAFFOLD
from graphfold.plans.written import materialize

MODES = ("auto", "local", "global", "hybrid")
HIT_COLUMNS = ("id", "node_id", "node_name", "node_type", "kind", "text", "score", "hop", "phase")


@dataclass
class Graph:
    """nodes (id, type, name, …), edges (id, src, dst, type, …) and chunks (id, node_id, kind, text, embedding). A stored
    graph also has near(table, nodes), which reads the rows of some nodes (node) of nodes, edges, edges_in or chunks. With an
    index, the nearest chunks are looked for in its nearest cells; without one, which is the default, in all chunks."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    near: Callable[[str, DataFrame], DataFrame] | None = None
    index: VectorIndex | None = None

    @property
    def walkable(self) -> DataFrame | Adjacency:
        if self.near is None:
            return self.edges
        return Adjacency(self.edges, lambda nodes: self.near("edges", nodes), lambda nodes: self.near("edges_in", nodes))

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (node), with the columns of ids."""
        some = self.nodes if self.near is None else self.near("nodes", ids)
        return some.join(ids.withColumnRenamed("node", "id"), "id")

    def chunks_of(self, ids: DataFrame) -> DataFrame:
        """The chunks of ids (node, …) with its columns; the embedding is not read."""
        some = (self.chunks if self.near is None else self.near("chunks", ids)).drop("embedding")
        return some.join(ids.withColumnRenamed("node", "node_id"), "node_id")


@dataclass
class Result:
    """Ranked hits, and the subgraph that led to them."""

    hits: DataFrame
    nodes: DataFrame
    edges: DataFrame
    mode: str


def _with_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("type").alias("node_type"))
    return chunks.join(n, "node_id")


def _few(df: DataFrame, k: int) -> tuple[DataFrame, list]:
    """At most k ranked rows as a local table: what follows refers to them often and must not rank again."""
    rows = df.limit(k).toArrow()
    return held(df, rows), rows.to_pylist()


def ranked(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS).orderBy(F.desc("score"), "phase", "hop", "id")


def _best(hits: DataFrame) -> DataFrame:
    """A row for each chunk: the largest score, of equal ones the earliest phase."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "phase")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def nearest(g: Graph, query: Sequence[float], k: int, nodes: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, list]:
    """The k best chunks of existing nodes, as a local table (id, node_id, node_name, node_type, kind, text, score) and its
    rows. nodes (id) limits their nodes, where is a condition on chunks.

    Only ids, embeddings and what the condition reads is scanned, and no embedding is shuffled: nodes are looked up for
    scores. Only the best rows of a task leave the scan; if too few of their nodes are there, more are asked for. Where nodes
    limits so much that SPARE times k do not suffice, all scores meet them in a join.
    """
    chunks = g.chunks if g.index is None else g.index.near(query, g.chunks)
    chunks = chunks if where is None else chunks.where(where)
    slim = chunks.select("id", "node_id", "embedding")
    n, joined = k if nodes is None else SPARE * k, False
    while True:
        if joined:
            best = scores(slim, query).join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").orderBy(F.desc("score"), "id").limit(n)
        else:
            best = knn(slim, query, n)
        rows = found = best.select("id", "node_id", "score").collect()  # n rows
        if nodes is not None and not joined:
            of = {r["node_id"] for r in rows}
            among = {r["id"] for r in nodes.where(F.col("id").isin(*of)).select("id").collect()} if of else set()
            found = [r for r in rows if r["node_id"] in among][:k]
        named, texts = _looked_up(g, found)
        kept = [r for r in found if r["node_id"] in named and r["id"] in texts][:k]
        if len(kept) == k or len(rows) < n:
            break
        if nodes is not None and not joined:
            n, joined = k, True
        else:
            n *= 4
    schema = _row_schema(g)
    out = [(*_row(r, named, texts), r["score"]) for r in kept]
    df = g.nodes.sparkSession.createDataFrame(out, f"{schema}, score double")
    return df, [dict(zip(df.columns, row, strict=True)) for row in out]


#: How many times k rows nearest() looks at before it joins all scores with the nodes that it is limited to.
SPARE = 8


def _looked_up(g: Graph, rows: list) -> tuple[dict, dict]:
    """Names and types of the nodes of few rows (id, node_id) and kinds and texts of their chunks, by ids."""
    ids, of = [r["id"] for r in rows], {r["node_id"] for r in rows}
    named = {r["id"]: r for r in g.nodes.where(F.col("id").isin(*of)).select("id", "name", "type").collect()} if of else {}
    texts = {r["id"]: r for r in g.chunks.where(F.col("id").isin(*ids)).select("id", "kind", "text").collect()} if ids else {}
    return named, texts


def _row(r, named: dict, texts: dict) -> tuple:
    return r["id"], r["node_id"], named[r["node_id"]]["name"], named[r["node_id"]]["type"], texts[r["id"]]["kind"], texts[r["id"]]["text"]


def _row_schema(g: Graph) -> str:
    kind = lambda c: g.chunks.schema[c].dataType.simpleString()
    return f"id {kind('id')}, node_id {kind('node_id')}, node_name string, node_type string, kind string, text string"


def hybrid(g: Graph, query: Sequence[float], config: EngineConfig, top_k: int | None = None, node_types: Sequence[str] | None = None, hops: int | None = None, edge_types: Sequence[str] | None = None) -> Result:
    """The nearest chunks and all chunks of their nodes' surroundings, which score half the best seed's for each hop.

    node_types limits seeds and collected nodes but not the walk. The result is not cut to top_k.
    """
    k, hops = top_k or config.retrieval_top_k, config.expand_hops if hops is None else hops
    columns = ["id", "node_id", "node_name", "node_type", "kind", "text"]
    seeds, rows = nearest(g, query, k, g.nodes.where(F.col("type").isin(*node_types)) if node_types else None)
    base = max((r["score"] for r in rows), default=0.5)
    walk = expand(edge_filter(g.walkable, edge_types), seeds.select(F.col("node_id").alias("node")), hops)
    near = _with_nodes(g.chunks_of(walk.nodes.where("hop > 0")), g.nodes)
    near = near.where(F.col("node_type").isin(*node_types)) if node_types else near
    hits = seeds.withColumns({"hop": F.lit(0), "phase": F.lit(0)}).unionByName(near.select(*columns, (F.lit(float(base)) * F.pow(F.lit(0.5), F.col("hop"))).alias("score"), "hop", F.lit(0).alias("phase")))
    nodes = g.nodes_of(walk.nodes)
    if node_types:
        nodes = nodes.where((F.col("hop") == 0) | F.col("type").isin(*node_types))
    return Result(ranked(hits), nodes, walk.edges, "hybrid")


def seeds_by_name(nodes: DataFrame, query: str) -> DataFrame:
    """(node_id, score, match) of entities that the query names: exact 1.0, alias 0.95, name within the query 0.9; the first that fits."""
    named = nodes if "normalized_name" in nodes.columns else nodes.withColumn("normalized_name", F.lit(None).cast("string"))
    named = named if "aliases" in named.columns else named.withColumn("aliases", F.array().cast("array<string>"))
    own = normalize_name(F.col("name"))
    stored = F.coalesce(normalize_name(F.nullif("normalized_name", F.lit(""))), own)
    row = nodes.sparkSession.range(1).select(phrases(F.lit(query)).alias("p")).collect()[0]
    said = row["p"] or [""]
    text = said[0]
    lower_aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name)
    exact = stored.isin(*said) | own.isin(*said)
    alias = F.arrays_overlap(lower_aliases, F.lit(said))
    inside = (F.length(own) >= 3) & F.contains(F.lit(text), own)
    score = F.when(exact, 1.0).when(alias, 0.95).when(inside, 0.9)
    return named.where(~F.col("type").isin(*SCAFFOLD)).select(F.col("id").alias("node_id"), score.alias("score"), F.when(exact | ~alias, "exact").otherwise("alias").alias("match")).where(F.col("score").isNotNull())


def seeds_for_queries(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, score, match) of the entities that each of queries (query_id, text) names, as seeds_by_name()
    gives them for one.

    Names and aliases that are phrases of a query are joined by equality. A name within a query shares all its runs of
    characters with it, so it is looked up by that of its longest runs that the fewest queries have, and then compared; no
    query meets all names. Phrases and runs of queries that no name has stay where they are: sieves of fixed size, which
    hold what the names have, are broadcast.
    """
    named = nodes if "normalized_name" in nodes.columns else nodes.withColumn("normalized_name", F.lit(None).cast("string"))
    named = named if "aliases" in named.columns else named.withColumn("aliases", F.array().cast("array<string>"))
    own = normalize_name(F.col("name"))
    stored = F.coalesce(normalize_name(F.nullif("normalized_name", F.lit(""))), own)
    entities = named.where(~F.col("type").isin(*SCAFFOLD)).select(F.col("id").alias("node_id"), own.alias("own"), stored.alias("stored"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name).alias("aliases"))
    keys = entities.select("node_id", F.explode(F.array_distinct(F.array("own", "stored"))).alias("key"), F.lit("exact").alias("what"))
    keys = keys.unionByName(entities.select("node_id", F.explode(F.array_distinct("aliases")).alias("key"), F.lit("alias").alias("what"))).where(F.col("key").isNotNull())
    # written once, in as many shares as there are cores: few row groups may hold all of a small file's queries
    asking = materialize(queries.select("query_id", normalize_name(F.col("text")).alias("text")).repartition(nodes.sparkSession.sparkContext.defaultParallelism, "query_id"), "queries")
    said = asking.select("query_id", phrases(F.col("text")).alias("p")).select("query_id", F.when(F.coalesce(F.size("p"), F.lit(0)) > 0, F.col("p")).otherwise(F.array(F.lit(""))).alias("p"))
    asked = said.select("query_id", F.explode("p").alias("key")).withColumn("hash", F.xxhash64("key"))
    asked = sifted(asked, "hash", sieve(keys.select(F.xxhash64("key").alias("hash")), "hash"))
    equal = keys.join(asked.select("query_id", "key"), "key").select("query_id", "node_id", "what")
    texts = asking.where(F.length("text") >= LENGTHS[0])
    names = entities.where(F.length("own") >= LENGTHS[0]).select("own").distinct()
    of_name = materialize(runs(names, "own", "own", longest=True), "name_runs")
    of_query = materialize(runs(texts, "query_id", "text", sieve=sieve(of_name, "run")), "query_runs")
    common = of_query.groupBy("run").agg(F.count("*").alias("n"))
    rarest = of_name.join(common, "run", "left").groupBy("own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select("own", "r.run")
    candidates = of_query.join(rarest, "run").select("query_id", "own").distinct()
    within = candidates.join(texts, "query_id").where(F.contains("text", "own")).select("query_id", "own").distinct()
    inside = within.join(entities.select("node_id", "own"), "own").select("query_id", "node_id", F.lit("inside").alias("what"))
    found = equal.unionByName(inside).groupBy("query_id", "node_id").agg(*(F.max(F.col("what") == c).alias(c) for c in ("exact", "alias")))
    score = F.when(F.col("exact"), 1.0).when(F.col("alias"), 0.95).otherwise(0.9)
    return found.select("query_id", "node_id", score.alias("score"), F.when(F.col("exact") | ~F.col("alias"), "exact").otherwise("alias").alias("match"))


def entity_seeds(g: Graph, query: str, vector: Sequence[float], config: EngineConfig, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """(node_id, score, match): entities that the query names or whose description is near to it, best first."""
    k = top_k or config.local_entity_top_k
    threshold = config.auto_entity_score_threshold if threshold is None else threshold
    near = nearest(g, vector, 2 * k, g.nodes.where(~F.col("type").isin(*SCAFFOLD)), F.col("kind") == ENTITY_DESCRIPTION)[0].where(F.col("score") >= threshold).select("node_id", "score", F.lit("embedding").alias("match"))
    both = seeds_by_name(g.nodes, query).withColumn("p", F.lit(0)).unionByName(near.withColumn("p", F.lit(1)))
    one = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "p"))
    return both.withColumn("r", one).where("r = 1").select("node_id", "score", "match").orderBy(F.desc("score"), "node_id").limit(k)


def local(g: Graph, query: str, vector: Sequence[float], config: EngineConfig, top_k: int | None = None, hops: int | None = None, edge_types: Sequence[str] | None = None, seeds: tuple[DataFrame, list] | None = None) -> Result:
    """Entities that the query is about, their surroundings, and the evidence that mentions them. Without seeds: hybrid.

    Chunks are ranked by ids, nodes and kinds; names and texts are looked up for the hits. seeds are those of
    entity_seeds(), where they are known already.
    """
    k, hops = top_k or config.retrieval_top_k, config.expand_hops if hops is None else hops
    seeds, rows = seeds or _few(entity_seeds(g, query, vector, config), config.local_entity_top_k)
    if not rows:
        return hybrid(g, vector, config, top_k, None, hops, edge_types)
    base = max(r["score"] for r in rows)
    # mentions are not walked, but a request for nothing but mentions filters nothing
    wanted = [t for t in edge_types or () if t != MENTIONS]
    walk = expand(edge_filter(g.walkable, wanted, None if edge_types else [MENTIONS]), seeds.select(F.col("node_id").alias("node")), hops)
    entities = settle(g.nodes_of(walk.nodes).where(~F.col("type").isin(*SCAFFOLD)).select(F.col("id").alias("node_id"), "hop"))
    into = g.edges if g.near is None else g.near("edges_in", walk.nodes)
    evidence = settle(into.where(F.col("type") == MENTIONS).join(entities.select(F.col("node_id").alias("dst")), "dst", "left_semi"))
    # what is known of a node: its hop and score as an entity, and whether it mentions one
    as_entity = entities.join(seeds.select("node_id", F.col("score").alias("own")), "node_id", "left").withColumn("source", F.lit(False))
    as_source = evidence.select(F.col("src").alias("node_id"), F.lit(None).cast("int").alias("hop"), F.lit(None).cast("double").alias("own"), F.lit(True).alias("source"))
    about = as_entity.unionByName(as_source).groupBy("node_id").agg(*(F.max(c).alias(c) for c in ("hop", "own", "source")))
    found = g.chunks.select("id", "node_id", "kind").join(g.nodes.select(F.col("id").alias("node_id")).join(about, "node_id"), "node_id")
    if "chunk_id" in g.edges.columns:
        cited = evidence.where(F.coalesce("chunk_id", F.lit("")) != "").select(F.col("chunk_id").alias("id"), F.lit(True).alias("cited")).distinct()
        found = found.join(cited, "id", "left")
    else:
        found = found.withColumn("cited", F.lit(None).cast("boolean"))
    boost = F.when(F.col("kind") == ENTITY_DESCRIPTION, 1.05).otherwise(1.0)
    own = F.when(F.col("hop").isNotNull(), F.coalesce("own", F.lit(float(base))) * F.pow(F.lit(0.5), F.col("hop")) * boost)
    half, late = F.lit(float(base) * 0.5), F.coalesce("cited", F.lit(False)) | F.col("source")
    first = own.isNotNull() & (~late | (own >= half))  # of equal scores that of the earliest phase
    phase = F.when(first, 0).when(F.col("cited"), 1).otherwise(2)
    hits = _best(found.select("id", "node_id", F.when(first, own).otherwise(half).alias("score"), F.when(first, F.col("hop")).otherwise(1).alias("hop"), phase.alias("phase")))
    best = hits.orderBy(F.desc("score"), "phase", "hop", "id").limit(k).collect()
    named, texts = _looked_up(g, best)
    told = g.nodes.sparkSession.createDataFrame([(*_row(r, named, texts), r["score"], r["hop"], r["phase"]) for r in best], f"{_row_schema(g)}, score double, hop int, phase int")
    nodes = g.nodes.join(entities.select(F.col("node_id").alias("id")).union(evidence.select("src")).distinct(), "id", "left_semi")
    edges = walk.edges.unionByName(evidence.select(*walk.edges.columns)).dropDuplicates(["id"])
    return Result(ranked(told), nodes, edges, "local")


def global_(g: Graph, vector: Sequence[float], config: EngineConfig, top_k: int | None = None) -> Result:
    """The nearest community summaries. Without any: hybrid."""
    k = top_k or config.global_map_top_k
    # summaries by their kind and chunks of communities by their node: each list has its own best, and the best of both count
    summaries, _ = nearest(g, vector, k, None, F.col("kind") == COMMUNITY_SUMMARY)
    others, _ = nearest(g, vector, k, g.nodes.where(F.col("type") == "community"), F.coalesce(F.col("kind") != COMMUNITY_SUMMARY, F.lit(True)))
    best = summaries.unionByName(others).orderBy(F.desc("score"), "id")
    hits, rows = _few(best.withColumns({"hop": F.lit(0), "phase": F.lit(0)}), k)
    if not rows:
        return hybrid(g, vector, config, k)
    return Result(ranked(hits), g.nodes.join(hits.select(F.col("node_id").alias("id")), "id", "left_semi"), g.edges.limit(0), "global")


def choose_mode(strong: Column, is_thematic: Column, communities: Column) -> Column:
    return F.when(strong & ~is_thematic, "local").when(communities & (is_thematic | ~strong), "global").otherwise("hybrid")


def resolve_mode(g: Graph, query: str, vector: Sequence[float], config: EngineConfig, mode: str = "auto", seeds: tuple[DataFrame, list] | None = None) -> str:
    if mode not in MODES:
        raise Invalid(f"mode is one of {MODES}")
    if mode != "auto":
        return mode
    _, rows = seeds or _few(entity_seeds(g, query, vector, config), config.local_entity_top_k)
    strong = any(r["score"] >= config.auto_entity_score_threshold for r in rows)
    communities = g.nodes.where(F.col("type") == "community").limit(1).count() > 0
    row = g.nodes.sparkSession.range(1).select(choose_mode(F.lit(strong), thematic(F.lit(query)), F.lit(communities)).alias("m"))
    return row.collect()[0]["m"]


def search(g: Graph, query: str, vector: Sequence[float], config: EngineConfig, mode: str = "auto", top_k: int | None = None, node_types: Sequence[str] | None = None, hops: int | None = None, edge_types: Sequence[str] | None = None) -> Result:
    # the mode and the walk start from the same entities
    seeds = _few(entity_seeds(g, query, vector, config), config.local_entity_top_k) if mode == "auto" else None
    mode = resolve_mode(g, query, vector, config, mode, seeds)
    if mode == "local":
        return local(g, query, vector, config, top_k, hops, edge_types, seeds)
    if mode == "global":
        return global_(g, vector, config, top_k)
    return replace(hybrid(g, vector, config, top_k, node_types, hops, edge_types), mode=mode)


@dataclass
class Response:
    """What a caller sees of a search: hits without embeddings, the subgraph, and the mode that was used."""

    hits: DataFrame
    nodes: DataFrame
    edges: DataFrame
    mode_used: str


def response(found: Result) -> Response:
    hits = found.hits.select(F.col("id").alias("chunk_id"), "node_id", "node_name", "node_type", "text", "score", "hop")
    hidden = ("hop", "normalized_name", "embedding")
    visible = lambda df: df.select(*(c for c in df.columns if c not in hidden))
    return Response(hits, visible(found.nodes), visible(found.edges), found.mode)


#: Characters of a header without names, type, id or text.
LEAST_BLOCK = len("[node:||chunk:]\n")


def most_packed(budget_tokens: int) -> int:
    """How many hits a context can hold at most, and one more."""
    return 4 * max(budget_tokens, 1) // LEAST_BLOCK + 1


def packed(hits: DataFrame, budget_tokens: int) -> DataFrame:
    """(rank, block) of the longest prefix of hits whose blocks fit 4 characters a token; the first always stays.

    No block is shorter than its header, so a bounded number of the best hits is all that is ranked.
    """
    order = [F.desc("score"), F.asc("phase"), F.asc("hop"), F.asc("id")]
    best = hits.orderBy(*order).limit(most_packed(budget_tokens))
    block = header_block(F.col("node_name"), F.col("node_type"), F.col("id"), F.col("text"))
    blocks = best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), block.alias("block"))
    total = F.sum(F.length("block")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("total", total).where((F.col("total") <= 4 * max(budget_tokens, 1)) | (F.col("rank") == 1)).drop("total")


def pack_context(hits: DataFrame, budget_tokens: int) -> DataFrame:
    """One row: the packed blocks, set apart by blank lines."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return packed(hits, budget_tokens).agg(F.array_join(blocks, "\n\n").alias("context"))


def sources(hits: DataFrame, top_k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "phase", "hop", "id").limit(top_k).select("id", "node_id", "node_name", "score", excerpt(F.col("text")).alias("excerpt"))


def confidence(hits: DataFrame, top_k: int) -> DataFrame:
    """One row: 0.65 of the best and 0.35 of the mean of the first top_k scores, each within 0 and 1; null without hits."""
    first = hits.orderBy(F.desc("score"), "phase", "hop", "id").limit(top_k).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("s"))
    return first.agg(F.bround(0.65 * F.max("s") + 0.35 * F.avg("s"), 3).alias("confidence"))


__all__ = ["Expansion", "Graph", "Result", "choose_mode", "confidence", "entity_seeds", "global_", "hybrid", "local", "nearest", "pack_context", "packed", "resolve_mode", "search", "seeds_by_name", "sources"]
