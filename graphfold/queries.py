"""The engine's own queries over the driver's tables, with the same queries in DuckDB's SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.errors import Upstream
from graphfold.functions import text as X
from graphfold.functions import vectors as V
from graphfold.engine import Engine
from graphfold.operators import chunking, community, extraction, graph, ingest, qa, resolution, retrieval, tables
from graphfold.operators.topk import knn, knn_batch
from graphfold.plans.written import materialize, shared_dir, there
from graphfold.sources.clients import EchoLanguage, HashEmbeddings
from graphfold.sources.fixture import CTES, query_vector, table, written_at
from graphfold.sources.fixture import graph as fixture
from graphfold.sources.store import Field, Store, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = EngineConfig(dim=64)


def query(sql: str | None = None, graph_ctes: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its name. sql follows the fixture's CTEs unless graph_ctes is off."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            word = "WITH RECURSIVE" if recursive else "WITH"
            ORACLE_SQL[f.__name__] = f"{word} {CTES}, {sql.strip()}" if graph_ctes else sql.strip()
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
COS = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.v)"


@query(f"{Q0} SELECT c.id, round({COS}, 6) AS score FROM g_chunks c, q ORDER BY {COS} DESC, c.id LIMIT 8")
def knn_topk(spark, sf_dir):
    return knn(fixture(spark, sf_dir).chunks.select("id", "embedding"), query_vector(spark, sf_dir), 8).select("id", r6("score").alias("score"))


@query(f"{Q0} SELECT c.id, n.type AS node_type, round({COS}, 6) AS score FROM g_chunks c JOIN g_nodes n ON n.id = c.node_id, q WHERE n.type = 'customer' ORDER BY {COS} DESC, c.id LIMIT 8")
def knn_type_filter(spark, sf_dir):
    g = fixture(spark, sf_dir)
    hits, _ = retrieval.nearest(g, query_vector(spark, sf_dir), 8, g.nodes.where(F.col("type") == "customer"))
    return hits.select("id", "node_type", r6("score").alias("score"))


@query(
    """qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 10),
s AS (SELECT q.query_id, c.id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.v) AS score FROM g_chunks c, qs q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def knn_batch_top5(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < 10).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn_batch(fixture(spark, sf_dir).chunks, q, 5).select("query_id", "rank", "id", r6("score").alias("score"))


@query(
    """WITH h AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM h),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos, l FROM n)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN l > 0 THEN x / l ELSE x END, 6) + 0.0 AS value FROM e""",
    graph_ctes=False,
)
def fit_embedding_trunc(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.fit_embedding(F.col("embedding"), 32)).alias("pos", "value"))
    return e.select("vec_id", "pos", (r6("value") + 0.0).alias("value"))


@query("SELECT concat('x:', CAST(vec_id AS string)) AS id, vec_id % 50 AS created_at FROM fx_e WHERE vec_id % 7 = 0 ORDER BY created_at, id LIMIT 100")
def reembed_queue(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("x:"), F.col("vec_id").cast("string")).alias("id"), (F.col("vec_id") % 50).alias("created_at"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return tables.reembed_queue(rows).select("id", "created_at")


@query("SELECT id, name FROM g_nodes WHERE type = 'part' AND name ILIKE '%D%r_N%' ORDER BY name DESC, id LIMIT 20 OFFSET 5")
def node_list_ilike(spark, sf_dir):
    nodes = fixture(spark, sf_dir).nodes.withColumn("created_at", F.col("name"))
    return tables.list_nodes(nodes, type="part", q="D%r_N", limit=20, offset=5).select("id", "name")


@query(
    """WITH b AS (SELECT min(p_brand) AS b FROM part), p AS (SELECT *, p_partkey % 4 AS k FROM part),
w AS (SELECT 'brand and size' AS wanted, p_partkey FROM p, b WHERE p_brand = b AND p_size = 7 UNION ALL SELECT 'a number, not true', p_partkey FROM p WHERE k = 0
UNION ALL SELECT 'true, not a number', p_partkey FROM p WHERE k = 1 UNION ALL SELECT 'nested', p_partkey FROM p WHERE p_size = 7 AND p_partkey % 2 = 0 UNION ALL SELECT 'items', p_partkey FROM p, b WHERE p_brand = b),
r AS (SELECT wanted, concat('p:', CAST(p_partkey AS string)) AS id, row_number() OVER (PARTITION BY wanted ORDER BY p_partkey % 10 DESC, concat('p:', CAST(p_partkey AS string))) AS r FROM w)
SELECT wanted, id FROM r WHERE r <= 40""",
    graph_ctes=False,
)
def node_list_props(spark, sf_dir):
    """Members by kind, at any depth: 1, true and "1" differ, 1 and 1.0 do not."""
    p = table(spark, sf_dir, "part")
    brand = p.agg(F.min("p_brand")).collect()[0][0]
    k = F.col("p_partkey") % 4
    flag = F.when(k == 0, "1").when(k == 1, "true").when(k == 2, '"1"').otherwise("1.5")
    deep = F.to_json(F.struct((F.col("p_partkey") % 2 == 0).alias("even"), F.col("p_size").alias("s.ize")))
    props = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit(', "flag": '), flag, F.lit(', "deep": '), deep, F.lit(', "items": ["x", {"of": "'), "p_brand", F.lit('", "n": 1}]}'))
    nodes = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name"), props.alias("props"), (F.col("p_partkey") % 10).alias("created_at"))
    wanted = {
        "brand and size": {"brand": brand, "size": 7.0}, "a number, not true": {"flag": 1}, "true, not a number": {"flag": True},
        "nested": {"deep": {"even": True, "s.ize": 7}}, "items": {"items": [{"of": brand}, "x"]},
    }
    pages = [tables.list_nodes(nodes, props=w, limit=40).select(F.lit(name).alias("wanted"), "id") for name, w in wanted.items()]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


@query("SELECT id, dst FROM g_edges WHERE type = 'supplies' AND src = 's:3' ORDER BY dst DESC, id LIMIT 100")
def edge_list_filter(spark, sf_dir):
    return tables.list_edges(fixture(spark, sf_dir).edges.withColumn("created_at", F.col("dst")), src="s:3", type="supplies").select("id", "dst")


@query("SELECT id, node_id, kind FROM g_chunks WHERE node_id = 'k:3' ORDER BY id DESC LIMIT 100")
def chunk_list_filter(spark, sf_dir):
    return tables.list_chunks(fixture(spark, sf_dir).chunks.withColumn("created_at", F.col("id")), node_id="k:3").select("id", "node_id", "kind")


@query("SELECT id, type, name FROM g_nodes WHERE id = 'c:7'")
def point_lookup(spark, sf_dir):
    return tables.get(fixture(spark, sf_dir).nodes, "c:7").select("id", "type", "name")


@query("SELECT id, src, dst, type FROM g_edges WHERE src IN ('c:1', 'p:5', 'n:3', 's:2') OR dst IN ('c:1', 'p:5', 'n:3', 's:2')")
def edges_incident(spark, sf_dir):
    frontier = spark.createDataFrame([("c:1",), ("p:5",), ("n:3",), ("s:2",)], "node string")
    return graph.incident(fixture(spark, sf_dir).edges, frontier).select("id", "src", "dst", "type")


@query(
    """i AS (SELECT src, dst, type, NULL AS description, 0 AS place FROM g_edges UNION ALL SELECT src, dst, type, concat('near ', dst), 1 FROM g_edges WHERE type = 'located_in'
UNION ALL SELECT src, dst, type, '', 2 FROM g_edges WHERE type = 'in_region')
SELECT src, dst, type, arg_max(description, place) FILTER (WHERE description <> '') AS description FROM i GROUP BY src, dst, type"""
)
def edge_dedup_triple(spark, sf_dir):
    e = fixture(spark, sf_dir).edges.select("src", "dst", "type", F.lit(None).cast("string").alias("chunk_id"))
    late = e.where(F.col("type") == "located_in").withColumns({"description": F.concat(F.lit("near "), "dst"), "at": F.lit(1)})
    blank = e.where(F.col("type") == "in_region").withColumns({"description": F.lit(""), "at": F.lit(2)})
    both = e.withColumns({"description": F.lit(None).cast("string"), "at": F.lit(0)}).unionByName(late).unionByName(blank)
    return resolution.upsert_edges(both).select("src", "dst", "type", "description")


@query(
    """gone AS (SELECT id FROM g_nodes WHERE type = 'region' OR id IN ('c:1', 's:2', 'd:0'))
SELECT 'nodes' AS tbl, count(*) AS n FROM g_nodes WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*) FROM g_edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM g_chunks WHERE node_id NOT IN (SELECT id FROM gone)"""
)
def cascade_delete(spark, sf_dir):
    g = fixture(spark, sf_dir)
    gone = g.nodes.where((F.col("type") == "region") | F.col("id").isin("c:1", "s:2", "d:0")).select("id")
    left = tables.delete_nodes(gone, g.nodes, g.edges, g.chunks)
    counts = [left[t].agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in ("nodes", "edges", "chunks")]
    return counts[0].union(counts[1]).union(counts[2])


@query("p AS (SELECT id, 'Renamed ' || name AS name FROM g_nodes WHERE type = 'nation') SELECT n.id, n.type, coalesce(p.name, n.name) AS name FROM g_nodes n LEFT JOIN p ON p.id = n.id")
def update_nodes(spark, sf_dir):
    nodes = fixture(spark, sf_dir).nodes
    return tables.update(nodes, nodes.where(F.col("type") == "nation").select("id", F.concat(F.lit("Renamed "), "name").alias("name"))).select("id", "type", "name")


def _neighbors(spark, sf_dir, node, direction, depth):
    g = fixture(spark, sf_dir)
    return graph.neighbors(g.nodes, g.edges, node, direction, None, depth).nodes.select("id", "type", "hop")


@query("SELECT id, type, 0 AS hop FROM g_nodes WHERE id = 'n:3' UNION ALL SELECT DISTINCT n.id, n.type, 1 FROM g_edges e JOIN g_nodes n ON n.id = e.dst WHERE e.src = 'n:3'")
def neighbors_out(spark, sf_dir):
    return _neighbors(spark, sf_dir, "n:3", "out", 1)


@query("SELECT id, type, 0 AS hop FROM g_nodes WHERE id = 'n:3' UNION ALL SELECT DISTINCT n.id, n.type, 1 FROM g_edges e JOIN g_nodes n ON n.id = e.src WHERE e.dst = 'n:3'")
def neighbors_in(spark, sf_dir):
    return _neighbors(spark, sf_dir, "n:3", "in", 1)


ADJ = "adj AS (SELECT src AS a, dst AS b FROM g_edges UNION ALL SELECT dst, src FROM g_edges)"
WALK = f"""{ADJ},
h1 AS (SELECT DISTINCT b AS id FROM adj WHERE a = 'c:1' AND b <> 'c:1'),
h2 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM h1) AND b <> 'c:1' AND b NOT IN (SELECT id FROM h1)),
w AS (SELECT 'c:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


@query(f"{WALK} SELECT n.id, n.type, w.hop FROM w JOIN g_nodes n ON n.id = w.id")
def neighbors_both_d2(spark, sf_dir):
    return _neighbors(spark, sf_dir, "c:1", "both", 2)


@query(
    """adj AS (SELECT src AS a, dst AS b FROM g_edges WHERE type IN ('located_in', 'in_region') UNION ALL SELECT dst, src FROM g_edges WHERE type IN ('located_in', 'in_region')),
w AS (SELECT 'r:0' AS node, 0 AS hop UNION SELECT adj.b, w.hop + 1 FROM w JOIN adj ON adj.a = w.node WHERE w.hop < 3)
SELECT node, min(hop) AS hop FROM w GROUP BY node""",
    recursive=True,
)
def bfs_hops(spark, sf_dir):
    edges = graph.edge_filter(fixture(spark, sf_dir).edges, ["located_in", "in_region"])
    return graph.bfs(edges, spark.createDataFrame([("r:0",)], "node string"), 3)


@query(
    f"""{ADJ}, s AS (SELECT conv_id AS query, concat('c:', CAST(1 + conv_id % (SELECT count(*) FROM customer) AS string)) AS node FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id < 50),
h1 AS (SELECT DISTINCT query, b AS node FROM s JOIN adj ON a = node), h2 AS (SELECT DISTINCT query, b AS node FROM h1 JOIN adj ON a = node),
w AS (SELECT query, node, 0 AS hop FROM s UNION ALL SELECT query, node, 1 FROM h1 UNION ALL SELECT query, node, 2 FROM h2)
SELECT query, node, min(hop) AS hop FROM w GROUP BY query, node"""
)
def walks_for_queries(spark, sf_dir):
    """Two hops around a customer for each of 50 conversations, in one pass over the edges a hop."""
    c = table(spark, sf_dir, "conversations").where("conv_id < 50").select("conv_id").distinct()
    n = table(spark, sf_dir, "customer").count()
    seeds = c.select(F.col("conv_id").alias("query"), F.concat(F.lit("c:"), (F.lit(1) + F.col("conv_id") % n).cast("string")).alias("node"))
    return graph.expand_many(fixture(spark, sf_dir).edges, seeds, 2)


LOCATED = """located AS (SELECT id FROM g_nodes WHERE type IN ('customer', 'supplier', 'nation')),
le AS (SELECT src AS a, dst AS b FROM g_edges WHERE type = 'located_in' UNION ALL SELECT dst, src FROM g_edges WHERE type = 'located_in'),
reach AS (SELECT id AS start, id FROM g_nodes WHERE type = 'nation' UNION SELECT reach.start, le.b FROM reach JOIN le ON le.a = reach.id),
comp0 AS (SELECT start, min(id) AS component FROM reach GROUP BY start),
comp AS (SELECT l.id, coalesce(c.component, l.id) AS component FROM located l LEFT JOIN reach r ON r.id = l.id LEFT JOIN comp0 c ON c.start = r.start),
sizes AS (SELECT component, count(*) AS member_count FROM comp GROUP BY component HAVING count(*) >= 3),
labels AS (SELECT component, member_count, concat('community_', CAST(row_number() OVER (ORDER BY member_count DESC, component) AS string)) AS label FROM sizes)"""


def _located(spark, sf_dir):
    g = fixture(spark, sf_dir)
    nodes = g.nodes.where(F.col("type").isin("customer", "supplier", "nation"))
    return nodes, community.components(nodes, g.edges.where(F.col("type") == "located_in"))


@query(f"{LOCATED} SELECT id, component FROM comp", recursive=True)
def components(spark, sf_dir):
    return _located(spark, sf_dir)[1].select("id", "component")


@query(f"{LOCATED} SELECT component, member_count, label FROM labels", recursive=True)
def community_sizes(spark, sf_dir):
    return community.sizes(_located(spark, sf_dir)[1], CONFIG.community_min_size)


@query(f"{LOCATED} SELECT n.id, n.name FROM labels l JOIN comp c ON c.component = l.component JOIN g_nodes n ON n.id = c.id WHERE l.label = 'community_1' ORDER BY n.name, n.id", recursive=True)
def community_members(spark, sf_dir):
    nodes, found = _located(spark, sf_dir)
    members = found.join(community.sizes(found, CONFIG.community_min_size), "component").select(F.col("label").alias("community_id"), F.col("id").alias("node_id"))
    return community.members_of("community_1", members, nodes).select("id", "name")


@query(f"{LOCATED} SELECT label AS id, member_count FROM labels ORDER BY member_count DESC, label LIMIT 7 OFFSET 3", recursive=True)
def community_page(spark, sf_dir):
    found = community.sizes(_located(spark, sf_dir)[1], CONFIG.community_min_size)
    pages = found.select(F.col("label").alias("id"), "member_count", F.lit(0).alias("created_at"))
    return tables.list_communities(pages, limit=7, offset=3).select("id", "member_count")


@query("SELECT id, node_id FROM (SELECT concat('doc ', CAST(doc_id AS string)) AS id, concat('d:', CAST(doc_id AS string)) AS node_id, doc_id % 9 AS created_at FROM documents) ORDER BY created_at DESC, id LIMIT 30 OFFSET 11")
def document_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("node_id"), (F.col("doc_id") % 9).alias("created_at"))
    return tables.list_documents(d, limit=30, offset=11).select("id", "node_id")


@query("SELECT e.id FROM g_edges e JOIN g_nodes s ON s.id = e.src JOIN g_nodes d ON d.id = e.dst WHERE e.type <> 'mentions' AND s.type NOT IN ('document', 'community') AND d.type NOT IN ('document', 'community')")
def entity_edges(spark, sf_dir):
    g = fixture(spark, sf_dir)
    return community.entity_edges(g.nodes, g.edges).select("id")


@query(f"{ADJ}, n AS (SELECT a AS node, count(*) AS degree FROM adj GROUP BY a) SELECT n.node, n.degree FROM n")
def degrees(spark, sf_dir):
    return graph.adjacency(fixture(spark, sf_dir).edges).groupBy("node").agg(F.count("*").alias("degree"))


@query("SELECT id, CASE WHEN src = 'n:3' THEN dst WHEN dst = 'n:3' THEN src END AS other FROM g_edges WHERE type IN ('located_in', 'in_region')")
def other_ends(spark, sf_dir):
    e = graph.edge_filter(fixture(spark, sf_dir).edges, ["located_in", "in_region"])
    return e.select("id", graph.other_endpoint(F.lit("n:3")).alias("other"))


@query(f"{WALK}, inner_ AS (SELECT id FROM w WHERE hop < 2) SELECT id, src, dst, type FROM g_edges WHERE src IN (SELECT id FROM inner_) OR dst IN (SELECT id FROM inner_)")
def subgraph_edges(spark, sf_dir):
    g = fixture(spark, sf_dir)
    return graph.neighbors(g.nodes, g.edges, "c:1", "both", None, 2).edges.select("id", "src", "dst", "type")


@query(
    f"""{LOCATED},
m AS (SELECT c.component, n.name, n.type, row_number() OVER (PARTITION BY c.component ORDER BY n.name, n.id) AS r FROM comp c JOIN g_nodes n ON n.id = c.id),
ml AS (SELECT component, string_agg(concat('- ', name, ' (', type, ')'), chr(10) ORDER BY r) AS t FROM m WHERE r <= 40 GROUP BY component),
e AS (SELECT a.component, concat('- ', s.name, ' -[', g.type, ']-> ', d.name) AS rel, row_number() OVER (PARTITION BY a.component ORDER BY g.id) AS r
      FROM g_edges g JOIN comp a ON a.id = g.src JOIN g_nodes s ON s.id = g.src JOIN g_nodes d ON d.id = g.dst WHERE g.type = 'located_in'),
el AS (SELECT component, string_agg(rel, chr(10) ORDER BY r) AS t FROM e WHERE r <= 40 GROUP BY component)
SELECT ml.component, concat('Entities:', chr(10), ml.t, chr(10), chr(10), 'Relationships:', chr(10), coalesce(el.t, '(none)')) AS prompt FROM ml LEFT JOIN el ON el.component = ml.component""",
    recursive=True,
)
def community_prompts(spark, sf_dir):
    g = fixture(spark, sf_dir)
    nodes, found = _located(spark, sf_dir)
    return community.prompts(found, nodes, g.edges.where(F.col("type") == "located_in"))


@query(
    """c AS (SELECT node_id, count(*) AS n FROM g_chunks GROUP BY node_id), m AS (SELECT src, count(*) AS n FROM g_edges WHERE type = 'mentions' GROUP BY src)
SELECT d.doc_id AS id, coalesce(c.n, 0) AS chunk_count, coalesce(m.n, 0) AS mention_count FROM documents d
LEFT JOIN c ON c.node_id = concat('d:', CAST(d.doc_id AS string)) LEFT JOIN m ON m.src = concat('d:', CAST(d.doc_id AS string))"""
)
def document_counts(spark, sf_dir):
    g = fixture(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("node_id"))
    return tables.document_counts(docs, g.chunks, g.edges).select("id", "chunk_count", "mention_count")


@query(
    """WITH n AS (SELECT c_custkey, concat('  ', upper(c_name), chr(160), ' Of-The ', c_mktsegment, '  ') AS raw FROM customer),
w AS (SELECT c_custkey, trim(regexp_replace(replace(raw, chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM n)
SELECT c_custkey, lower(t) AS name_norm, t AS name_clean, translate(lower(trim(replace(raw, chr(160), ' '))), ' -', '__') AS type_norm_ascii,
       regexp_replace(translate(lower(t), ' -', '__'), '[^a-z0-9_]+', '', 'g') AS type_clean FROM n JOIN w USING (c_custkey)""",
    graph_ctes=False,
)
def normalize_names(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper("c_name"), F.lit("\xa0 Of-The "), "c_mktsegment", F.lit("  "))
    c = table(spark, sf_dir, "customer").withColumn("raw", raw)
    single = F.regexp_replace(F.col("raw"), r"(?U)\s+", " ")
    return c.select(
        "c_custkey", X.normalize_name(F.col("raw")).alias("name_norm"), X.clean_name(F.col("raw")).alias("name_clean"),
        X.normalize_type(F.translate("raw", "\xa0", " ")).alias("type_norm_ascii"), X.clean_type(single).alias("type_clean"),
    )


@query(
    """WITH n AS (SELECT p_partkey, lower(trim(regexp_replace(concat(p_name, ' by ', p_brand, ' ', p_type), '\\s+', ' ', 'g'))) AS q FROM part),
t AS (SELECT p_partkey, q, regexp_extract_all(q, '[a-z0-9][a-z0-9._-]{1,}') AS t FROM n),
p AS (SELECT p_partkey, q AS phrase FROM t UNION SELECT p_partkey, unnest(t) FROM t UNION SELECT p_partkey, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1]))) FROM t)
SELECT p_partkey, phrase FROM p WHERE phrase <> ''""",
    graph_ctes=False,
)
def query_phrases(spark, sf_dir):
    q = F.concat("p_name", F.lit(" by "), "p_brand", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.phrases(q)).alias("phrase"))


_THEMES = " OR ".join(f"contains(lower(text), '{k}')" for k in X.THEMATIC)


@query(f"SELECT conv_id, turn, ({_THEMES}) AS thematic FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat(text, ' High-Level view') ELSE text END AS text FROM conversations)", graph_ctes=False)
def thematic_flag(spark, sf_dir):
    t = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" High-Level view"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.thematic(t).alias("thematic"))


ASKED = "Customer#000000001 and NATION_3"
_SAID = "('customer#000000001 and nation_3', 'customer', '000000001', 'and', 'nation_3', 'customer 000000001', '000000001 and', 'and nation_3')"
NAMED = "Works 2, land 14 and works 13 of supplier#000000002"
_SAID_NAMED = "('works 2, land 14 and works 13 of supplier#000000002', 'land', '14', 'and', 'works', '13', 'of', 'supplier', '000000002', 'works land', 'land 14', '14 and', 'and works', 'works 13', '13 of', 'of supplier', 'supplier 000000002')"
SEEDS = f"""{Q0},
en AS (SELECT id, type, name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS nn FROM g_nodes WHERE type NOT IN ('document', 'community')),
byname AS (SELECT id AS node_id, CASE WHEN nn IN {_SAID} THEN 1.0 WHEN length(nn) >= 3 AND contains('customer#000000001 and nation_3', nn) THEN 0.9 END AS score, 0 AS p FROM en),
desc_top AS (SELECT c.node_id, {COS} AS score FROM g_chunks c JOIN en ON en.id = c.node_id, q WHERE c.kind = 'entity_description' ORDER BY score DESC, c.id LIMIT 10),
cand AS (SELECT node_id, CAST(score AS DOUBLE) AS score, p FROM byname WHERE score IS NOT NULL UNION ALL SELECT node_id, score, 1 FROM desc_top WHERE score >= 0.3),
one AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, p) AS r FROM cand),
seeds AS (SELECT node_id, score, CASE WHEN p = 0 THEN 'exact' ELSE 'embedding' END AS "match" FROM one WHERE r = 1 ORDER BY score DESC, node_id LIMIT 5)"""
LOW = EngineConfig(dim=64, auto_entity_score_threshold=0.3)


@query(f'{SEEDS} SELECT node_id, round(score, 6) AS score, "match" FROM seeds')
def entity_seeds(spark, sf_dir):
    s = retrieval.entity_seeds(fixture(spark, sf_dir), ASKED, query_vector(spark, sf_dir), LOW)
    return s.select("node_id", r6("score").alias("score"), "match")


@query(
    f"""en AS (SELECT id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS own, lower(trim(normalized_name)) AS stored, list_transform(aliases, lambda a: lower(trim(a))) AS aliases FROM g_nodes WHERE type NOT IN ('document', 'community')),
s AS (SELECT id AS node_id, CASE WHEN own IN {_SAID_NAMED} OR stored IN {_SAID_NAMED} THEN 1.0 WHEN list_has_any(aliases, list_value{_SAID_NAMED}) THEN 0.95
  WHEN length(own) >= 3 AND contains('{NAMED.lower()}', own) THEN 0.9 END AS score FROM en)
SELECT node_id, CAST(score AS DOUBLE) AS score, CASE WHEN score = 0.95 THEN 'alias' ELSE 'exact' END AS "match" FROM s WHERE score IS NOT NULL"""
)
def seeds_by_name(spark, sf_dir):
    return retrieval.seeds_by_name(fixture(spark, sf_dir).nodes, NAMED)


@query(
    """u AS (SELECT concat(conv_id, ':', turn) AS query_id, lower(trim(regexp_replace(concat(text, ' on customer#', lpad(CAST(conv_id AS string), 9, '0'), 'x, Works ', turn, ' and land ', conv_id % 30), '\\s+', ' ', 'g'))) AS q FROM conversations),
t AS (SELECT query_id, q, regexp_extract_all(q, '[a-z0-9][a-z0-9._-]{1,}') AS t FROM u),
ph AS (SELECT query_id, q AS p FROM t UNION SELECT query_id, unnest(t) FROM t UNION SELECT query_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1]))) FROM t),
en AS (SELECT id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS own, coalesce(lower(trim(nullif(normalized_name, ''))), lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))) AS stored, list_transform(aliases, lambda a: lower(trim(a))) AS aliases FROM g_nodes WHERE type NOT IN ('document', 'community')),
m AS (SELECT query_id, id, 1.0 AS s FROM ph JOIN en ON p = own UNION ALL SELECT query_id, id, 1.0 FROM ph JOIN en ON p = stored
UNION ALL SELECT query_id, id, 0.95 FROM ph JOIN (SELECT id, unnest(aliases) AS a FROM en) ON p = a UNION ALL SELECT query_id, id, 0.9 FROM u JOIN en ON length(own) >= 3 AND contains(q, own))
SELECT query_id, id AS node_id, CAST(max(s) AS DOUBLE) AS score, CASE WHEN max(s) = 0.95 THEN 'alias' ELSE 'exact' END AS "match" FROM m GROUP BY query_id, id"""
)
def seeds_for_queries(spark, sf_dir):
    """The entities that each turn of the conversations names."""
    c = table(spark, sf_dir, "conversations")
    number = F.lpad(F.col("conv_id").cast("string"), 9, "0")
    text = F.concat("text", F.lit(" on customer#"), number, F.lit("x, Works "), F.col("turn").cast("string"), F.lit(" and land "), (F.col("conv_id") % 30).cast("string"))
    return retrieval.seeds_for_queries(fixture(spark, sf_dir).nodes, c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("query_id"), text.alias("text")))


@query(
    """WITH s AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 1200) / 1000.0) AS BIGINT)))) AS ord FROM s)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(ord * 1000 AS INTEGER) AS char_start, CAST(least(ord * 1000 + 1200, n) AS INTEGER) AS char_end, md5(substring(text, ord * 1000 + 1, 1200)) AS text_md5 FROM w""",
    graph_ctes=False,
)
def hard_split_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.hard_split(F.col("text"), 1200, 200)).alias("w"))
    return d.select("doc_id", "w.ord", "w.char_start", "w.char_end", F.md5("w.text").alias("text_md5"))


def _conversations(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


@query(
    """WITH p AS (SELECT conv_id, list(trim(text, chr(10) || chr(13) || ' ') ORDER BY turn) AS ps FROM conversations WHERE trim(text) <> '' GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(ps, lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1][1]) + 2 + length(x) <= 4000 THEN list_concat(acc[:-2], [[acc[-1][1] || chr(10) || chr(10) || x]])
  ELSE list_concat(acc, [[x]]) END, CAST([] AS VARCHAR[][])) AS ws FROM (SELECT conv_id, list_transform(ps, lambda x: x) AS ps FROM p))
SELECT conv_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS ord, md5(unnest(ws)[1]) AS text_md5 FROM f""",
    graph_ctes=False,
)
def chunk_packed(spark, sf_dir):
    chunks = chunking.chunk_documents(_conversations(spark, sf_dir), "conv_id", "text", 4000, 0)
    return chunks.select("conv_id", "ord", F.md5("text").alias("text_md5"))


@query(
    """WITH p AS (SELECT conv_id, list(trim(text, chr(10) || chr(13) || ' ') ORDER BY turn) AS ps FROM conversations WHERE trim(text) <> '' GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(ps, lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1][1]) + 2 + length(x) <= 4000 THEN list_concat(acc[:-2], [[acc[-1][1] || chr(10) || chr(10) || x]])
  ELSE list_concat(acc, [[x]]) END, CAST([] AS VARCHAR[][])) AS ws FROM p),
o AS (SELECT conv_id, list_reduce(ws, lambda acc, x: list_concat(acc, [[CASE WHEN len(acc) = 0 OR starts_with(x[1], right(acc[-1][1], 200)) THEN x[1] ELSE right(acc[-1][1], 200) || chr(10) || chr(10) || x[1] END]]), CAST([] AS VARCHAR[][])) AS cs FROM f)
SELECT conv_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS ord, md5(unnest(cs)[1]) AS text_md5 FROM o""",
    graph_ctes=False,
)
def chunk_overlapped(spark, sf_dir):
    chunks = chunking.chunk_documents(_conversations(spark, sf_dir), "conv_id", "text", 4000, 200)
    return chunks.select("conv_id", "ord", F.md5("text").alias("text_md5"))


def _replies(spark, sf_dir):
    """A model's replies made from parts: plain, fenced, with text around, and broken."""
    p = table(spark, sf_dir, "part")
    entity = lambda name, kind, text: F.struct(name.alias("name"), kind.alias("type"), text.alias("description"))
    entities = F.array(entity(F.concat(F.lit("  "), "p_name", F.lit("  ")), F.col("p_type"), F.concat(F.lit("made by "), "p_brand")), entity(F.col("p_brand"), F.lit("Brand-Name"), F.lit(None).cast("string")), entity(F.lit(" "), F.lit("x"), F.lit("")))
    link = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), kind.alias("type"), F.lit("").alias("description"))
    links = F.array(link(F.col("p_name"), F.col("p_brand"), F.lit("Made By")), link(F.col("p_brand"), F.lower("p_brand"), F.lit("same")), link(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string")))
    json = F.to_json(F.struct(entities.alias("entities"), links.alias("relationships")))
    k = F.col("p_partkey") % 4
    return p.select("p_partkey", "p_name", "p_type", "p_brand", F.when(k == 0, json).when(k == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here you are: "), json, F.lit(" Done."))).otherwise(F.substring(json, 1, 20)).alias("raw"))


@query(
    """WITH k AS (SELECT *, p_partkey % 4 AS k FROM part)
SELECT p_partkey, 'entity' AS item, p_name AS a, '' AS b, lower(p_type) AS type, concat('made by ', p_brand) AS description FROM k WHERE k < 3
UNION ALL SELECT p_partkey, 'entity', p_brand, '', 'brand_name', '' FROM k WHERE k < 3
UNION ALL SELECT p_partkey, 'relation', p_name, p_brand, 'made_by', '' FROM k WHERE k < 3
UNION ALL SELECT p_partkey, 'relation', p_brand, p_name, 'related_to', '' FROM k WHERE k < 3
UNION ALL SELECT p_partkey, 'invalid', '', '', '', '' FROM k WHERE k = 3""",
    graph_ctes=False,
)
def parse_extraction(spark, sf_dir):
    x = extraction.parse(_replies(spark, sf_dir).select("p_partkey", "raw"))
    row = lambda item, a, b, kind, text: F.struct(item.alias("item"), a.alias("a"), b.alias("b"), kind.alias("type"), text.alias("description"))
    none = F.lit("")
    entities = F.transform("entities", lambda e: row(F.lit("entity"), e["name"], none, e["type"], e["description"]))
    relations = F.transform("relationships", lambda r: row(F.lit("relation"), r["source"], r["target"], r["type"], r["description"]))
    bad = F.array(row(F.col("status"), none, none, none, none))
    return x.select("p_partkey", F.inline(F.when(F.col("status") == "ok", F.concat(entities, relations)).otherwise(bad)))


def _mentions(spark, sf_dir):
    """Mentions of parts in two spellings, eight to a document."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    return p.select((F.col("p_partkey") / 8).cast("long").alias("doc_id"), F.lit(0).alias("ord"), (F.col("p_partkey") % 8).cast("int").alias("item"), name.alias("name"), F.col("p_type").alias("type"), F.concat(F.lit("seen as "), "p_brand").alias("description"))


_MENTIONS = """m AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') ELSE p_name END AS name,
  lower(p_type) AS type, lower(p_name) AS nn, concat('seen as ', p_brand) AS description FROM part)"""


@query(
    f"""WITH {_MENTIONS}, f AS (SELECT type, nn, name, min(place) AS place FROM m GROUP BY type, nn, name)
SELECT type, nn AS normalized_name, arg_min(name, place) AS name, string_agg(name, '|' ORDER BY place) AS aliases FROM f GROUP BY type, nn""",
    graph_ctes=False,
)
def resolve_entities(spark, sf_dir):
    return resolution.resolve(_mentions(spark, sf_dir), describe=False).select("type", "normalized_name", "name", F.array_join("aliases", "|").alias("aliases"))


@query(
    f"""WITH {_MENTIONS}, f AS (SELECT type, nn, description, min(place) AS place FROM m GROUP BY type, nn, description), l AS (SELECT type, nn, list(description ORDER BY place) AS ds FROM f GROUP BY type, nn)
SELECT type, nn AS normalized_name, list_reduce(ds, lambda acc, d: CASE WHEN contains(acc, d) THEN acc ELSE concat(acc, chr(10), d) END) AS description FROM l""",
    graph_ctes=False,
)
def merge_descriptions(spark, sf_dir):
    return resolution.resolve(_mentions(spark, sf_dir)).select("type", "normalized_name", "description")


HYBRID = f"""{Q0}, {ADJ},
seed AS (SELECT c.id, c.node_id, {COS} AS score FROM g_chunks c JOIN g_nodes n ON n.id = c.node_id, q ORDER BY score DESC, c.id LIMIT 8),
base AS (SELECT max(score) AS b FROM seed), f0 AS (SELECT DISTINCT node_id AS id FROM seed),
f1 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM f0) AND b NOT IN (SELECT id FROM f0)),
f2 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM f1) AND b NOT IN (SELECT id FROM f0) AND b NOT IN (SELECT id FROM f1)),
hits AS (SELECT id, node_id, score, 0 AS hop FROM seed UNION ALL SELECT c.id, c.node_id, b * 0.5, 1 FROM g_chunks c JOIN f1 ON f1.id = c.node_id, base
  UNION ALL SELECT c.id, c.node_id, b * 0.25, 2 FROM g_chunks c JOIN f2 ON f2.id = c.node_id, base)"""


@query(f"{HYBRID} SELECT h.id, h.node_id, n.name AS node_name, n.type AS node_type, round(h.score, 6) AS score, h.hop FROM hits h JOIN g_nodes n ON n.id = h.node_id")
def hybrid_search(spark, sf_dir):
    r = retrieval.hybrid(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG, 8, None, 2)
    return r.hits.select("id", "node_id", "node_name", "node_type", r6("score").alias("score"), "hop")


@query(f"{Q0} SELECT c.id, c.node_id, round({COS}, 6) AS score FROM g_chunks c JOIN g_nodes n ON n.id = c.node_id, q WHERE n.type = 'community' OR c.kind = 'community_summary' ORDER BY {COS} DESC, c.id LIMIT 6")
def global_search(spark, sf_dir):
    return retrieval.global_(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG).hits.select("id", "node_id", r6("score").alias("score"))


LOCAL = f"""{SEEDS},
la AS (SELECT src AS a, dst AS b FROM g_edges WHERE type <> 'mentions' UNION ALL SELECT dst, src FROM g_edges WHERE type <> 'mentions'),
v0 AS (SELECT node_id AS id FROM seeds), v1 AS (SELECT DISTINCT b AS id FROM la WHERE a IN (SELECT id FROM v0) AND b NOT IN (SELECT id FROM v0)),
ent AS (SELECT x.id, x.hop FROM (SELECT id, 0 AS hop FROM v0 UNION ALL SELECT id, 1 FROM v1) x JOIN g_nodes n ON n.id = x.id WHERE n.type NOT IN ('document', 'community')),
mx AS (SELECT max(score) AS b FROM seeds),
ev AS (SELECT DISTINCT src AS id FROM g_edges WHERE type = 'mentions' AND dst IN (SELECT id FROM ent)),
ci AS (SELECT DISTINCT chunk_id AS id FROM g_edges WHERE type = 'mentions' AND dst IN (SELECT id FROM ent) AND chunk_id <> ''),
lh AS (SELECT c.id, c.node_id, coalesce(s.score, b) * pow(0.5, ent.hop) * CASE WHEN c.kind = 'entity_description' THEN 1.05 ELSE 1 END AS score, ent.hop, 0 AS phase
  FROM g_chunks c JOIN ent ON ent.id = c.node_id LEFT JOIN seeds s ON s.node_id = c.node_id, mx
  UNION ALL SELECT c.id, c.node_id, b * 0.5, 1, 1 FROM g_chunks c JOIN ci ON ci.id = c.id, mx WHERE c.node_id IN (SELECT id FROM ent) OR c.node_id IN (SELECT id FROM ev)
  UNION ALL SELECT c.id, c.node_id, b * 0.5, 1, 2 FROM g_chunks c JOIN ev ON ev.id = c.node_id, mx),
lb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phase) AS r FROM lh)"""


@query(f"{LOCAL} SELECT id, node_id, round(score, 6) AS score, hop, phase FROM lb WHERE r = 1 ORDER BY lb.score DESC, phase, hop, id LIMIT 20")
def local_search(spark, sf_dir):
    r = retrieval.local(fixture(spark, sf_dir), ASKED, query_vector(spark, sf_dir), LOW, 20, 1)
    return r.hits.select("id", "node_id", r6("score").alias("score"), "hop", "phase")


@query(
    f"""WITH t AS (SELECT conv_id, turn, conv_id % 2 = 0 AS strong, conv_id % 5 < 3 AS communities, ({_THEMES}) AS thematic FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(text, ' in general') ELSE text END AS text FROM conversations))
SELECT conv_id, turn, CASE WHEN strong AND NOT thematic THEN 'local' WHEN communities AND (thematic OR NOT strong) THEN 'global' ELSE 'hybrid' END AS mode FROM t""",
    graph_ctes=False,
)
def mode_routing(spark, sf_dir):
    t = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" in general"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.choose_mode(F.col("conv_id") % 2 == 0, X.thematic(t), F.col("conv_id") % 5 < 3).alias("mode"))


@query(
    f"""{HYBRID},
blocks AS (SELECT row_number() OVER (ORDER BY h.score DESC, h.hop, h.id) AS rank, concat('[node:', n.name, '|', n.type, '|chunk:', h.id, ']', chr(10), c.text) AS block FROM hits h JOIN g_nodes n ON n.id = h.node_id JOIN g_chunks c ON c.id = h.id),
cum AS (SELECT *, sum(length(block)) OVER (ORDER BY rank) AS total FROM blocks)
SELECT string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM cum WHERE total <= 4 * 300 OR rank = 1"""
)
def pack_context(spark, sf_dir):
    r = retrieval.hybrid(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG, 8, None, 2)
    return retrieval.pack_context(r.hits, 300)


@query(f"{HYBRID} SELECT h.id, h.node_id, n.name AS node_name, round(h.score, 6) AS score, substring(c.text, 1, 280) AS excerpt FROM hits h JOIN g_nodes n ON n.id = h.node_id JOIN g_chunks c ON c.id = h.id ORDER BY h.score DESC, h.hop, h.id LIMIT 8")
def qa_sources(spark, sf_dir):
    r = retrieval.hybrid(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG, 8, None, 2)
    return retrieval.sources(r.hits, 8).withColumn("score", r6("score"))


@query(f"{HYBRID}, s AS (SELECT greatest(0.0, least(1.0, score)) AS s FROM hits ORDER BY score DESC, hop, id LIMIT 8) SELECT round(0.65 * max(s) + 0.35 * avg(s), 3) AS confidence FROM s")
def qa_confidence(spark, sf_dir):
    r = retrieval.hybrid(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG, 8, None, 2)
    return retrieval.confidence(r.hits, CONFIG.retrieval_top_k)


QUESTIONS = {1: ASKED, 2: "an overview of the corpus", 3: "what is new"}


@query(
    f"""{Q0}, en AS (SELECT id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS nn FROM g_nodes WHERE type NOT IN ('document', 'community')),
near AS (SELECT coalesce(max({COS}), 0) >= 0.55 AS strong FROM g_chunks c JOIN en ON en.id = c.node_id, q WHERE c.kind = 'entity_description'),
named AS (SELECT count(*) > 0 AS strong FROM en WHERE nn IN {_SAID}), k AS (SELECT count(*) > 0 AS communities FROM g_nodes WHERE type = 'community'),
t(question, thematic) AS (VALUES (1, false), (2, true), (3, false)), s AS (SELECT question, thematic, near.strong OR (question = 1 AND named.strong) AS strong, communities FROM t, near, named, k)
SELECT question, CASE WHEN strong AND NOT thematic THEN 'local' WHEN communities AND (thematic OR NOT strong) THEN 'global' ELSE 'hybrid' END AS mode FROM s"""
)
def mode_resolved(spark, sf_dir):
    """The mode that the graph gives each of three questions."""
    g, v, modes = fixture(spark, sf_dir), query_vector(spark, sf_dir), []
    for i, question in QUESTIONS.items():
        modes.append((i, retrieval.resolve_mode(g, question, v, CONFIG)))
    return spark.createDataFrame(modes, "question int, mode string")


@query(f"{LOCAL} SELECT 'local' AS mode, lb.id AS chunk_id, node_id, n.name AS node_name, n.type AS node_type, md5(c.text) AS text_md5, round(score, 6) AS score, hop FROM lb JOIN g_nodes n ON n.id = lb.node_id JOIN g_chunks c USING (id) WHERE r = 1 ORDER BY lb.score DESC, phase, hop, lb.id LIMIT 20".replace("n.id = lb.node_id JOIN g_chunks c USING (id)", "n.id = lb.node_id JOIN (SELECT id AS cid, text FROM g_chunks) AS c ON c.cid = lb.id"))
def search_auto(spark, sf_dir):
    """A search in automatic mode, as its caller sees it."""
    found = retrieval.response(retrieval.search(fixture(spark, sf_dir), ASKED, query_vector(spark, sf_dir), LOW, "auto", 20))
    return found.hits.select(F.lit(found.mode_used).alias("mode"), "chunk_id", "node_id", "node_name", "node_type", F.md5("text").alias("text_md5"), r6("score").alias("score"), "hop")


def _refuses(system: str, user: str) -> str:
    raise Upstream("no model today")


@query(
    f"""{HYBRID}, top AS (SELECT greatest(0.0, least(1.0, score)) AS s FROM hits ORDER BY score DESC, hop, id LIMIT 8), sure AS (SELECT round(0.65 * max(s) + 0.35 * avg(s), 3) AS confidence, count(*) AS n FROM top),
blocks AS (SELECT row_number() OVER (ORDER BY h.score DESC, h.hop, h.id) AS rank, concat('[node:', n.name, '|', n.type, '|chunk:', h.id, ']', chr(10), c.text) AS block FROM hits h JOIN g_nodes n ON n.id = h.node_id JOIN g_chunks c ON c.id = h.id),
cum AS (SELECT *, sum(length(block)) OVER (ORDER BY rank) AS total FROM blocks), ctx AS (SELECT string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM cum WHERE total <= 4 * 4000 OR rank = 1)
SELECT 'answered' AS what, concat('answer:', length(concat('Context:', chr(10), context, chr(10), chr(10), 'Question: why', chr(10), chr(10), 'Answer:'))) AS answer, 'hybrid' AS mode, confidence, NULL AS error, n AS sources FROM ctx, sure
UNION ALL SELECT 'no model', '{qa.NO_GENERATION}', 'hybrid', confidence, 'no model today', n FROM sure
UNION ALL SELECT 'no hits', '{qa.NO_CONTEXT}', 'hybrid', NULL, NULL, 0"""
)
def qa_answers(spark, sf_dir):
    """An answer, one without a model and one without hits."""
    g, v = fixture(spark, sf_dir), query_vector(spark, sf_dir)
    cases = (("answered", EchoLanguage(), None), ("no model", EchoLanguage(_refuses), None), ("no hits", EchoLanguage(_refuses), ["nothing"]))
    rows = []
    for what, model, types in cases:
        a = qa.ask(g, "why", v, model, CONFIG, "hybrid", 8, hops=2, node_types=types)
        rows.append((what, a.answer, a.mode, a.confidence, a.error, len(a.sources)))
    return spark.createDataFrame(rows, "what string, answer string, mode string, confidence double, error string, sources long")


def _map_reply(system: str, user: str) -> str:
    return " no_info " if len(user) % 3 == 0 else f" {user.splitlines()[0].upper()} in {len(user)} characters"


@query(
    f"""{Q0}, gh AS (SELECT c.id, n.name, c.text, {COS} AS score FROM g_chunks c JOIN g_nodes n ON n.id = c.node_id, q WHERE n.type = 'community' OR c.kind = 'community_summary' ORDER BY score DESC, c.id LIMIT 20),
u AS (SELECT *, concat('Community: ', name, chr(10), 'Summary:', chr(10), text, chr(10), chr(10), 'Question: what', chr(10), chr(10), 'Partial answer:') AS prompt FROM gh),
m AS (SELECT *, concat('COMMUNITY: ', upper(name), ' in ', CAST(length(prompt) AS string), ' characters') AS reply FROM u WHERE length(prompt) % 3 <> 0)
SELECT concat('Question: what', chr(10), chr(10), 'Partial answers:', chr(10), string_agg(concat('[', name, ']', chr(10), reply), chr(10) || chr(10) ORDER BY score DESC, id), chr(10), chr(10), 'Final answer:') AS prompt, CAST(NULL AS string) AS error FROM m"""
)
def map_reduce_partials(spark, sf_dir):
    hits = retrieval.global_(fixture(spark, sf_dir), query_vector(spark, sf_dir), CONFIG, 20).hits
    return qa.reduce_prompt(qa.map_partials(hits, "what", EchoLanguage(_map_reply), CONFIG), "what")


def _extracted(spark, sf_dir):
    """The replies as extractions of chunks, eight to a document; written, as what follows refers to them often."""
    key = F.col("p_partkey")
    rows = _replies(spark, sf_dir).where(key % 4 < 3).select(F.concat(F.lit("x"), key.cast("string")).alias("id"), F.concat(F.lit("d"), (key / 8).cast("long").cast("string")).alias("node_id"), (key % 8).cast("int").alias("ord"), "raw")
    return materialize(extraction.parse(rows, strict=True).drop("raw"), "extracted")


_PARTS = "k AS (SELECT p_partkey // 8 AS doc, lower(p_type) AS t, lower(p_name) AS n, lower(p_brand) AS b FROM part WHERE p_partkey % 4 < 3)"


@query(
    f"""WITH {_PARTS}
SELECT 2 * (SELECT count(*) FROM k) AS entities, (SELECT count(*) FROM (SELECT DISTINCT doc, t, n FROM k)) + (SELECT count(*) FROM (SELECT DISTINCT doc, b FROM k)) AS mentions,
       2 * (SELECT count(*) FROM (SELECT DISTINCT t, n, b FROM k)) AS relationships, (SELECT count(*) FROM (SELECT DISTINCT t, n FROM k)) AS description_chunks""",
    graph_ctes=False,
)
def ingest_totals(spark, sf_dir):
    x = _extracted(spark, sf_dir)
    named = ingest.mentions(x)
    nodes = materialize(resolution.resolve(named), "entities")
    none = spark.createDataFrame([], "id string, node_id string, kind string, text string")
    return ingest.totals(x, resolution.mention_edges(named, nodes), resolution.relation_edges(ingest.relations(x), named, nodes), resolution.description_chunks(nodes, none))


@query(f"WITH {_PARTS}, d AS (SELECT DISTINCT t, n FROM k) SELECT t AS type, n AS normalized_name, length(n) % 2 = 0 AS stale FROM d WHERE length(n) % 3 > 0", graph_ctes=False)
def description_chunks(spark, sf_dir):
    """Every third node has the chunk that it needs, and every second of the others an old one."""
    nodes = materialize(resolution.resolve(ingest.mentions(_extracted(spark, sf_dir))), "entities")
    n = F.length("normalized_name")
    text = F.when(n % 3 == 0, F.trim("description")).when(n % 2 == 0, F.lit("old"))
    chunks = nodes.select(F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("node_id"), F.lit("entity_description").alias("kind"), text.alias("text")).where(F.col("text").isNotNull())
    due = resolution.description_chunks(nodes, chunks)
    return due.join(nodes.select(F.col("id").alias("node_id"), "type", "normalized_name"), "node_id").select("type", "normalized_name", "stale")


@query(
    f"""WITH {_MENTIONS} SELECT concat('d', CAST(place // 8 AS string)) AS src, concat(type, ':', nn) AS dst, arg_max(concat('x', CAST(place AS string)), place) AS chunk_id FROM m GROUP BY place // 8, type, nn""",
    graph_ctes=False,
)
def mention_edges(spark, sf_dir):
    place = (F.col("doc_id") * 8 + F.col("item")).cast("string")
    m = _mentions(spark, sf_dir).withColumns({"document_node_id": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "chunk_id": F.concat(F.lit("x"), place)})
    nodes = resolution.resolve(m, describe=False).select("id", "type", "normalized_name")
    e = resolution.mention_edges(m, nodes)
    return e.join(nodes.select(F.col("id").alias("dst"), F.concat_ws(":", "type", "normalized_name").alias("name")), "dst").select("src", F.col("name").alias("dst"), "chunk_id")


@query(
    """l AS (SELECT * FROM g_edges WHERE type = 'located_in')
SELECT id, src, dst, type, 'old' AS chunk_id, CASE WHEN src LIKE 'c:%' THEN concat('near ', dst) END AS description, false AS created FROM l
UNION ALL SELECT concat('back ', id), dst, src, type, 'new', NULL, true FROM l WHERE src LIKE 's:%'"""
)
def merge_edges(spark, sf_dir):
    located = fixture(spark, sf_dir).edges.where(F.col("type") == "located_in")
    stored = located.withColumns({"chunk_id": F.lit("old"), "description": F.lit(None).cast("string")})
    again = located.where(F.col("src").startswith("c:")).select(F.concat(F.lit("again "), "id").alias("id"), "src", "dst", "type", F.lit("").alias("chunk_id"), F.concat(F.lit("near "), "dst").alias("description"))
    back = located.where(F.col("src").startswith("s:")).select(F.concat(F.lit("back "), "id").alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit("new").alias("chunk_id"), F.lit(None).cast("string").alias("description"))
    return resolution.merge_edges(stored, again.unionByName(back)).select("id", "src", "dst", "type", "chunk_id", "description", "created")


@query(
    f"""WITH {_MENTIONS}, f AS (SELECT type, nn, name, min(place) AS place FROM m GROUP BY type, nn, name), a AS (SELECT type, nn, arg_min(name, place) AS first, string_agg(name, '|' ORDER BY place) AS names FROM f GROUP BY type, nn)
SELECT type, nn AS normalized_name, CASE WHEN length(nn) % 2 = 0 THEN concat('old:', type, ':', nn) ELSE 'new' END AS id, CASE WHEN length(nn) % 2 = 0 THEN upper(nn) ELSE first END AS name,
       CASE WHEN length(nn) % 2 = 0 THEN concat(upper(nn), '|', names) ELSE names END AS aliases, length(nn) % 2 = 1 AS created FROM a""",
    graph_ctes=False,
)
def resolve_existing(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    name = X.normalize_name(F.col("name"))
    old = m.select(X.normalize_type(F.col("type")).alias("type"), name.alias("normalized_name")).distinct().where(F.length("normalized_name") % 2 == 0)
    old = old.select(F.concat_ws(":", F.lit("old"), "type", "normalized_name").alias("id"), "type", F.upper("normalized_name").alias("name"), "normalized_name", F.array(F.upper("normalized_name")).alias("aliases"), F.lit("known").alias("description"))
    got = resolution.resolve(m, old)
    return got.select("type", "normalized_name", F.when(F.col("created"), "new").otherwise(F.col("id")).alias("id"), "name", F.array_join("aliases", "|").alias("aliases"), "created")


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_custkey % 8 AS k FROM customer)
SELECT CASE WHEN k IN (0, 7) THEN c_custkey END AS id, CASE WHEN k IN (0, 7) THEN c_name END AS name, CASE WHEN k = 7 THEN 3 END AS top_k,
  CASE k WHEN 0 THEN '' WHEN 7 THEN '' WHEN 1 THEN 'the body is not an object' WHEN 2 THEN 'id is not a long' WHEN 3 THEN 'name is not a string' WHEN 4 THEN 'id is not a long|name is missing'
    WHEN 5 THEN 'name is out of range|top_k is out of range' WHEN 6 THEN 'the body is not an object' END AS reasons,
  CASE k WHEN 1 THEN concat('bad ', c_name) WHEN 2 THEN concat('{"id": "', CAST(c_custkey AS string), '", "name": "x"}') WHEN 3 THEN concat('{"id": ', CAST(c_custkey AS string), ', "name": 7}') WHEN 4 THEN '{"id": 1.5, "name": null}'
    WHEN 5 THEN concat('{"id": ', CAST(c_custkey AS string), ', "name": "", "top_k": 101}') WHEN 6 THEN 'null' END AS rejected FROM c""",
    graph_ctes=False,
)
def requests_checked(spark, sf_dir):
    """Bodies that fit, and bodies that are no JSON, no object, or have members that are missing, of another kind or out of range."""
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line = F.when(k == 0, said('{"id": ', key, ', "name": "', F.col("c_name"), '", "other": [1]}')).when(k == 1, said("bad ", F.col("c_name"))).when(k == 2, said('{"id": "', key, '", "name": "x"}'))
    line = line.when(k == 3, said('{"id": ', key, ', "name": 7}')).when(k == 4, '{"id": 1.5, "name": null}').when(k == 5, said('{"id": ', key, ', "name": "", "top_k": 101}')).when(k == 7, said('{"id": ', key, ', "name": "', F.col("c_name"), '", "top_k": 3}'))
    got = requests(table(spark, sf_dir, "customer").select(line.alias("value")), [Field("id", "long"), Field("name", least=1, most=200), Field("top_k", "long", True, 1, 100)])
    return got.withColumns({"reasons": F.array_join("reasons", "|"), "top_k": F.col("top_k").cast("int")})


def _atlas_reply(system: str, user: str) -> str:
    """What a model finds in a sentence on a nation or a region."""
    if system != ingest.EXTRACT_SYSTEM:
        return f"a summary of {len(user)} characters"
    if user.endswith(" is unreadable"):
        return "no json"
    name, lies, region = user.partition(" lies in ")
    if lies:
        entities = [{"name": name, "type": "Nation", "description": f"in {region}"}, {"name": region, "type": "region", "description": "a region"}]
        return json.dumps({"entities": entities, "relationships": [{"source": name, "target": region, "type": "lies in"}]})
    name = user.removesuffix(" spans the globe")
    return "```json\n" + json.dumps({"entities": [{"name": name, "type": "Region", "description": "spans the globe"}], "relationships": []}) + "\n```"


_ATLAS: dict[tuple, Engine] = {}


def _atlas(spark, sf_dir) -> Engine:
    """An engine that has ingested a document on each nation, then two on each region, one of which the model cannot read;
    once for each application and folder."""
    key = spark.sparkContext.applicationId, sf_dir, written_at(spark, sf_dir)
    if key not in _ATLAS or not there(spark, _ATLAS[key].store.path):
        config = EngineConfig(dim=16)
        engine = Engine(spark, Store(spark, f"{shared_dir(spark)}/graphfold/{uuid.uuid4().hex}/atlas"), HashEmbeddings(16), EchoLanguage(_atlas_reply), config)
        regions = table(spark, sf_dir, "region")
        nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        engine.ingest(nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat_ws(" ", "n_name", F.lit("lies in"), "r_name").alias("text")))
        about = lambda letter, what: regions.select(F.concat(F.lit(letter), F.col("r_regionkey").cast("string")).alias("id"), F.concat(F.lit(" About "), "r_name").alias("title"), F.concat_ws(" ", F.lower("r_name"), F.lit(what)).alias("text"))
        engine.ingest(about("r", "spans the globe").unionByName(about("b", "is unreadable")))
        _ATLAS[key] = engine
    return _ATLAS[key]


@query(
    """SELECT 'nation' AS type, n_name AS name, concat('in ', r_name) AS description, n_name AS aliases FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'region', r_name, concat('a region', chr(10), 'spans the globe'), concat(r_name, '|', lower(r_name)) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'region', lower(r_name), 'spans the globe', lower(r_name) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
    graph_ctes=False,
)
def ingest_twice(spark, sf_dir):
    return _atlas(spark, sf_dir).graph().nodes.where(F.col("type").isin("nation", "region")).select("type", "name", "description", F.array_join("aliases", "|").alias("aliases"))


@query(
    """WITH e AS (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_name AS src, n_name AS dst, 'mentions' AS type FROM e UNION ALL SELECT n_name, r_name, 'mentions' FROM e UNION ALL SELECT n_name, r_name, 'lies_in' FROM e
UNION ALL SELECT concat('About ', r_name), CASE WHEN r_name IN (SELECT r_name FROM e) THEN r_name ELSE lower(r_name) END, 'mentions' FROM region""",
    graph_ctes=False,
)
def ingest_edges(spark, sf_dir):
    g = _atlas(spark, sf_dir).graph()
    name = lambda end: g.nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return g.edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "type")


@query(
    """WITH d AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5(concat('document', chr(31), 'n', CAST(n_nationkey AS string)))) AS place FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT concat('n', CAST(n_nationkey AS string)) AS document_id, 'ready' AS document, 'ready' AS stage, 'completed' AS job, NULL AS error, 1 AS chunks, 1 AS extractions, 2 AS entities, 2 AS mentions, 1 AS relationships, CASE WHEN place = 1 THEN 2 ELSE 1 END AS description_chunks FROM d
UNION ALL SELECT concat('r', CAST(r_regionkey AS string)), 'ready', 'ready', 'completed', NULL, 1, 1, 1, 1, 0, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM d) THEN 0 ELSE 1 END FROM region
UNION ALL SELECT concat('b', CAST(r_regionkey AS string)), 'failed', 'extracting', 'failed', 'extraction reply is invalid', 1, NULL, NULL, NULL, NULL, NULL FROM region""",
    graph_ctes=False,
)
def job_states(spark, sf_dir):
    """Each job with its own document's progress; documents that the model cannot read fail alone."""
    store = _atlas(spark, sf_dir).store
    documents = store.read("documents").select(F.col("id").alias("document_id"), F.col("status").alias("document"))
    return store.read("jobs").join(documents, "document_id").select("document_id", "document", "stage", F.col("status").alias("job"), "error", *ingest.PROGRESS)


@query(
    """SELECT concat('n', CAST(n_nationkey AS string)) AS document_id, 0 AS ord, concat(n_name, ' lies in ', r_name) AS text FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT concat('r', CAST(r_regionkey AS string)), 0, concat(lower(r_name), ' spans the globe') FROM region""",
    graph_ctes=False,
)
def ingest_chunks(spark, sf_dir):
    """The chunks that an ingest leaves, by document; failed documents have none."""
    store = _atlas(spark, sf_dir).store
    nodes = store.read("documents").select(F.col("id").alias("document_id"), "node_id")
    return store.read("chunks").where("kind = 'document_chunk' AND embedding IS NOT NULL").join(nodes, "node_id").select("document_id", F.col("ord").cast("int").alias("ord"), "text")


@query(
    """WITH n AS (SELECT concat('n', CAST(n_nationkey AS string)) AS id, n_name AS name, n_regionkey AS r, n_nationkey AS k FROM nation), x AS (SELECT min(r_regionkey) AS gone, max(r_regionkey) AS new FROM region),
e AS (SELECT id AS src, concat('r', CAST(r AS string)) AS dst FROM n, x WHERE r <> gone)
SELECT 'nodes' AS tbl, id, concat('nation', ':', CASE WHEN r = new THEN concat('New ', name) ELSE name END) AS value FROM n, x UNION ALL SELECT 'nodes', concat('r', CAST(r_regionkey AS string)), concat('region', ':', r_name) FROM region, x WHERE r_regionkey <> gone
UNION ALL SELECT 'edges', md5(concat_ws(chr(31), src, 'in', dst)), concat(src, '>', dst) FROM e
UNION ALL SELECT 'chunks', md5(concat_ws(chr(31), concat('r', CAST(r_regionkey AS string)), concat('About ', r_name))), CASE WHEN r_regionkey = new THEN 'Rewritten' ELSE concat('About ', r_name) END FROM region, x WHERE r_regionkey <> gone
UNION ALL SELECT 'embedded', concat('r', CAST(r_regionkey AS string)), '16' FROM region, x WHERE r_regionkey <> gone""",
    graph_ctes=False,
)
def graph_writes(spark, sf_dir):
    """Inserts, updates and a cascading delete of stored nodes, edges and chunks, each a commit."""
    engine = Engine(spark, Store(spark, f"{shared_dir(spark)}/graphfold/{uuid.uuid4().hex}/written"), HashEmbeddings(16), EchoLanguage(), EngineConfig(dim=16))
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ends = regions.agg(F.min("r_regionkey").alias("gone"), F.max("r_regionkey").alias("new")).collect()[0]
    of = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    engine.create_nodes(nations.select(of("n", "n_nationkey").alias("id"), F.lit(" nation ").alias("type"), F.col("n_name").alias("name")).unionByName(regions.select(of("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.concat(F.lit(" "), "r_name").alias("name"))))
    engine.create_edges(nations.select(of("n", "n_nationkey").alias("src"), of("r", "n_regionkey").alias("dst"), F.lit("in").alias("type")))
    engine.create_chunks(regions.select(of("r", "r_regionkey").alias("node_id"), F.concat(F.lit("About "), "r_name").alias("text")))
    engine.update("nodes", nations.where(F.col("n_regionkey") == ends["new"]).select(of("n", "n_nationkey").alias("id"), F.concat(F.lit("New "), "n_name").alias("name")))
    engine.update("chunks", engine.store.read("chunks").where(F.col("node_id") == f"r{ends['new']}").select("id", F.lit("Rewritten").alias("text")))
    engine.delete("nodes", spark.createDataFrame([(f"r{ends['gone']}",)], "id string"))
    g = engine.graph()
    rows = lambda df, name, key, value: df.select(F.lit(name).alias("tbl"), F.col(key).alias("id"), value.alias("value"))
    out = rows(g.nodes, "nodes", "id", F.concat_ws(":", "type", "name")).unionByName(rows(g.edges, "edges", "id", F.concat_ws(">", "src", "dst")))
    return out.unionByName(rows(g.chunks, "chunks", "id", F.col("text"))).unionByName(rows(g.chunks, "embedded", "node_id", F.size("embedding").cast("string")))


_CUSTOMERS = "SELECT concat('c', CAST(c_custkey AS string)) AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer"


def _customers(spark, sf_dir, store: Store) -> None:
    c = table(spark, sf_dir, "customer")
    store.write(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), "customers")


@query(
    f"""WITH c AS ({_CUSTOMERS}), lo AS (SELECT min(nation) AS a, max(nation) AS b FROM c)
SELECT id, CASE WHEN nation = a THEN concat('Old ', name) ELSE name END AS name, CASE WHEN nation = a THEN 'moved' ELSE segment END AS segment, nation FROM c, lo WHERE nation <> b
UNION ALL SELECT concat('new ', id), name, 'added', nation FROM c, lo WHERE nation = a""",
    graph_ctes=False,
)
def store_upserts(spark, sf_dir):
    """An update, an insert and a delete of a bucketed table, each a commit that rewrites only the buckets it touches."""
    store = Store(spark, f"{shared_dir(spark)}/graphfold/{uuid.uuid4().hex}/customers", buckets=16)
    _customers(spark, sf_dir, store)
    c = store.read("customers")
    ends = c.agg(F.min("nation").alias("a"), F.max("nation").alias("b")).collect()[0]
    first = c.where(F.col("nation") == ends["a"])
    for rows, by in (
        (first.select("id", F.concat(F.lit("Old "), "name").alias("name"), F.lit("moved").alias("segment")), lambda rows: lambda old: tables.update(old, rows)),
        (first.select(F.concat(F.lit("new "), "id").alias("id"), "name", F.lit("added").alias("segment"), "nation"), lambda rows: lambda old: old.unionByName(rows)),
        (c.where(F.col("nation") == ends["b"]).select("id"), lambda rows: lambda old: tables.without(old, rows)),
    ):
        t = store.begin()
        t.change("customers", rows, by(rows))
        t.commit()
    return store.read("customers")


@query(
    """SELECT count(*) + 1 AS member_count, concat('a summary of ', CAST(length(concat('Entities:', chr(10))) + sum(length(concat('- ', n_name, ' (nation)', chr(10)))) + sum(length(concat('  about ', n_name, ': in ', r_name, chr(10))))
  + length(concat('- ', r_name, ' (region)', chr(10))) + length(concat('  about ', r_name, ': a region', chr(10), 'spans the globe', chr(10))) + length(concat(chr(10), 'Relationships:', chr(10)))
  + sum(length(concat('- ', n_name, ' -[lies_in]-> ', r_name, chr(10)))) - 1 AS string), ' characters') AS summary
FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) + 1 >= 3""",
    graph_ctes=False,
)
def ingest_communities(spark, sf_dir):
    return _atlas(spark, sf_dir).store.read("communities").select(F.col("member_count").cast("long").alias("member_count"), "summary")


@query(
    f"""WITH {_MENTIONS}, r AS (SELECT DISTINCT place // 8 AS doc_id, type, nn FROM m),
f AS (SELECT place // 8 AS doc_id, nn, arg_min(type, place) AS type FROM m GROUP BY place // 8, nn),
rel AS (SELECT place // 8 AS doc_id, nn AS s, lead(nn) OVER (PARTITION BY place // 8 ORDER BY place) AS t FROM m)
SELECT DISTINCT concat(a.type, ':', a.nn) AS src, concat(b.type, ':', b.nn) AS dst FROM rel JOIN f a ON a.doc_id = rel.doc_id AND a.nn = rel.s JOIN f b ON b.doc_id = rel.doc_id AND b.nn = rel.t WHERE a.nn <> b.nn OR a.type <> b.type""",
    graph_ctes=False,
)
def relation_edges(spark, sf_dir):
    from pyspark.sql import Window

    m = _mentions(spark, sf_dir)
    nodes = resolution.resolve(m, describe=False).select("id", "type", "normalized_name")
    target = F.lead("name").over(Window.partitionBy("doc_id").orderBy("item"))
    rel = m.select("doc_id", "ord", "item", F.col("name").alias("source"), target.alias("target"), F.lit("next").alias("type"), F.lit("").alias("description")).where(F.col("target").isNotNull())
    e = resolution.relation_edges(rel, m, nodes)
    label = lambda end: nodes.select(F.col("id").alias(end), F.concat_ws(":", "type", "normalized_name").alias(f"{end}_name"))
    return e.join(label("src"), "src").join(label("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
