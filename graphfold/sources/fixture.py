"""A graph over the driver's tables: regions, nations, customers, suppliers, parts and documents as nodes, embedded chunks.

The SQL runs in Spark and DuckDB; Spark takes the distinct pairs of suppliers and parts from a shorter form of the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.operators.retrieval import Graph
from graphfold.plans.written import materialize, there

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "documents", "embeddings", "conversations")

CTES = """
fx_n AS (
  SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM part) AS np
),
g_nodes AS (
  SELECT concat('r:', cast(r_regionkey AS string)) AS id, 'region' AS type, r_name AS name, cast(NULL AS string) AS normalized_name, split('', ';') AS aliases FROM region
  UNION ALL SELECT concat('n:', cast(n_nationkey AS string)), 'nation', n_name, '', split(concat('Country ', cast(n_nationkey AS string), ';Land ', cast(n_nationkey AS string)), ';') FROM nation
  UNION ALL SELECT concat('c:', cast(c_custkey AS string)), 'customer', c_name, cast(NULL AS string), split('', ';') FROM customer
  UNION ALL SELECT concat('s:', cast(s_suppkey AS string)), 'supplier', s_name, concat('works ', cast(s_suppkey AS string)), split('', ';') FROM supplier
  UNION ALL SELECT concat('p:', cast(p_partkey AS string)), 'part', p_name, cast(NULL AS string), split('', ';') FROM part
  UNION ALL SELECT concat('d:', cast(doc_id AS string)), 'document', concat('Doc ', cast(doc_id AS string)), cast(NULL AS string), split('', ';') FROM documents
  UNION ALL SELECT DISTINCT concat('k:', cast(label AS string)), 'community', concat('community_', cast(label + 1 AS string)), cast(NULL AS string), split('', ';') FROM embeddings
),
g_edges0 AS (
  SELECT concat('n:', cast(n_nationkey AS string)) AS src, concat('r:', cast(n_regionkey AS string)) AS dst, 'in_region' AS type, cast(NULL AS string) AS chunk_id FROM nation
  UNION ALL SELECT concat('c:', cast(c_custkey AS string)), concat('n:', cast(c_nationkey AS string)), 'located_in', cast(NULL AS string) FROM customer
  UNION ALL SELECT concat('s:', cast(s_suppkey AS string)), concat('n:', cast(s_nationkey AS string)), 'located_in', cast(NULL AS string) FROM supplier
  UNION ALL SELECT DISTINCT concat('s:', cast(l_suppkey AS string)), concat('p:', cast(l_partkey AS string)), 'supplies', cast(NULL AS string) FROM lineitem
  UNION ALL SELECT concat('d:', cast(doc_id AS string)), concat('c:', cast(doc_id % nc AS string)), 'mentions', concat('x:', cast((doc_id + 3) % 40 AS string)) FROM documents CROSS JOIN fx_n
  UNION ALL SELECT concat('d:', cast(doc_id AS string)), concat('p:', cast(doc_id % np AS string)), 'mentions', cast(NULL AS string) FROM documents CROSS JOIN fx_n
),
g_edges AS (SELECT concat(src, '|', type, '|', dst) AS id, src, dst, type, chunk_id FROM g_edges0),
fx_e AS (
  SELECT vec_id, embedding, label, vec_id % nd AS did, vec_id % nc AS cid FROM embeddings CROSS JOIN fx_n
),
g_chunks AS (
  SELECT concat('x:', cast(e.vec_id AS string)) AS id,
         CASE WHEN e.label <= 5 THEN concat('d:', cast(e.did AS string))
              WHEN e.label <= 8 THEN concat('c:', cast(e.cid AS string))
              ELSE concat('k:', cast(e.vec_id % 10 AS string)) END AS node_id,
         CASE WHEN e.label <= 5 THEN 'document_chunk' WHEN e.label <= 8 THEN 'entity_description' ELSE 'community_summary' END AS kind,
         d.text, e.embedding
  FROM fx_e e JOIN documents d ON d.doc_id = e.did
)"""


#: The same pairs, told apart by their keys before these become texts.
_PAIRS = "SELECT DISTINCT concat('s:', cast(l_suppkey AS string)), concat('p:', cast(l_partkey AS string)), 'supplies', cast(NULL AS string) FROM lineitem"
_SHORT = "SELECT concat('s:', cast(l_suppkey AS string)), concat('p:', cast(l_partkey AS string)), 'supplies', cast(NULL AS string) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def written_at(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables' files were last written: what is built of them is built again when they change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in TABLES]
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


class Fixture(Graph):
    """The graph of the driver's tables; each of its tables is written when it is first read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.near, self.index = spark, sf_dir, None, None
        self.built: dict[str, DataFrame] = {}

    def _one(self, name: str) -> DataFrame:
        held = self.built.get(name)
        if held is None or not there(self.spark, held._written_to):
            views(self.spark, self.sf_dir)
            self.built[name] = materialize(self.spark.sql(f"WITH {CTES.replace(_PAIRS, _SHORT)} SELECT * FROM {name}"), name)
        return self.built[name]

    nodes = property(lambda self: self._one("g_nodes"))
    edges = property(lambda self: self._one("g_edges"))
    chunks = property(lambda self: self._one("g_chunks"))


_BUILT: dict[tuple, Fixture] = {}


def graph(spark: SparkSession, sf_dir: str) -> Fixture:
    """The graph as tables, written once for each application and state of the folder, as a store would hold it."""
    key = spark.sparkContext.applicationId, sf_dir, written_at(spark, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Fixture(spark, sf_dir)
    return _BUILT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The embedding of one row, as a query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return [float(x) for x in row[0]["embedding"]]
