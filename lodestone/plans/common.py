"""Tables of the fixtures and the relations that stand in for a repository's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.adjacency import Scanned
from ..operators.gram_index import GramIndex
from ..shared import changed, exists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_hits(spark: SparkSession, sf_dir: str, where: str, k: int) -> DataFrame:
    """query_id, vec_id, rank, score, label of the vectors nearest to the one that `where` names."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(e, S.query_vectors(e, F.expr(where))[0], k)


#: The query set: every id divisible by 20, which grows with the table.
WHOLE = "vec_id % 20 = 0"


def whole_hits(spark: SparkSession, sf_dir: str, where: str, k: int) -> DataFrame:
    """query_id, vec_id, rank, score, label of the nearest vectors of each query, any number of them."""
    e = table(spark, sf_dir, "embeddings")
    return S.top_k_blocks(e, e.where(where), k).join(e.select("vec_id", "label"), "vec_id")


#: DuckDB: hits of the queries that satisfy {where}, at most {k} each.
HITS_SQL = """
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}),
sv AS (SELECT query_id, vec_id, label, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM qv, embeddings WHERE vec_id <> query_id),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM sv) WHERE rank <= {k})"""


def entity_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """source, target, edge_type, seq: foreign keys of the star schema as a dependency graph; without distinct a row a line item."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    row = lambda df, a, b, seq: df.select(a.alias("source"), b.alias("target"), F.lit("depends_on").alias("edge_type"), F.lit(seq).alias("seq"))
    lines = t("lineitem").select("l_partkey", "l_suppkey")
    return (
        row(t("customer"), node("customer", "c_custkey"), node("nation", "c_nationkey"), 1)
        .unionByName(row(t("supplier"), node("supplier", "s_suppkey"), node("nation", "s_nationkey"), 2))
        .unionByName(row(t("nation"), node("nation", "n_nationkey"), node("region", "n_regionkey"), 3))
        .unionByName(row(lines.distinct() if distinct else lines, node("part", "l_partkey"), node("supplier", "l_suppkey"), 4))
    )


_stored: dict[tuple, GramIndex] = {}


def _stored_once(spark: SparkSession, sf_dir: str, kind: str, tables: tuple[str, ...], marker: str, build):
    """What build() stores, once in a session, and again when one of its tables has changed."""
    facts = tuple(changed(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (kind, spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir, facts)
    if key not in _stored or not exists(spark, f"{_stored[key].path}/{marker}"):
        _stored[key] = build()
    return _stored[key]


def entity_search(spark: SparkSession, sf_dir: str) -> Scanned:
    """The entity graph's edges for one search, read from their tables."""
    return Scanned(spark, entity_edges(spark, sf_dir, distinct=False))


def document_grams(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The documents, stored with their gram postings."""
    return _stored_once(spark, sf_dir, "grams", ("documents",), "grams.json", lambda: GramIndex.build(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, node_type of the declared entities; parts and suppliers are libraries, the rest services."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda n, kind, c, node_type: t(n).select(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("name"), F.lit(node_type).alias("node_type"))
    return (
        row("customer", "customer", "c_custkey", "service")
        .unionByName(row("supplier", "supplier", "s_suppkey", "library"))
        .unionByName(row("nation", "nation", "n_nationkey", "service"))
        .unionByName(row("region", "region", "r_regionkey", "service"))
        .unionByName(row("part", "part", "p_partkey", "library"))
    )


EDGES_SQL = """
edges AS (
  SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem),
nodes AS (
  SELECT 'customer:' || c_custkey AS name, 'service' AS node_type FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'library' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'service' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'service' FROM region
  UNION ALL SELECT 'part:' || p_partkey, 'library' FROM part)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, message, ts, files, lines: orders as commits, their line items as changed files."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit")).agg(F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").cast("long").alias("lines"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("ts"))
    return o.join(li, "commit")


COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS "commit", o_orderpriority AS message, o_orderdate AS ts, files, lines
  FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS files, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, html: each page's URL path inside a directory that depends on its id."""
    from ..functions import paths as P

    d = F.array(*(F.lit(x) for x in ("services", "libs", "agents", "tests", "packages", "vendor", "src/common")))
    ext = F.array(*(F.lit(x) for x in ("main.py", "server.ts", "domain.py", "index.d.ts", "routes.py", "Dockerfile", "test_a.py", "views.py", "conf.toml", "App.tsx")))
    path = F.concat_ws("/", F.element_at(d, (F.col("page_id") % 7 + 1).cast("int")), P.url_path(F.col("url")), F.element_at(ext, (F.col("page_id") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")


PATHS_SQL = r"""
paths AS (
  SELECT page_id, html, (['services', 'libs', 'agents', 'tests', 'packages', 'vendor', 'src/common'])[CAST(page_id % 7 AS INTEGER) + 1] || '/' ||
    regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/' ||
    (['main.py', 'server.ts', 'domain.py', 'index.d.ts', 'routes.py', 'Dockerfile', 'test_a.py', 'views.py', 'conf.toml', 'App.tsx'])[CAST(page_id % 10 AS INTEGER) + 1] AS path
  FROM pages)"""
#: DuckDB: lines of documents, one empty line at the end dropped.
LINES_SQL = """
lines AS (
  SELECT *, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS ls
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents))"""
