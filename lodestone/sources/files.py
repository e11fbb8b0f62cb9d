"""File scans, gitignore patterns, snapshots of a tree, JSON and JSON-lines inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X
from ..shared import children

#: File names without suffix that are read.
PLAIN_NAMES = ("Dockerfile", "dockerfile", "Containerfile", "justfile", "Makefile")


def supported(path: Column) -> Column:
    """Whether the suffix is a known one or the name is one of PLAIN_NAMES."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return suffix.isin(*X.LANGUAGES) | name.isin(*PLAIN_NAMES)


def gitignore_patterns(lines: list[str]) -> list[str]:
    """Patterns of a gitignore: blanks and comments dropped, slashes at the end removed."""
    return [line.strip().rstrip("/") for line in lines if line.strip() and not line.strip().startswith("#")]


def scan(spark: SparkSession, root: str, extra_skip: tuple[str, ...] = (), gitignore: tuple[str, ...] = ()) -> DataFrame:
    """file_path (relative), content (UTF-8, replacement for bad bytes), length, modified, language, content_hash.

    Paths are filtered before contents are decoded; a whole tree is read in parallel.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").lstrip("/") + "/"
    rel = F.substr(F.col("path"), F.instr(F.col("path"), F.lit(base)) + F.lit(len(base)))
    files = raw.withColumn("file_path", rel).where(supported(F.col("file_path")) & ~P.skipped(F.col("file_path"), (*P.SKIP_PATTERNS, *extra_skip, *gitignore)))
    text = F.decode("content", "UTF-8")
    return files.select("file_path", text.alias("content"), "length", F.col("modificationTime").alias("modified"), X.language(F.col("file_path")).alias("language"), X.content_hash(F.col("content")).alias("content_hash"))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path of files that differ between two snapshots (file_path, content_hash), added and removed ones too."""
    a, b = before.select("file_path", F.col("content_hash").alias("__a")), after.select("file_path", F.col("content_hash").alias("__b"))
    return a.join(b, "file_path", "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("file_path")


_DOUBLES = [T.StructField(n, T.DoubleType()) for n in ("precision@1", "precision@3", "precision@5", "recall@1", "recall@3", "recall@5", "mrr", "ndcg@3", "ndcg@5", "avg_score")]
RESULT_SCHEMA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("test_id", "scenario", "timestamp", "test_type", "description")),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("retrieval", T.StructType(_DOUBLES)),
                    T.StructField(
                        "performance",
                        T.StructType(
                            [
                                T.StructField("latency", T.StructType([T.StructField(n, T.DoubleType()) for n in ("p50_ms", "p95_ms", "p99_ms")])),
                                T.StructField("tokens", T.StructType([T.StructField(n, T.LongType()) for n in ("prompt", "completion", "total", "context")])),
                                T.StructField("memory_mb", T.DoubleType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("raw_output", T.StringType()),
    ]
)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation results, one JSON file each."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", "true").json(folder)


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a dataset file {description, test_cases: [...]}."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("test_cases").alias("case")).select("case.*")


def first_session_id(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """The first JSON line that has a sessionID; lines that are no JSON are passed over."""
    found = lines.withColumn("session_id", F.get_json_object(value, "$.sessionID")).where("session_id IS NOT NULL")
    return found.orderBy(order).limit(1).select("session_id")


def session_ids(texts: DataFrame, value: str = "value") -> DataFrame:
    return texts.select(F.explode(F.regexp_extract_all(value, F.lit(r"(ses_[a-zA-Z0-9]+)"), F.lit(1))).alias("session_id")).distinct()


_ATTRIBUTES = "id string, node_type string, component_type string, path string, package_name string, description string, parsed_from string, grpc_services array<string>, grpc_rpcs array<string>"
_LINK = "source string, target string, edge_type string, parsed_from string"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph: the folder that write_graph makes, or one node-link file; an unreadable file is an empty graph."""
    if "nodes" in children(spark, path):
        nodes, links = spark.read.schema(_ATTRIBUTES).json(f"{path}/nodes"), spark.read.schema(_LINK).json(f"{path}/links")
    else:
        schema = f"nodes array<struct<{_ATTRIBUTES}>>, links array<struct<{_LINK}>>, edges array<struct<{_LINK}>>"
        raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
        links = raw.select(F.explode(F.coalesce("links", "edges")).alias("l")).select("l.*")
    return nodes.withColumnRenamed("id", "name"), links
