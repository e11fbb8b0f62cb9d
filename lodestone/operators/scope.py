"""Blast radius: services hit, key files, dependency counts, risks, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import paths as P
from . import graph as G


def with_service(hits: DataFrame) -> DataFrame:
    """The stored service, else the one inferred from the path; hits without either are dropped."""
    own = F.coalesce(F.nullif("service", F.lit("")), F.nullif(P.service(F.coalesce("file_path", F.lit("")), "scope"), F.lit("")))
    return hits.withColumn("service", own).where("service IS NOT NULL")


def service_hits(hits: DataFrame, files: int = 10) -> DataFrame:
    """service, hit_count, first_rank, files (distinct, first seen first, at most `files`); hits: rank, service, file_path."""
    known = with_service(hits)
    counted = known.groupBy("service").agg(F.count("*").alias("hit_count"), F.min("rank").alias("first_rank"))
    seen = known.where("file_path <> ''").groupBy("service", "file_path").agg(F.min("rank").alias("__first"))
    per = seen.withColumn("__rn", F.row_number().over(Window.partitionBy("service").orderBy("__first", "file_path"))).where(F.col("__rn") <= files)
    listed = per.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "file_path"))), lambda x: x["file_path"]).alias("files"))
    return counted.join(listed, "service", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def key_files(hits: DataFrame) -> DataFrame:
    """The first hit of each file, ranked as found."""
    first = Window.partitionBy("file_path").orderBy("rank")
    return hits.where("file_path <> ''").withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def known_services(services: DataFrame, nodes: DataFrame) -> DataFrame:
    """name of the services that are nodes of the graph."""
    return services.select(F.col("service").alias("name")).join(nodes.select("name"), "name", "left_semi")


def reach(services: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """One search from all known services in both directions, which the dependency counts and the risks share."""
    return G.search(edges, known_services(services, nodes), depth)


def dependency_counts(services: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, reached: DataFrame | None = None) -> DataFrame:
    """direction, name, services: how many affected services have the node up- or downstream; unknown services are skipped."""
    reached = reach(services, edges, nodes, depth) if reached is None else reached
    return reached.groupBy("direction", "name").agg(F.count("*").alias("services"))  # a start reaches a name once


def risks(services: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, reached: DataFrame | None = None) -> DataFrame:
    """risk, one row a finding: dependents over 10 or 3, shared libraries with more than 5; one LOW row if there is none.

    A library's own search is as deep as depth 1 reaches (two hops), whatever `depth` is.
    """
    spark = services.sparkSession
    if reached is None:
        reached = G.search(edges, known_services(services, nodes), max(depth, 1), ("downstream",))
    near, far = F.count_if(F.col("depth") <= 2).alias("near"), F.count_if(F.col("depth") <= depth + 1).alias("far")
    per = reached.where("direction = 'downstream'").groupBy(F.col("start").alias("name")).agg(near, far)
    kinds = nodes.groupBy("name").agg(F.max(F.col("node_type") == "library").alias("library"))
    counted = per.join(kinds, "name")
    text = F.concat(F.lit("SHARED LIBRARY: "), F.col("name"), F.lit(" is used by "), F.col("near").cast("string"), F.lit(" modules. Schema/API changes need careful coordination."))
    both = F.array(K.risk(F.col("name"), F.col("far")), F.when(F.col("library") & (F.col("near") > 5), text))
    found = counted.select(F.explode(both).alias("risk")).where("risk IS NOT NULL")
    one = spark.range(1).select(F.lit(K.LOW_RISK).alias("__low"))
    return one.join(found, F.lit(True), "left").select(F.coalesce("risk", "__low").alias("risk"))  # left side has one row


def reading_order(services: DataFrame, files: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """position, entry: libraries first, then services in hit order, then files without a service; up to `most` files each."""
    kind = services.join(nodes.select(F.col("name").alias("service"), "node_type"), "service", "left")
    part = F.when(F.col("node_type") == "library", 0).otherwise(1)
    per = files.where(F.coalesce("service", F.lit("")) != "").withColumn("__rn", F.row_number().over(Window.partitionBy("service").orderBy("rank"))).where(F.col("__rn") <= most)
    listed = per.groupBy("service").agg(_listed("__rn").alias("__files"))
    owned = kind.join(listed, "service").select(
        part.alias("part"), "hit_count", "first_rank", F.concat(F.when(part == 0, "Shared library **").otherwise("Service **"), F.col("service"), F.lit("**: "), F.col("__files")).alias("entry")
    )
    loose = files.where(F.coalesce("service", F.lit("")) == "").orderBy("rank").limit(most).withColumn("__rn", F.col("rank"))
    other = loose.agg(_listed("__rn").alias("__files")).where("__files <> ''").select(
        F.lit(2).alias("part"), F.lit(0).cast("long").alias("hit_count"), F.lit(0).alias("first_rank"), F.concat(F.lit("Other relevant files: "), F.col("__files")).alias("entry")
    )
    order = Window.orderBy("part", F.desc("hit_count"), "first_rank")  # one row a service hit
    return owned.unionByName(other).select(F.row_number().over(order).alias("position"), "entry")


def _listed(order: str):
    files = F.transform(F.array_sort(F.collect_list(F.struct(order, "file_path"))), lambda x: F.concat(F.lit("`"), x["file_path"], F.lit("`")))
    return F.array_join(files, ", ")


def scope(description: str, hits: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """One row: summary, services, key files, dependencies, risks and reading order as arrays; hits: rank, service, file_path, score."""
    services = service_hits(hits)
    files = key_files(hits)
    reached = reach(services, edges, nodes, max(depth, 1))
    deps = dependency_counts(services, edges, nodes, depth, reached.where(F.col("depth") <= depth + 1))
    one = hits.sparkSession.range(1).select(F.substring(F.lit(description), 1, 200).alias("description_summary"))
    parts = [
        services.agg(F.array_sort(F.collect_list(F.struct((-F.col("hit_count")).alias("order"), "first_rank", "service", "hit_count", "files"))).alias("affected_services")),
        files.agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "service", "score"))).alias("key_files")),
        deps.agg(F.array_sort(F.collect_list(F.struct("direction", (-F.col("services")).alias("order"), "name"))).alias("dependencies")),
        risks(services, edges, nodes, depth, reached).agg(F.array_sort(F.collect_list("risk")).alias("risk_assessment")),
        reading_order(services, files.withColumn("service", F.coalesce("service", F.lit(""))), nodes).agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("suggested_reading_order")),
    ]
    for p in parts:  # one-row frames
        one = one.crossJoin(p)
    return one
