"""Directed graphs as node and edge tables: merge, bounded breadth-first search, degrees, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import kept, new_path, spread
from .adjacency import Searched


def merge_edges(edges: DataFrame, order: str = "seq", rows: int | None = None) -> DataFrame:
    """A simple digraph: repeated (source, target) collapse, the attributes of the last win; rows: how many edges come in, if known."""
    edges = spread(edges, edges.count() if rows is None else rows, "source", "target")
    last = Window.partitionBy("source", "target").orderBy(F.desc(order))
    return edges.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def merge_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """Repeated nodes merge attribute by attribute; the last value that is not null wins."""
    attrs = [c for c in nodes.columns if c not in ("name", order)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in attrs]
    return nodes.groupBy("name").agg(*last) if last else nodes.select("name").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name"))).distinct()


def implicit_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that no node row declares."""
    return endpoints(edges).join(nodes.select("name"), "name", "left_anti")


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes and implicit ones, which have no attributes."""
    return nodes.unionByName(implicit_nodes(nodes, edges), allowMissingColumns=True)


def search(edges: DataFrame | Searched, starts: DataFrame, depth: int = 3, directions: tuple[str, ...] = ("upstream", "downstream"), inclusive_depth: bool = True) -> DataFrame:
    """direction, start, name, depth (first hop) of the nodes reached from each row of starts (name), upstream along the edges, downstream against them.

    A node is expanded while its hop is at most `depth`, so results reach depth + 1 hops;
    inclusive_depth=False stops at depth. The start is not marked as visited, so in a
    cycle it appears in its own result. The distinct edges are written once for all hops,
    starts and directions; a hop is one join of the last frontier with them, reduced to
    new (direction, start, name) rows, which are written as the next frontier. Edges that
    are stored for searches (an Adjacency) or left where they are (Scanned) are not written.
    """
    if isinstance(edges, Searched):
        return edges.search(starts, depth, directions, inclusive_depth)
    spark = edges.sparkSession
    pairs = kept(edges.select("source", "target").distinct(), "edges")
    step = lambda way, a, b: pairs.select(F.lit(way).alias("direction"), F.col(a).alias("__at"), F.col(b).alias("name"))
    steps = {"upstream": step("upstream", "source", "target"), "downstream": step("downstream", "target", "source")}
    moves = reduce(DataFrame.unionByName, [steps[d] for d in directions])
    schema = "direction string, start string, name string, depth int"
    front = starts.select(F.explode(F.array(*map(F.lit, directions))).alias("direction"), F.col("name").alias("start"), "name").distinct()
    written: list[str] = []
    for hop in range(1, depth + 1 + int(inclusive_depth)):
        reached = front.select("direction", "start", F.col("name").alias("__at")).join(moves, ["direction", "__at"]).select("direction", "start", "name").distinct()
        if written:
            reached = reached.join(spark.read.schema(schema).parquet(*written), ["direction", "start", "name"], "left_anti")
        path = new_path(spark, f"hop-{hop}")
        front = kept(reached.withColumn("depth", F.lit(hop)), "hop", path)
        written.append(path)
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def bfs(edges: DataFrame, starts: DataFrame, depth: int = 3, reverse: bool = False, inclusive_depth: bool = True) -> DataFrame:
    """start, name, depth of search() in one direction."""
    return search(edges, starts, depth, ("downstream" if reverse else "upstream",), inclusive_depth).drop("direction")


def upstream(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """What the starts depend on: along the edges."""
    return bfs(edges, starts, depth)


def downstream(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on the starts: against the edges."""
    return bfs(edges, starts, depth, reverse=True)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, upstream (out-edges), downstream (in-edges) of every node, 0 where there is none."""
    out = edges.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("__up"))
    into = edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("__down"))
    joined = nodes.select("name").join(out, "name", "left").join(into, "name", "left")
    return joined.select("name", F.coalesce("__up", F.lit(0)).alias("upstream"), F.coalesce("__down", F.lit(0)).alias("downstream"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of nodes and of edges."""
    n = nodes.agg(F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # two one-row frames


def listing(nodes: DataFrame, edges: DataFrame | Searched, most: int | None = None) -> DataFrame:
    """name, upstream, downstream: sorted names two hops around each node (all nodes, or the first `most` by name)."""
    names = nodes.select("name").distinct()
    names = names.orderBy("name").limit(most) if most is not None else names
    side = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("name")))).alias(d)
    sides = search(edges, names, 1).groupBy("start").agg(side("upstream"), side("downstream"))
    none = F.array().cast("array<string>")
    return names.join(sides, F.col("name") == F.col("start"), "left").select("name", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))


def merge_compose_and_toml(compose: DataFrame, toml: DataFrame) -> DataFrame:
    """Nodes known to either source; the compose node type wins; parsed_from says which sources know the node."""
    a = compose.select("name", F.col("node_type").alias("__c_type"))
    b = toml.select("name", F.col("component_type").alias("__t_type"), "path", "package_name", "description")
    joined = a.join(b, "name", "full_outer")
    both = F.when(F.col("__c_type").isNotNull() & F.col("__t_type").isNotNull(), "compose+toml").when(F.col("__c_type").isNotNull(), "compose").otherwise("toml")
    return joined.select("name", F.coalesce("__c_type", "__t_type").alias("node_type"), F.col("__t_type").alias("component_type"), "path", "package_name", "description", both.alias("parsed_from"))


def attach_proto(nodes: DataFrame, proto: DataFrame) -> DataFrame:
    """Adds gRPC services and rpcs to nodes that own them; owners without a node are ignored."""
    per_owner = proto.groupBy(F.col("owning_service").alias("name")).agg(
        F.array_sort(F.collect_set("service")).alias("grpc_services"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rpcs")))).alias("grpc_rpcs")
    )
    return nodes.join(per_owner, "name", "left")


def grpc_edges(proto: DataFrame, strict: bool = False) -> DataFrame:
    """Client -> server edges: the first owner of a proto service serves it, later owners call it.

    strict=True gives the empty relation that unique service names lead to.
    """
    first = Window.partitionBy("service").orderBy("seq")
    ranked = proto.withColumn("__server", F.first("owning_service").over(first))
    found = ranked.where(F.col("owning_service") != F.col("__server")).select(F.col("owning_service").alias("source"), F.col("__server").alias("target"), F.lit("grpc").alias("edge_type")).distinct()
    return found.where("false") if strict else found


def resolve_dependencies(requirements: DataFrame, packages: DataFrame) -> DataFrame:
    """source, target of library edges: requirement names matched with package names, as they are or with - as _; no self edges.

    requirements: component, requirement name; packages: package_name, component.
    """
    both = packages.select(F.col("package_name").alias("__key"), F.col("component").alias("__target")).unionByName(
        packages.select(F.translate("package_name", "-", "_").alias("__key"), F.col("component").alias("__target"))
    )
    known = both.groupBy("__key").agg(F.max("__target").alias("__target"))
    exact, bent = known.alias("exact"), known.alias("bent")
    r = requirements.alias("r")
    joined = r.join(exact, F.col("r.requirement") == F.col("exact.__key"), "left").join(bent, F.translate("r.requirement", "-", "_") == F.col("bent.__key"), "left")
    target = F.coalesce("exact.__target", "bent.__target")
    return joined.select(F.col("r.component").alias("source"), target.alias("target")).where(F.col("target").isNotNull() & (F.col("source") != F.col("target"))).distinct()


def first_node_in_path(paths: DataFrame, nodes: DataFrame, path: str = "path") -> DataFrame:
    """path, name: the first node (by seq) whose name is a substring of the path.

    A containment join has no key. Nodes are a declared, small table (one row a service);
    Spark broadcasts it only below its own size threshold.
    """
    hit = paths.select(path).distinct().join(nodes.select("name", "seq"), F.contains(F.col(path), F.col("name")))
    return hit.groupBy(path).agg(F.min_by("name", "seq").alias("name"))


def dependents(edges: DataFrame | Searched, starts: DataFrame, depth: int) -> DataFrame:
    """name, dependents: how many nodes downstream search finds for each start, 0 included."""
    found = downstream(edges, starts, depth).groupBy(F.col("start").alias("name")).agg(F.count("*").alias("__n"))
    return starts.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("__n", F.lit(0)).alias("dependents"))


def graph_boost(dependents_: Column) -> Column:
    """Half a point a dependent, at most five."""
    return F.least(dependents_ * 0.5, F.lit(5.0))
