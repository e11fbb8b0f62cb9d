"""A graph's edges stored once for searches: a bucketed table of both directions, read by the buckets a hop hits.

A row says that, going in a direction, `name` follows `at`. Rows are bucketed and sorted by
`slot`, which is direction and node, and for a node with more than HOT neighbours a number
besides, so no bucket takes all of a hot node. A hop from few nodes filters on their slots:
Spark prunes the buckets, and inside them row groups. A hop from many nodes is a join on
slot in which the stored side is not shuffled again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, get, kept, new_path, put

#: Neighbours of a node in one slot; rows of a bucket; most buckets.
HOT, BUCKET_ROWS, MOST_BUCKETS = 1 << 16, 1 << 14, 4096
#: Nodes of a hop that are looked up by name, and neighbours that the driver takes for them; beyond either a hop is a join.
FEW, MANY = 5000, 50_000
#: Slots that are named in the scan's filter, which prunes buckets.
NAMED = 64
REACHED = "direction string, start string, name string, depth int"


def _slot(direction: Column, node: Column, part: Column | None = None) -> Column:
    plain = F.concat(direction, F.lit(">"), node)
    return plain if part is None else F.when(part > 0, F.concat(plain, F.lit("\x00"), part.cast("string"))).otherwise(plain)


class Searched:
    """Edges that answer neighbours() of few nodes and hop() of any number."""

    spark: SparkSession

    def neighbours(self, nodes: list[tuple[str, str]]) -> DataFrame:
        raise NotImplementedError

    def hop(self, front: DataFrame) -> DataFrame:
        raise NotImplementedError

    def search(self, starts: DataFrame, depth: int = 3, directions: tuple[str, ...] = ("upstream", "downstream"), inclusive_depth: bool = True) -> DataFrame:
        """What graph.search() returns, without writing edges.

        As long as a hop's nodes and neighbours are few, the driver holds the frontier and a
        hop is one pruned read; from the first larger hop on, frontiers are tables.
        """
        last = depth + int(inclusive_depth)
        names = [r["name"] for r in starts.where("name IS NOT NULL").select("name").distinct().limit(FEW + 1).collect()]  # at most FEW + 1
        hop, known, front = 1, [], {(d, n, n) for n in names for d in directions}
        seen: set[tuple[str, str, str]] = set()
        few = len(names) <= FEW
        while few and front and hop <= last:
            nodes = sorted({(d, n) for d, _, n in front})
            if len(nodes) > FEW or len(seen) > MANY:
                break
            rows = self.neighbours(nodes).limit(MANY + 1).toArrow()  # at most MANY + 1
            if rows.num_rows > MANY:
                break
            follow: dict[tuple[str, str], list[str]] = {}
            for way, at, name in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                follow.setdefault((way, at), []).append(name)
            front = {(d, s, x) for d, s, n in front for x in follow.get((d, n), ())} - seen
            seen |= front
            known += [(*f, hop) for f in front]
            hop += 1
        kinds = [pa.string()] * 3 + [pa.int32()]
        done = self.spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*known, strict=True) if known else [[]] * 4, kinds, strict=True)], REACHED.replace(" string", "").replace(" int", "").split(", ")))
        if few and (not front or hop > last):
            return done
        if few:
            wave = self.spark.createDataFrame(sorted(front), "direction string, start string, name string")
        else:
            wave = starts.where("name IS NOT NULL").select(F.explode(F.array(*map(F.lit, directions))).alias("direction"), F.col("name").alias("start"), "name").distinct()
        found, paths = done, []  # at most MANY rows so far, held by the driver
        for at in range(hop, last + 1):
            reached = self.hop(wave).distinct().join(found, ["direction", "start", "name"], "left_anti")
            paths.append(new_path(self.spark, f"hop-{at}"))
            wave = kept(reached.withColumn("depth", F.lit(at)), "hop", paths[-1])
            found = done.unionByName(self.spark.read.schema(REACHED).parquet(*paths))
        return found


@dataclass
class Scanned(Searched):
    """Edges (source, target) that are read where they are: a hop from few nodes is one filtered scan, from many a join.

    For a search or two over plain tables this is less than storing the edges. Repeated edges
    and null ends may be among them.
    """

    spark: SparkSession
    edges: DataFrame

    def _moves(self, direction: str) -> DataFrame:
        at, name = ("source", "target") if direction == "upstream" else ("target", "source")
        return self.edges.select(F.lit(direction).alias("direction"), F.col(at).alias("at"), F.col(name).alias("name")).where("name IS NOT NULL")

    def neighbours(self, nodes: list[tuple[str, str]]) -> DataFrame:
        found = None
        for d in sorted({d for d, _ in nodes}):
            names = [n for way, n in nodes if way == d]
            if len(names) <= NAMED:
                one = self._moves(d).where(F.col("at").isin(names))
            else:
                asked = self.spark.createDataFrame([(n,) for n in names], "at string")  # at most FEW
                one = self._moves(d).join(F.broadcast(asked), "at").select("direction", "at", "name")
            found = one if found is None else found.unionByName(one)
        return found.distinct()

    def hop(self, front: DataFrame) -> DataFrame:
        asked = front.select("direction", "start", F.col("name").alias("at"))
        one = lambda d: asked.where(F.col("direction") == d).join(self._moves(d).drop("direction"), "at").select("direction", "start", "name")
        return one("upstream").unionByName(one("downstream"))


@dataclass
class Adjacency(Searched):
    """The stored edges: where they are, under which table name this session knows them, how many buckets, whether any node is hot."""

    spark: SparkSession
    path: str
    name: str
    buckets: int
    hot: bool

    @classmethod
    def build(cls, edges: DataFrame, path: str | None = None, hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> Adjacency:
        """Stores the distinct (source, target) of edges; null ends are no edges. What `path` held before is replaced."""
        spark = edges.sparkSession
        path = path or new_path(spark, "adjacency")
        delete(spark, path)
        pairs = kept(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "pairs")
        way = lambda d, a, b: pairs.select(F.lit(d).alias("direction"), F.col(a).alias("at"), F.col(b).alias("name"))
        rows = way("upstream", "source", "target").unionByName(way("downstream", "target", "source"))
        parts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
        rows.groupBy("direction", "at").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(_slot(F.col("direction"), F.col("at")).alias("slot"), parts.alias("parts")).write.parquet(f"{path}/hot")
        split, heavy = rows.withColumn("__plain", _slot(F.col("direction"), F.col("at"))), cls._heavy(spark, path)
        any_hot = bool(heavy.limit(1).count())
        if any_hot:
            split = split.join(heavy.withColumnRenamed("slot", "__plain"), "__plain", "left")
            part = F.pmod(F.xxhash64("name"), F.coalesce("parts", F.lit(1))).cast("int")
        slotted = split.select("direction", "at", "name", _slot(F.col("direction"), F.col("at"), part if any_hot else None).alias("slot"))
        buckets = min(MOST_BUCKETS, max(8, 2 * pairs.count() // bucket_rows))
        name = f"lodestone_adjacency_{uuid.uuid4().hex}"
        slotted.repartition(buckets, "slot").write.bucketBy(buckets, "slot").sortBy("slot").format("parquet").option("path", f"{path}/edges").saveAsTable(name)
        put(spark, f"{path}/adjacency.json", json.dumps({"buckets": buckets, "hot": any_hot}))
        return cls(spark, path, name, buckets, any_hot)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Adjacency:
        """Stored edges, made known to this session under a name of their own."""
        saved, name = json.loads(get(spark, f"{path}/adjacency.json")), f"lodestone_adjacency_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} (direction STRING, at STRING, name STRING, slot STRING) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {saved['buckets']} BUCKETS LOCATION '{path}/edges'")
        return cls(spark, path, name, saved["buckets"], saved["hot"])

    @staticmethod
    def _heavy(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("slot string, parts int").parquet(f"{path}/hot")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def neighbours(self, nodes: list[tuple[str, str]]) -> DataFrame:
        """direction, at, name of few (direction, node): of up to NAMED slots only the buckets are read, beyond that the slots are broadcast."""
        slots = [f"{d}>{n}" for d, n in nodes]
        if self.hot:
            asked = self.spark.createDataFrame([(s,) for s in slots], "slot string")
            heavy = self._heavy(self.spark, self.path).join(F.broadcast(asked), "slot").collect()  # at most one row a node
            slots += [f"{r['slot']}\x00{i}" for r in heavy for i in range(1, r["parts"])]
        if len(slots) <= NAMED:
            return self.rows().where(F.col("slot").isin(slots)).select("direction", "at", "name")
        asked = self.spark.createDataFrame([(s,) for s in slots], "slot string")  # FEW nodes in two directions, and parts of hot ones
        return self.rows().join(F.broadcast(asked), "slot").select("direction", "at", "name")

    def hop(self, front: DataFrame) -> DataFrame:
        """direction, start, name of what follows the names of front (direction, start, name), whatever their number; repeats may occur."""
        asked = front.select("direction", "start", _slot(F.col("direction"), F.col("name")).alias("slot"))
        if self.hot:
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
            asked = asked.join(self._heavy(self.spark, self.path), "slot", "left").select("direction", "start", "slot", parts.alias("part"))
            asked = asked.select("direction", "start", F.when(F.col("part") > 0, F.concat("slot", F.lit("\x00"), F.col("part").cast("string"))).otherwise(F.col("slot")).alias("slot"))
        return asked.join(self.rows().select("slot", "name"), "slot").select("direction", "start", "name")
