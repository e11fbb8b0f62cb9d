"""SimHash near-duplicate classes by pigeonhole blocks.

Each text becomes a 64-bit SimHash over word shingles. Fingerprints link if they
differ in at most max_bits bits; the pairs are found by blocks, verified by Hamming
distance in buckets, and leave as a spanning forest (hamming.py), so a large family
of near copies never becomes all its pairs. Links become classes by alternating
large-star and small-star contraction; every round is written to the shared folder.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, keeps_columns, materialise, new_path, shuffles_dropped
from .hamming import links_within

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Differing bits of linked fingerprints, and how many blocks make a key: three of five, 38 bits.
MAX_BITS, SHARED = 2, 3
#: Shingles hashed at a time, so that a very long text needs bounded memory.
STEP = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash as a signed 64-bit integer. Fewer words than a shingle: the whole sequence; none: 0."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = tokens[at : at + STEP + words - 1]
        size = min(STEP, n - at)
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(tokens) >= words else iter([b" ".join(tokens)])
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) per row of docs; the whole text counts, a null text has fingerprint 0."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Parts a node's edges are dealt to, so that a node with a third of all edges is no single task's work.
PARTS = 64


def with_least(edges: DataFrame, key: str, value: str) -> DataFrame:
    """edges with m, the least value of the row's key; a key's rows meet it in PARTS parts."""
    part = F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int")
    parts = edges.groupBy(key, part.alias("part")).agg(F.min(value).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"))  # at most PARTS rows a key
    known = parts.select(key, "part").join(least, key)
    return edges.withColumn("part", part).join(known, [key, "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """Stars (node, root), root < node, of the connected components of edges (a < b)."""
    spark = edges.sparkSession
    path = new_path(spark, "star")
    current = materialise(edges.select(F.col("b").alias("hi"), F.col("a").alias("lo")), "star", path)
    while True:
        ends = current.groupBy(F.col("hi").alias("u")).agg(F.count("*").alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(current.select(F.col("lo").alias("u"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")).distinct())
        open_ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
        with shuffles_dropped(spark):
            done = open_ends.isEmpty()
        if done:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_least(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        following = new_path(spark, "star")
        step = materialise(moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(), "star", following)
        drop_path(spark, path)
        path, current = following, step


def near_classes(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, shared: int = SHARED) -> DataFrame:
    """One row per document: doc_id, fp, component_id, the smallest doc_id reachable over links.

    Null and blank texts have fingerprint 0 and link like any other; repeated rows stay;
    null doc_ids never become a component_id unless a class has no other; an empty table
    gives no rows; other columns of docs are ignored.
    """
    prints = materialise(fingerprints(docs, words), "prints")
    return classes_of(prints, components(links_within(prints, max_bits, shared)), "fp")


def classes_of(prints: DataFrame, stars: DataFrame, node: str) -> DataFrame:
    """doc_id, node, component_id per row of prints (doc_id, node), the smallest doc_id of the star."""
    first = prints.groupBy(F.col(node).alias("at")).agg(F.min("doc_id").alias("first"))
    # Written tables on both sides of each join: a root or a fingerprint that many rows share is a skewed key the adaptive plan splits.
    rooted = materialise(first.join(stars, first["at"] == stars["node"], "left").select("at", "first", F.coalesce("root", "at").alias("root")), "rooted")
    roots = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    classes = materialise(rooted.join(roots, "root").select(F.col("at").alias(node), "component_id"), "classes")
    return prints.join(classes, node).select("doc_id", node, "component_id")


def kept_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its class."""
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")


@keeps_columns("doc_id", "text")
def keep_one(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, shared: int = SHARED) -> DataFrame:
    """The documents of docs that are the smallest doc_id of their fingerprint class, all columns kept.

    Links are fingerprints only; near_copies.keep_one verifies similarity. doc_id names a
    document: rows that share one stay or go together, so exact copies are to be removed before.
    """
    return kept_of(docs, near_classes(docs, words, max_bits, shared))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, fingerprint (16 hex digits), component_id over all documents."""
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
