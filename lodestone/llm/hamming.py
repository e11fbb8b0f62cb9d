"""All links of 64-bit fingerprints within any Hamming radius, by pigeonhole blocks compared in buckets.

The bits are cut into m blocks. Two fingerprints within r bits differ in at most r
blocks, so they agree on m - r whole blocks: each choice of m - r blocks is a key, and
a linked pair shares at least one. Buckets of a key are streamed through a task in
key order and compared there with vectorised popcounts; what leaves the task is a
spanning forest of the bucket's verified links, at most one row a member, never all pairs.

A bucket with more than TILE distinct fingerprints is cut into tiles, and every pair
of tiles is compared in its own group: no task ever holds more than two tiles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 2048
#: Groups up to this size are compared together along diagonals.
SMALL = 48


def masks(blocks: int, shared: int) -> list[int]:
    """Bit masks of the keys as signed 64-bit integers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    found = []
    for chosen in combinations(range(blocks), shared):
        m = sum(1 << bit for b in chosen for bit in range(cuts[b], cuts[b + 1]))
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the links (a[i], b[i]) that join two trees, in order."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept.append(i)
    return kept


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def small_links(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside equal, contiguous group numbers, compared along diagonals."""
    out_a, out_b = [], []
    for step in range(1, len(fp)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        hit = np.flatnonzero(same & (_far(fp[step:], fp[:-step]) <= max_bits))
        out_a.append(fp[hit])
        out_b.append(fp[hit + step])
    if not out_a:
        return fp[:0], fp[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def large_links(fp: np.ndarray, tile: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one group; with two tiles only links across them, the rest is another group's."""
    out_a, out_b = [], []
    two = tile.min() != tile.max()
    for at in range(0, len(fp), 256):
        x, t = fp[at : at + 256], tile[at : at + 256]
        near = _far(x[:, None], fp[None, :]) <= max_bits
        if two:
            near &= t[:, None] != tile[None, :]
        i, j = np.nonzero(near)
        keep = i + at < j
        a, b = x[i[keep]], fp[j[keep]]
        chosen = forest(a, b)
        out_a.append(a[chosen])
        out_b.append(b[chosen])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    chosen = forest(a, b)
    return a[chosen], b[chosen]


def links_within(prints: DataFrame, max_bits: int, shared: int, by: tuple[str, ...] = (), equal: str | None = None) -> DataFrame:
    """Distinct pairs (a < b) of fingerprints (column fp) that connect all those within max_bits of each other.

    shared blocks of max_bits + shared make a key. More of them mean more keys a
    fingerprint, but smaller buckets: with 64 * shared / (max_bits + shared) bits a key, n
    fingerprints meet in buckets of about n / 2**bits. The links are the same for any value.

    Only rows with the same values in the columns `by` are compared. With a column `equal`,
    a fingerprint of rows that differ in it has a row too, with a = b.
    """
    several = [] if equal is None else [(F.min(F.xxhash64(equal)) < F.max(F.xxhash64(equal))).alias("several")]
    nodes = prints.groupBy("fp", *by).agg(*several) if several else prints.select("fp", *by).distinct()
    blocks = max_bits + shared
    cut = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i), *by) for i, m in enumerate(masks(blocks, shared))]
    keys = nodes.select("fp", F.explode(F.array(*cut)).alias("key"))  # should two blocks have one hash, their rows are compared for nothing
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = keys.join(met, "key").select("key", "fp", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    groups = tiled.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "fp")

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def close(table: pa.Table) -> pa.RecordBatch:
            key = [table.column(c).to_numpy() for c in range(3)]
            tile, fp = table.column(3).to_numpy(), table.column(4).to_numpy().view(np.uint64)
            new = np.ones(len(fp), dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            number = np.cumsum(new) - 1
            size = np.bincount(number)
            few = size[number] <= SMALL
            a, b = small_links(number[few], fp[few], max_bits)
            out_a, out_b = [a], [b]
            starts = np.flatnonzero(new)
            for g in np.flatnonzero(size > SMALL):
                part = slice(starts[g], starts[g] + size[g])
                a, b = large_links(fp[part], tile[part], max_bits)
                out_a.append(a)
                out_b.append(b)
            x, y = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for b in batches:  # a batch is closed up to the start of its last group, which the next one may continue
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*kept, b])
            key = [table.column(c).to_numpy() for c in range(3)]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield close(table.slice(0, cut))
            kept = table.slice(cut).to_batches()
        if kept:
            yield close(pa.Table.from_batches(kept))

    ordered = groups.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    links = ordered.mapInArrow(run, "a long, b long").where("a < b").distinct()
    return links.unionByName(nodes.where("several").select(F.col("fp").alias("a"), F.col("fp").alias("b"))) if several else links
