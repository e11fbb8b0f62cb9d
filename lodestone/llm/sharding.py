"""Resharding with the fewest moved bytes: minimum-cost flow over block transfers.

Documents belong to blocks, fixed by a hash of doc_id; a block is the unit that
moves. From the bytes of every block the driver, which sees BLOCKS numbers whatever
the input, builds a flow network: a source feeds each old shard with its bytes,
old shards send to new shards, new shards drain to a sink up to their capacity.
Bytes that stay in their shard cost nothing, bytes that move cost one each. The
flow is found by successive shortest paths with residual arcs. Whole blocks then
realise the flow of each pair of shards, largest first, so shards end within
about a block of their capacity.

Rows move once, into the partition and order of their new shard and block, and
the affected shards' files are written anew; a shard whose blocks did not change
is not rewritten. A row's slot is its rank inside its block plus the rows of the
shard's earlier blocks, so no shard is ever numbered in a single task.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, new_path

SHARDS = 24
#: Fixed number of blocks; also the bound on what the driver sees and broadcasts.
BLOCKS = 4096
OLD_SHARDS = 16
#: Bytes a row takes besides its text.
ROW_BYTES = 8


def block_of(blocks: int = BLOCKS) -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).cast("int")


def size_of() -> F.Column:
    """UTF-8 bytes of the text (null: none) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units sent from each supplier to each receiver with the least total cost; all supply is sent.

    Successive shortest paths (Bellman-Ford with a queue) in the residual network.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    head, to, room, price = [[] for _ in range(n + m + 2)], [], [], []

    def arc(u: int, v: int, r: int, c: int) -> None:
        head[u].append(len(to))
        to.append(v), room.append(r), price.append(c)
        head[v].append(len(to))
        to.append(u), room.append(0), price.append(-c)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    middle = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, sum(supply), cost(i, j))
    end = len(to)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    while True:
        far, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in head[u]:
                if room[e] > 0 and far[u] + price[e] < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = far[u] + price[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if sink not in far:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        sent = min(room[e] for e in path)
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
    return {(to[e ^ 1], to[e] - n): room[e ^ 1] for e in range(middle, end, 2) if room[e ^ 1] > 0}


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of the total, to the byte."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def assign_blocks(blocks: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """block -> new shard for block -> (old shard, bytes), by the flow, whole blocks, the largest first.

    A block goes to the receiver that still misses most of the flow from its old shard,
    its own shard first on ties.
    """
    old = sorted({o for o, _ in blocks.values()})
    supply = [sum(b for o, b in blocks.values() if o == k) for k in old]
    flow = min_cost_flow(supply, capacities(sum(supply), shards), lambda i, j: int(old[i] != j))
    missing = {(old[i], j): f for (i, j), f in flow.items()}
    placed: dict[int, int] = {}
    for block, (o, size) in sorted(blocks.items(), key=lambda x: (-x[1][1], x[0])):
        _, _, back = max(((f, j == o, -j) for (i, j), f in missing.items() if i == o), default=(0, True, -(o % shards)))
        placed[block] = -back
        missing[o, -back] = missing.get((o, -back), 0) - size
    return _level(blocks, placed, shards)


def _level(blocks: dict[int, tuple[int, int]], placed: dict[int, int], shards: int) -> dict[int, int]:
    """Moves small blocks from the fullest to the emptiest shard while that narrows their gap."""
    load = [0] * shards
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for b, j in placed.items():
        load[j] += blocks[b][1]
        inside[j].append((blocks[b][1], b))
    for _ in range(4 * len(blocks)):
        high, low = max(range(shards), key=lambda j: (load[j], -j)), min(range(shards), key=lambda j: (load[j], j))
        gap = load[high] - load[low]
        fitting = [(abs(gap - 2 * s), s, b) for s, b in inside[high] if 0 < s < gap]
        if not fitting:
            break
        _, s, b = min(fitting)
        inside[high].remove((s, b))
        inside[low].append((s, b))
        load[high] -= s
        load[low] += s
        placed[b] = low
    return placed


class Plan:
    """For each block its old and new shard, rows, bytes and the slot its first row takes."""

    def __init__(self, blocks: dict[int, tuple[int, int, int]], shards: int = SHARDS):
        placed = assign_blocks({b: (o, size) for b, (o, size, _) in blocks.items()}, shards)
        self.rows, next_slot = [], [0] * shards
        for b in sorted(placed):
            old, size, n = blocks[b]
            self.rows.append((b, old, placed[b], next_slot[placed[b]], size))
            next_slot[placed[b]] += n
        self.moved = sum(size for _, old, new, _, size in self.rows if old != new)
        held = {}
        for _, old, new, _, _ in self.rows:
            held.setdefault(new, set()).add(old)
        gone = {old for _, old, new, _, _ in self.rows if old != new}
        #: Shards whose files change: they get blocks from elsewhere or give some away.
        self.affected = sorted({j for j, from_ in held.items() if from_ != {j}} | gone)


def plan(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS) -> Plan:
    """The plan for docs, whose old layout has old_shards shards of consecutive blocks."""
    found = docs.select(block_of(blocks).alias("block"), size_of().alias("size")).groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return Plan({r["block"]: (r["block"] * old_shards // blocks, r["size"], r["rows"]) for r in found.collect()}, shards)  # at most `blocks` rows


def placed_rows(docs: DataFrame, plan_: Plan, blocks: int = BLOCKS) -> DataFrame:
    """docs with __shard and __slot; rows move once, to the partition and order of their shard and block."""
    table = docs.sparkSession.createDataFrame([(b, old, new, slot) for b, old, new, slot, _ in plan_.rows], "__at int, __old int, __shard int, __first long")
    keyed = docs.withColumn("__block", block_of(blocks)).join(F.broadcast(table), F.col("__block") == F.col("__at"))
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    inside = F.row_number().over(Window.partitionBy("__shard", "__block").orderBy("doc_id", tie)) - 1
    return keyed.withColumn("__slot", F.col("__first") + inside).select(*docs.columns, "__old", "__shard", "__slot")


def rewrite(docs: DataFrame, plan_: Plan, path: str, blocks: int = BLOCKS) -> None:
    """Writes the files of the affected shards under path, one folder a shard; others stay as they are."""
    changed = placed_rows(docs, plan_, blocks).where(F.col("__shard").isin(plan_.affected)) if plan_.affected else placed_rows(docs, plan_, blocks).where("false")
    changed.drop("__old").write.partitionBy("__shard").parquet(path)


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, text, shard, slot of every row, read back from the rewritten files; unaffected shards come from docs.

    Null texts take ROW_BYTES bytes; rows that repeat a doc_id share its block and have
    slots of their own; a null doc_id has a block like any other; an empty table gives no
    rows and no files; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan_ = plan(rows, shards, old_shards, blocks)
    if not plan_.rows:
        return materialise(rows.select("doc_id", "text", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false"), "shards")
    path = new_path(spark, "shards")
    rewrite(rows, plan_, path, blocks)
    names = ["doc_id", "text", F.col("__shard").alias("shard"), F.col("__slot").alias("slot")]
    written = spark.read.schema("doc_id long, text string, __slot long, __shard int").parquet(path).select(*names)
    whole = set(range(shards)) - set(plan_.affected)
    if not whole & {new for _, _, new, _, _ in plan_.rows}:
        return written
    return written.unionByName(placed_rows(rows, plan_, blocks).where(F.col("__shard").isin(sorted(whole))).select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents in 24 shards of near equal bytes, read back from the shards' files."""
    found = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select(
        "doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
