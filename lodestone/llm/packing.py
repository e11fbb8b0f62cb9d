"""Packing by cutting-stock column generation.

Every document becomes token ids, its end id last. Whole multiples of the
sequence length are cut off; what is left is a piece shorter than a sequence.
Piece lengths, rounded up to classes of WIDTH tokens, form a histogram of at most
2048 / WIDTH entries: the only thing the driver sees.

A linear program covers the histogram with patterns (how many pieces of each
class share a sequence). Its columns are generated: the duals of the current
basis price a pattern through an unbounded knapsack, solved by dynamic
programming over the capacity, until no pattern improves. Patterns are used as
often as their rounded-down share says; the few pieces this leaves are packed by
best fit. The resulting table, class by class, says which ranks go to which
sequences; its size depends on the number of classes, not on the input, so it is
broadcast.

Pieces are ranked within their class in two steps: within a bucket of a class by
a window, and between buckets by their counts, so no class meets in one task
however common it is. Offsets are running sums within a sequence, which holds at
most 2048 pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, each, materialise

MODEL = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
WIDTH = 8
#: Pieces of a class that are ranked together.
BUCKET_ROWS = 300
#: Most simplex steps; the basis is feasible after each, so stopping early only costs padding.
ROUNDS = 3000
#: Words of printable ASCII and Latin-1 letters, and, after lower-casing, their pre-tokens (the file's pattern on these characters).
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
#: Bytes of words and ids that a worker remembers.
MEMO_BYTES = 48 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class WordIds:
    """Ids of texts for a tokenizer that never merges across ASCII white space, which it drops; words are remembered.

    Valid for word_bpe_49k.json: its normaliser and pre-tokeniser work on the pieces
    between white space one by one and no special token contains white space. Words of
    printable ASCII and Latin-1 letters, which composition leaves as they are, are
    lower-cased and cut into pre-tokens here, and the file's merges run once for each
    remembered pre-token; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.alphabet = byte_alphabet()
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = self.held_parts = 0

    def part(self, token: str) -> bytes:
        """Ids of a pre-token."""
        known = self.parts.get(token)
        if known is None:
            mapped = token if token.isascii() else token.encode().decode("latin-1").translate(self.alphabet)
            known = little([t.id for t in self.merge(mapped)])
            self.parts[token] = known
            self.held_parts += len(known) + 150
        return known

    def word(self, data: bytes) -> bytes:
        text = data.decode()
        if (text.isascii() and text.isprintable() or SIMPLE.fullmatch(text)) and not ("<" in text and self.special.search(text)):
            lower = text.lower()
            return self.part(lower) if lower.isalpha() else b"".join(map(self.part, PRETOKENS.findall(lower)))
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        data = text or b""
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            # lower case comes anyway; before it, only a special token or a combining mark (CC.., CD.. in UTF-8) could tell
            data = data.translate(LOWER)
        words = data.split()
        memo = self.memo
        found = list(map(memo.get, words))
        if None in found:
            if self.held > MEMO_BYTES // 2:
                memo.clear()
                self.held = 0
            if self.held_parts > MEMO_BYTES // 2:
                self.parts.clear()
                self.held_parts = 0
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                w = words[at]
                value = memo.get(w)
                if value is None:
                    memo[w] = value = self.word(w)
                    self.held += len(w) + len(value) + 170
                found[at] = value
        return b"".join(found)


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> dict[int, str]:
    """str.translate table from bytes, as Latin-1 characters, to their printable stand-ins in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def cut(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of at most `length` tokens: doc_id, start, length, ids_crc32, doc_tokens; every id in exactly one."""
    end = little([END_ID])

    def run(batches):
        encode = word_ids(path).ids
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), each(b.column(1).cast(pa.binary())), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def rests(weights: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each capacity what is left of it after each item that fits; weights ascend."""
    return [c - weights[: int(np.searchsorted(weights, c, side="right"))] for c in range(capacity + 1)]


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int, left: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """The best multiset of items within the capacity: its value and how often each item occurs."""
    left = left or rests(weights, capacity)
    best, pick = np.zeros(capacity + 1), [-1] * (capacity + 1)
    for c in range(1, capacity + 1):
        top = best[c - 1]
        if len(left[c]):
            gains = best[left[c]] + values[: len(left[c])]
            i = gains.argmax()
            if gains[i] > top + 1e-12:
                top, pick[c] = gains[i], int(i)
        best[c] = top
    counts, c = np.zeros(len(values), dtype=int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= weights[pick[c]]
    return float(best[capacity]), counts


def column_generation(demand: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often the linear program uses each; class sizes and capacity are in units of WIDTH tokens.

    Revised simplex with the explicit inverse of the basis; it starts from one pattern
    per class that holds as many of it as fit.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], dtype=float)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    used, left = inverse @ need, rests(sizes, capacity)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, counts = knapsack(duals, sizes, capacity, left)
        if value <= 1 + 1e-7:
            break
        column = counts.astype(float)
        step = inverse @ column
        allowed = step > 1e-9
        ratios = np.where(allowed, used / np.where(allowed, step, 1.0), np.inf)
        leave = int(ratios.argmin())
        amount = ratios[leave]
        used = np.maximum(used - amount * step, 0.0)
        used[leave] = amount
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        columns[:, leave] = column
    return [({int(s): int(k) for s, k in zip(sizes, columns[:, j], strict=True) if k}, float(used[j])) for j in range(len(sizes))]


def round_patterns(fractional: list[tuple[dict[int, int], float]], demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of patterns that cover the demand exactly: shares rounded down, what is left by best fit, largest first."""
    left = {c: n for c, n in demand.items() if n > 0}
    whole: list[tuple[dict[int, int], int]] = []
    for pattern, share in sorted(fractional, key=lambda p: (-p[1], sorted(p[0].items()))):
        times = min([int(share + 1e-9), *(left[c] // k for c, k in pattern.items())])
        if times > 0:
            whole.append((pattern, times))
            for c, k in pattern.items():
                left[c] -= k * times
    free: list[tuple[int, dict[int, int]]] = []
    for c in sorted(left, reverse=True):
        for _ in range(left[c]):
            fitting = [(room, i) for i, (room, _) in enumerate(free) if room >= c]
            if fitting:
                room, i = min(fitting)
                free[i] = (room - c, free[i][1])
            else:
                free.append((capacity - c, {}))
                i = len(free) - 1
            free[i][1][c] = free[i][1].get(c, 0) + 1
    return whole + [(pattern, 1) for _, pattern in free]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces of the class a sequence, first sequence) for each pattern and class."""
    rows, taken, base = [], {}, 0
    for pattern, times in patterns:
        for c, k in sorted(pattern.items()):
            first = taken.get(c, 0)
            rows.append((c, first, first + k * times, k, base))
            taken[c] = first + k * times
        base += times
    return rows


def pack(pieces: DataFrame, length: int = LENGTH, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (any table with doc_id, start, length, ids_crc32), without splitting them."""
    spark = pieces.sparkSession
    width = min(width, length)
    capacity = length // width
    # Where width does not divide length, the longest pieces round up beyond the capacity; alone they fit.
    classed = pieces.withColumn("class", F.least(F.ceil(F.col("length") / width), F.lit(capacity)).cast("int"))
    demand = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most length / width rows
    patterns = round_patterns(column_generation(demand, capacity), demand, capacity)
    table = spark.createDataFrame(slots(patterns), "class int, first long, after long, each long, base long")
    buckets = spark.createDataFrame([(c, -(-n // bucket_rows)) for c, n in demand.items()], "class int, buckets long")
    place = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    spread = classed.join(F.broadcast(buckets), "class").withColumn("bucket", place).drop("buckets")
    counts = spread.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("class", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = spread.withColumn("inside", inside).join(starts, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    at = F.col("rank") - F.col("first")
    placed = (
        ranked.join(F.broadcast(table), ["class"])
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
        .withColumn("sequence_id", F.col("base") + F.floor(at / F.col("each")))
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone; a text of any length is cut
    whole; repeated rows are packed as often as they occur; a null doc_id stays null; an empty table gives no rows; other
    columns of docs are ignored.
    """
    bounded_batches(docs.sparkSession)
    return pack(materialise(cut(docs, path, length), "pieces"), length)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
