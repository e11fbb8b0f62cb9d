"""Exact de-duplication with a log-structured merge index.

Memtable: every task keeps a table from digest to the best row seen so far, with
the normalised bytes of the entry's first text. A repeated digest inside the
memtable is a hit and is verified by comparing bytes. A full memtable is flushed
as a run: its rows sorted by digest, written to the shared folder, with a Bloom
filter of the run's digests beside it.

Compaction merges all runs by digest in one level and keeps the best identifier: most
code points in the original text, then the smallest doc_id. A digest that stands in
two or more runs is a hit across runs: its bytes are read back, only for rows that pass
a filter over the hit digests, and compared with the bytes of the first run that holds
it. The filter has BITS_AN_ENTRY bits a hit; where that is more than FILTER_BITS, the
hits are read back in several passes, each with a part of the digests and a filter of
its own. Entries whose bytes differ although their digests agree become classes of their
own, keyed by a second digest.

The runs' own filters serve probe(), the lookup of new texts in an index that exists: a
run whose filter lacks them all is passed over. A whole build does not gain from them,
since nearly every run holds some hit.

One run holds at most one entry per distinct text, so a text that makes up a
third of all rows reaches compaction as one entry per run.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACE, each, keeps_columns, materialise

#: A memtable is flushed once its entries hold so many bytes of text or so many rows.
MEMTABLE_BYTES = 24 << 20
MEMTABLE_ROWS = 100_000
#: Bits of a filter for each digest, and most bits of the broadcast filter of a pass: 2**27 are 16 MB, for 13 million hits.
BITS_AN_ENTRY = 10
FILTER_BITS = 1 << 27
PROBES = 4

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("variant", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("entry", T.BooleanType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("filter", T.BinaryType()),
    ]
)


def normalise(text: bytes | None) -> bytes:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return (text or b"").translate(None, SPACE)


def positions(digest: bytes, bits: int) -> list[int]:
    """The filter positions of a digest: PROBES slices of it, modulo the size."""
    d = digest.ljust(8 * PROBES, b"\0") if len(digest) < 8 * PROBES else digest
    return [int.from_bytes(d[8 * i : 8 * i + 8], "big") % bits for i in range(PROBES)]


def bits_for(entries: int) -> int:
    """The power of two that gives each entry BITS_AN_ENTRY bits."""
    return max(64, 1 << (BITS_AN_ENTRY * max(1, entries) - 1).bit_length())


def run_filter(digests: list[bytes]) -> bytes:
    """Bloom filter of a run, about 10 bits an entry; the size is in its length."""
    bits = bits_for(len(digests))
    at = np.zeros(bits, dtype=bool)
    for d in digests:
        at[positions(d, bits)] = True
    return np.packbits(at).tobytes()


def may_contain(filter_: bytes, digest: bytes) -> bool:
    """False only if the run certainly lacks the digest."""
    return all(filter_[p >> 3] >> (7 - (p & 7)) & 1 for p in positions(digest, len(filter_) * 8))


def _digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


class Memtable:
    """Entries by (digest, variant); variant tells texts with the same digest but other bytes apart."""

    def __init__(self, digest=_digest):
        self.digest, self.entries, self.rows, self.size = digest, {}, [], 0

    def add(self, doc_id, text: bytes | None, n_chars: int) -> None:
        body = normalise(text)
        d = self.digest(body)
        bodies = self.entries.setdefault(d, [])
        variant = next((i for i, known in enumerate(bodies) if known == body), len(bodies))
        first = variant == len(bodies)
        if first:
            bodies.append(body)
            self.size += len(body)
        self.rows.append((d, variant, doc_id, n_chars, first))

    def full(self) -> bool:
        return self.size >= MEMTABLE_BYTES or len(self.rows) >= MEMTABLE_ROWS

    def flush(self) -> pa.RecordBatch:
        """The run, sorted by digest; the filter stands in the first row."""
        run = uuid.uuid4().hex
        self.rows.sort(key=lambda r: (r[0], r[1], not r[4]))
        bloom = run_filter(list(self.entries))
        cols = [
            [run] * len(self.rows),
            [r[0] for r in self.rows],
            [r[1] for r in self.rows],
            list(range(len(self.rows))),
            [r[2] for r in self.rows],
            [r[3] for r in self.rows],
            [r[4] for r in self.rows],
            [self.entries[r[0]][r[1]] if r[4] else None for r in self.rows],
            [bloom] + [None] * (len(self.rows) - 1),
        ]
        types = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.name for f in RUN_SCHEMA.fields])
        self.entries, self.rows, self.size = {}, [], 0
        return batch


def flush_runs(docs: DataFrame, digest=_digest) -> DataFrame:
    """The runs of docs: one row per document, written sorted by digest to the shared folder."""

    def run(batches):
        table = Memtable(digest)
        for b in batches:
            for doc_id, text, n in zip(b.column(0).to_pylist(), each(b.column(1).cast(pa.binary())), b.column(2).to_pylist(), strict=True):
                table.add(doc_id, text, n)
                if table.full():
                    yield table.flush()
        if table.rows:
            yield table.flush()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return materialise(rows.mapInArrow(run, RUN_SCHEMA), "runs")


def probe(runs: DataFrame, texts: list[str | None], digest=_digest) -> DataFrame:
    """Entries of the index that equal one of the texts: the point lookup for a batch of new documents.

    The batch is a parameter of bounded size. Each run's filter stands in its first row, and
    a run whose filter rules out the whole batch is passed over; in the others a hit is
    verified by its bytes. Returns run, digest, doc_id, n_chars.
    """
    bodies = {}
    for t in texts:
        body = normalise(t.encode() if t is not None else None)
        bodies.setdefault(digest(body), set()).add(body)
    asked = runs.sparkSession.sparkContext.broadcast(bodies)

    def run(batches):
        current, wanted = None, {}
        for b in batches:
            out = []
            for run_id, d, doc_id, n, body, bloom in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if run_id != current:  # a split that begins inside a run has no filter and reads on
                    current = run_id
                    wanted = asked.value if bloom is None else {k: v for k, v in asked.value.items() if may_contain(bloom, k)}
                if d in wanted and body in wanted[d]:
                    out.append((run_id, d, doc_id, n))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["run", "digest", "doc_id", "n_chars"])

    entries = runs.where("entry").select("run", "digest", "doc_id", "n_chars", "body", "filter")
    return entries.mapInArrow(run, "run string, digest binary, doc_id long, n_chars long")


#: Parts a filter is merged in.
SLICES = 64


def hit_filter(hits: DataFrame, bits: int) -> bytes:
    """A filter of that many bits over the digests of hits: each task makes its own, they are OR-ed in slices."""

    def part(batches):
        at = np.zeros(bits, dtype=bool)
        for b in batches:
            for d in b.column(0).to_pylist():
                at[positions(d, bits)] = True
        slices = np.packbits(at.reshape(SLICES, -1), axis=1)
        some = [i for i in range(SLICES) if slices[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slices[i].tobytes() for i in some], pa.binary())], ["slice", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, one in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(one, dtype=np.uint8)
                held[i] = own | held[i] if i in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])

    schema = "slice int, bits binary"
    merged = hits.select("digest").mapInArrow(part, schema).repartition(SLICES, "slice").mapInArrow(merge, schema)
    out = [np.zeros(bits // SLICES // 8, dtype=np.uint8) for _ in range(SLICES)]
    for r in merged.collect():  # at most SLICES slices, `bits` in all
        out[r["slice"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return b"".join(x.tobytes() for x in out)


def fetched(entries: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
    """run, digest, variant, body of the entries that may be hits, as the filter over hits says."""
    filter_ = hits.sparkSession.sparkContext.broadcast(hit_filter(hits, bits))

    def passing(batches):
        for b in batches:
            yield b.filter(pa.array([may_contain(filter_.value, d) for d in b.column(1).to_pylist()], pa.bool_()))

    return entries.select("run", "digest", "variant", "body").mapInArrow(passing, "run string, digest binary, variant int, body binary")


def confirmed_keys(runs: DataFrame) -> DataFrame:
    """(run, digest, variant, key) of the entries found in several runs; key tells unequal bytes apart."""
    entries = runs.where("entry")
    hits = materialise(entries.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("run", "variant")).alias("first")).where("n > 1"), "hits")
    count = hits.count()
    passes = max(1, -(-bits_for(count) // FILTER_BITS))
    bits = max(8 * SLICES, bits_for(-(-count // passes)))
    turn = lambda i: F.pmod(F.xxhash64("digest"), F.lit(passes)) == i
    found = reduce(DataFrame.unionByName, [fetched(entries.where(turn(i)), hits.where(turn(i)), bits) for i in range(passes)])
    held = materialise(found.join(hits.select("digest", "first"), "digest"), "bodies")
    is_first = (F.col("first.run") == F.col("run")) & (F.col("first.variant") == F.col("variant"))
    firsts = held.where(is_first).select("digest", F.col("body").alias("first_body"))
    same = held.join(firsts, "digest")
    other = F.concat(F.col("digest"), F.unhex(F.sha2("body", 512)))
    return same.select("run", "digest", "variant", F.when(F.col("body") == F.col("first_body"), F.col("digest")).otherwise(other).alias("key"))


def exact_classes(docs: DataFrame, digest=_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, key.

    Null texts count as empty, empty and blank texts are equal to each other; rows that
    repeat a doc_id and its text are members of one group and, if theirs is the kept
    doc_id, only one of them is kept; a null doc_id comes after all others; a text of any
    length counts whole; an empty table gives no rows; other columns of docs are ignored.
    """
    runs = flush_runs(docs, digest)
    keys = confirmed_keys(runs)
    members = runs.select("run", "digest", "variant", "seq", "doc_id", "n_chars")
    keyed = materialise(members.join(keys, ["run", "digest", "variant"], "left").withColumn("key", F.coalesce("key", "digest")), "keyed")
    best = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("doc_id").isNull().alias("absent"), "doc_id", "run", "seq"))
    groups = materialise(keyed.groupBy("key").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    kept = (F.col("best.run") == F.col("run")) & (F.col("best.seq") == F.col("seq"))
    return keyed.join(groups, "key").select(keyed.doc_id, F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "key")


@keeps_columns("doc_id", "text")
def keep_first(docs: DataFrame) -> DataFrame:
    """The kept documents of docs with all columns; a doc_id repeated with an equal text counts once.

    Texts move once: kept rows and documents meet on one key of doc_id and digest. Of rows
    that share it the one with the most code points stays, then the greater text, then the
    row whose other columns are least by hash, so reruns agree.
    """
    key = lambda doc_id, digest: F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/"), F.hex(digest))
    kept = exact_classes(docs).where("kept").select(key(F.col("doc_id"), F.col("digest")).alias("kept_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("kept_key", key(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.translate(text, SPACE.decode(), ""), 256))))
    met = keyed.join(kept, "kept_key", "left_semi")
    best = Window.partitionBy("kept_key").orderBy(F.desc(F.length(text)), F.desc("text"), F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t)))
    return met.withColumn("kept_place", F.row_number().over(best)).where("kept_place = 1").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, keep_id, group_size, kept, text_sha256 over all documents."""
    found = exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM g
"""
