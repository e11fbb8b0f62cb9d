"""Posting lists of letter groups that propose documents for a needle; containment is then verified on the text.

A text's grams are all its runs of one, two and three characters, lower-cased, the two
small sigmas taken as one. A text that holds a needle holds all the needle's grams, those
of three characters if it is that long, else the needle itself, so no needle is too short.
Postings hold a row a gram and block of BLOCK documents, so no list grows with the corpus,
however common its gram; they are written in files sorted by gram, so a lookup reads
the row groups of its grams. Texts move once when the index is built and never when it is asked:
documents keep the order they were written in, and proposals are turned into ranges of places that
the scan's filter skips to.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..shared import delete, get, kept, new_path, put

#: Documents a posting row may name, below 2**16; bytes of text whose postings make up one file.
BLOCK, FILE_BYTES = 4096, 32 << 20
#: Characters whose grams are sorted at a time; that few have distinct numbers below 2**17. Postings that are merged at a time.
PIECE, MERGED = (1 << 17) - 2, 1 << 20
#: Rarest grams of a needle that are looked up.
RAREST = 24
#: Proposals the driver turns into ranges, and most ranges; more proposals meet the texts in a join.
FEW, RANGES = 20_000, 64
PLACE = "index_place"
POSTINGS = "gram string, block long, places array<int>, n int"


def folded(text: Column) -> Column:
    """What grams are taken from."""
    return F.translate(F.lower(text), "ς", "σ")


def _piece(texts: list[str], offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (gram, offset) of at most PIECE characters; a gram is its characters plus one, 21 bits each, from the left."""
    sizes = [len(t) for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters, x = np.unique(points, return_inverse=True)
    x, own = x.astype(np.uint64) + np.uint64(1), np.repeat(np.array(offsets, np.uint64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))  # characters up to the end of the text
    two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    one = x << np.uint64(46) | own
    pair = one[two] | x[two + 1] << np.uint64(29)
    triple = one[three] | x[three + 1] << np.uint64(29) | x[three + 2] << np.uint64(12)
    keys = np.unique(np.concatenate([one, pair, triple]))
    points = np.append(np.uint64(0), letters.astype(np.uint64) + np.uint64(1))
    low = np.uint64((1 << 17) - 1)
    gram = points[keys >> np.uint64(46)] << np.uint64(42) | points[keys >> np.uint64(29) & low] << np.uint64(21) | points[keys >> np.uint64(12) & low]
    return gram, (keys & np.uint64(4095)).astype(np.uint16)


def _names(grams: np.ndarray) -> list[str]:
    """The grams as text, in order."""
    part = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & np.uint64((1 << 21) - 1), grams & np.uint64((1 << 21) - 1)], axis=1).astype(np.uint32)
    size = (part > 0).sum(axis=1)
    text = np.where(part > 0, part - np.uint32(1), 0).astype("<u4").tobytes().decode("utf-32-le")
    return [text[3 * i : 3 * i + n] for i, n in enumerate(size.tolist())]


def posting_rows(batches):
    """gram, block, places, n (how many) of rows (block, offset, text) that come in order of block and offset.

    Grams are made and sorted as numbers, in pieces, and merged by ranges of grams, so
    beside a block's postings, ten bytes each, little is held.
    """

    def merged(block: int, pieces: list[tuple[np.ndarray, np.ndarray]]):
        total = sum(len(g) for g, _ in pieces)
        some = np.sort(np.concatenate([g[:: max(1, len(g) // 64)] for g, _ in pieces]))
        cuts = np.unique(some[:: max(1, len(some) * MERGED // total)])[1:]
        ends = [[0, *np.searchsorted(g, cuts).tolist(), len(g)] for g, _ in pieces]
        for i in range(len(cuts) + 1):
            gram, place = (np.concatenate([p[c][e[i] : e[i + 1]] for p, e in zip(pieces, ends, strict=True)]) for c in (0, 1))
            order = np.argsort(gram, kind="stable")  # offsets come in order
            gram, place = gram[order], place[order]
            new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
            keep = new | np.append(True, place[1:] != place[:-1])[: len(gram)]  # a long text's pieces share grams
            gram, place, new = gram[keep], place[keep], new[keep]
            if not len(gram):
                continue
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(gram)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(_names(gram[starts]), pa.string()), pa.array(np.full(len(starts), block, np.int64)), places, pa.array(np.diff(bounds))], ["gram", "block", "places", "n"])

    current, pieces, texts, offsets, held = None, [], [], [], 0
    for b in batches:
        for block, offset, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_py()
            if block != current:
                if texts:
                    pieces.append(_piece(texts, offsets))
                if pieces:
                    yield from merged(current, pieces)
                current, pieces, texts, offsets, held = block, [], [], [], 0
            for at in range(0, max(1, len(text) - 2), PIECE - 2):  # parts of long texts overlap by two characters
                part = text[at : at + PIECE]
                if held + len(part) > PIECE:
                    pieces.append(_piece(texts, offsets))
                    texts, offsets, held = [], [], 0
                if part:
                    texts.append(part), offsets.append(offset)
                    held += len(part)
    if texts:
        pieces.append(_piece(texts, offsets))
    if pieces:
        yield from merged(current, pieces)


def needle_grams(needle: str, as_written: bool = False) -> set[str]:
    """Grams that every text with the needle holds; none says that all texts may hold it.

    A needle that is compared with the lower-cased text is taken as it is. One that is
    compared as written is lower-cased here, of which only ASCII runs are sure to come out as they do in Spark.
    """
    parts = re.findall(r"[\x00-\x7f]+", needle) if as_written else [needle]
    folded = [(p.lower() if as_written else p).replace("ς", "σ") for p in parts]
    return {p[i : i + 3] for p in folded for i in range(max(1, len(p) - 2)) if p}


def cover(places: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges that hold all places, cut at the widest gaps."""
    ordered = sorted(set(places))
    gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])[: most - 1]
    starts = [0, *sorted(i for i in gaps if ordered[i] > ordered[i - 1] + 1)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(starts, [*starts[1:], len(ordered)], strict=True)] if ordered else []


@dataclass
class GramIndex:
    """The stored texts, postings and frequencies of one column of documents."""

    spark: SparkSession
    path: str
    column: str
    rows: int

    @classmethod
    def build(cls, docs: DataFrame, column: str = "text", path: str | None = None, file_bytes: int = FILE_BYTES) -> GramIndex:
        """Indexes every row; a null text is stored and never found, an empty one has no grams. What `path` held before is replaced."""
        if PLACE in docs.columns:
            raise ValueError(f"documents have a column {PLACE} already")
        spark = docs.sparkSession
        path = path or new_path(spark, "grams")
        delete(spark, path)
        docs.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        block, offset = F.floor(F.col(PLACE) / BLOCK).alias("block"), F.pmod(PLACE, F.lit(BLOCK)).cast("int").alias("offset")
        facts = texts.select(block, F.octet_length(column).alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.countDistinct("block").alias("blocks")).first()
        files = max(1, (facts["size"] or 0) // file_bytes, min(facts["blocks"], spark.sparkContext.defaultParallelism))
        dealt = texts.where(F.col(column).isNotNull()).select(block, offset, folded(F.col(column)).alias("text")).repartition(files, "block").sortWithinPartitions("block", "offset")
        dealt.mapInArrow(posting_rows, POSTINGS).sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
        counted = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
        counted.sortWithinPartitions("gram").write.parquet(f"{path}/frequencies")
        put(spark, f"{path}/grams.json", json.dumps({"column": column, "rows": facts["n"]}))
        return cls(spark, path, column, facts["n"])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GramIndex:
        saved = json.loads(get(spark, f"{path}/grams.json"))
        return cls(spark, path, saved["column"], saved["rows"])

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self._table("postings", POSTINGS)

    def frequencies(self) -> DataFrame:
        return self._table("frequencies", "gram string, n long")

    def proposed(self, needed: set[str]) -> DataFrame | None:
        """Places of the documents that hold the rarest of the needed grams; None says all documents."""
        if not needed:
            return None
        known = {r["gram"]: r["n"] for r in self.frequencies().where(F.col("gram").isin(sorted(needed))).collect()}  # at most a row a gram of the needle
        if len(known) < len(needed):
            return self.spark.createDataFrame([], f"{PLACE} long")
        chosen = sorted(known, key=lambda g: (known[g], g))[:RAREST]
        lists = self.postings().where(F.col("gram").isin(chosen)).groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(chosen))
        shared = F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))  # RAREST lists of at most BLOCK
        return lists.select(F.explode(F.transform(shared, lambda at: F.col("block") * BLOCK + at)).alias(PLACE))

    def _union(self, alternatives: list[set[str]]) -> DataFrame | None:
        found = [self.proposed(needed) for needed in alternatives]
        return None if any(f is None for f in found) else reduce(DataFrame.unionByName, found).distinct()

    def _read(self, alternatives: list[set[str]]) -> DataFrame:
        """The texts among which are all that hold the grams of an alternative."""
        places = self._union(alternatives)
        if places is None:
            return self.texts()
        few = places.limit(FEW + 1).toArrow().column(0).to_pylist()  # at most FEW + 1 numbers
        if len(few) > FEW:
            return self.texts().join(places, PLACE, "left_semi")
        near = [F.col(PLACE).between(a, b) for a, b in cover(few)]
        return self.texts().where(reduce(Column.__or__, near) if near else F.lit(False))

    def text_search(self, query: str) -> DataFrame:
        """The rows search.text_search() finds: the first word as written, all others in any case."""
        first, *others = query.split() or [""]
        if not first:
            return self.texts().where("false").drop(PLACE)
        needed = needle_grams(first, as_written=True).union(*(needle_grams(w.lower()) for w in others))
        return self._read([needed]).where(X.contains_all_words(F.col(self.column), query)).drop(PLACE)

    def containing_any(self, needles: list[str]) -> DataFrame:
        """The rows whose lower-cased text holds one of the needles; an empty needle is in every text that is not null."""
        if not needles:
            return self.texts().where("false").drop(PLACE)
        wanted = X.contains_any(F.col(self.column), F.array(*(F.lit(w) for w in needles)))
        return self._read([needle_grams(w) for w in needles]).where(wanted).drop(PLACE)

    def keyword_search(self, description: str) -> DataFrame:
        """The rows search.keyword_search() finds."""
        return self.containing_any(X.search_keywords(description))

    def share(self, needles: list[str], as_written: bool = False) -> float:
        """Share of the documents that the index proposes for texts with all the needles."""
        places = self.proposed(set().union(*(needle_grams(w, as_written) for w in needles)))
        return 1.0 if places is None else places.count() / max(1, self.rows)

    def matches(self, needles: DataFrame) -> DataFrame:
        """needle_id and the document's columns, for every row of needles (needle_id, needle) and document whose lower-cased text holds it.

        Any number of needles: their rarest grams meet the postings in a join. A null or
        empty needle finds nothing; repeated rows of needles count as one.
        """
        asked = needles.select("needle_id", "needle").where("needle <> ''").distinct()

        def spread(batches):
            for b in batches:
                found = [sorted(needle_grams(w)) for w in b.column(1).to_pylist()]
                yield b.append_column("grams", pa.array(found, pa.list_(pa.string())))

        kind = needles.schema["needle_id"].dataType.simpleString()
        each = asked.mapInArrow(spread, f"needle_id {kind}, needle string, grams array<string>").select("needle_id", "needle", F.explode("grams").alias("gram"))
        rare = Window.partitionBy("needle_id", "needle").orderBy(F.coalesce("n", F.lit(0)), "gram")
        chosen = each.join(self.frequencies(), "gram", "left").withColumn("rn", F.row_number().over(rare)).where(F.col("rn") <= RAREST)
        chosen = chosen.withColumn("wanted", F.count("*").over(Window.partitionBy("needle_id", "needle")))  # at most RAREST rows
        chosen = kept(chosen.select("needle_id", "needle", "gram", "wanted"), "needle-grams")
        chosen = F.broadcast(chosen) if chosen.limit(FEW + 1).count() <= FEW else chosen  # few stay off the postings' shuffle
        lists = chosen.join(self.postings().drop("n"), "gram").groupBy("needle_id", "needle", "block").agg(F.collect_list("places").alias("lists"), F.first("wanted").alias("wanted"))
        shared = F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        places = lists.where(F.size("lists") == F.col("wanted")).select("needle_id", "needle", F.explode(F.transform(shared, lambda at: F.col("block") * BLOCK + at)).alias(PLACE))
        places = kept(places, "proposed")  # of known size, so that Spark need not shuffle the texts for few
        met = places.withColumnsRenamed({"needle": "index_needle", "needle_id": "index_needle_id"}).join(self.texts().withColumn("index_lower", F.lower(self.column)), PLACE)  # once a text, not once a pair
        met = met.where(F.contains("index_lower", F.col("index_needle"))).drop(PLACE, "index_needle", "index_lower")
        return met.toDF("needle_id", *met.columns[1:])
