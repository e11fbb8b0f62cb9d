"""Exact cosine search with filters before the cut, batched queries, duplication and text baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import paths as P
from ..functions import text as X

#: Default numbers of hits.
SEARCH_LIMIT, CONTEXT_LIMIT, SCOPE_LIMIT, PATTERN_LIMIT, DUPLICATION_LIMIT = 10, 3, 20, 20, 10


def cosine(vectors: DataFrame, queries: list[tuple[int, list[float]]], keep: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, vec_id, score: per Arrow batch the best `keep` vectors of each query, exact in double precision.

    One matrix product a batch, on the executors; at most keep rows a query leave a batch,
    so the global ranking sorts few rows however many vectors there are. Ties go to the
    smaller key; a vector that equals its query's key is left out; null and empty vectors
    score 0.
    """
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            m = _matrix(b.column(1), matrix.shape[1])
            length = np.outer(norms, np.linalg.norm(m, axis=1))
            scores = np.divide(matrix @ m.T, length, out=np.zeros((len(ids), len(m))), where=length > 0)
            out_q, out_k, out_s = [], [], []
            for i, q in enumerate(ids):
                allowed = np.flatnonzero(keys != q)
                own = scores[i][allowed]
                if len(own) > keep:  # all that reach the keep-th best score, so that ties are settled by key
                    fitting = own >= np.partition(own, len(own) - keep)[len(own) - keep]
                    allowed, own = allowed[fitting], own[fitting]
                order = np.lexsort((keys[allowed], -own))[:keep]
                out_q += [q] * len(order)
                out_k += keys[allowed][order].tolist()
                out_s += own[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_k, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", key, "score"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, f"query_id long, {key} long, score double")


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles; null vectors and those of another length are zero."""
    if not vectors.null_count:
        flat = vectors.flatten()
        if len(flat) == len(vectors) * size and not flat.null_count and (np.diff(vectors.offsets.to_numpy()) == size).all():
            return flat.to_numpy().astype(np.float64).reshape(-1, size)
    return np.array([r if r is not None and len(r) == size and None not in r else [0.0] * size for r in vectors.to_pylist()], dtype=np.float64).reshape(-1, size)


def nearest(vectors: DataFrame, query: tuple[int, list[float]], k: int = SEARCH_LIMIT, where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows of vectors to one query, all columns, with query_id, rank and score; `where` holds before the cut.

    One pass of built-in functions, at most k rows leave a task; the same values as cosine().
    """
    own, values = query
    rows = vectors.where(where) if where is not None else vectors
    asked = F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    length = F.sqrt(total(F.transform(v, lambda x: x * x))) * F.lit(float(np.linalg.norm(np.array(values, dtype=np.float64))))
    dot = total(F.zip_with(v, asked, lambda x, y: x * y))
    score = F.when((F.size(vector) == len(values)) & (length > 0), F.coalesce(dot / length, F.lit(0.0))).otherwise(F.lit(0.0))
    best = rows.where(F.col(key) != own).withColumn("score", score).orderBy(F.desc("score"), key).limit(k)
    return best.select(F.lit(own).cast("long").alias("query_id"), "*", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))  # k rows


def top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = SEARCH_LIMIT, where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, vec_id, rank, score (unrounded) of the k nearest; `where` holds before the cut."""
    rows = vectors.where(where) if where is not None else vectors
    found = cosine(rows, queries, k, vector, key)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_blocks(vectors: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, vector: str = "embedding", key: str = "vec_id", block: int = 2048) -> DataFrame:
    """top_k for any number of queries, rows of a table: each block of queries meets each block of vectors in its own group, nothing goes to the driver."""
    n, m = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    own = lambda size: F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
    cols = [F.col(key).cast("long").alias(key), F.col(vector).alias(vector)]
    asking = queries.select(*cols, F.lit(True).alias("asks"), own(n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    base = vectors.select(*cols, F.lit(False).alias("asks"), own(m).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        q, v = table.filter(asks), table.filter(pa.compute.invert(asks))
        out_q, out_k, out_s = [], [], []
        sizes = pa.compute.fill_null(pa.compute.list_value_length(q.column(vector)), 0).to_numpy()
        for size in np.unique(sizes).tolist() if v.num_rows else []:  # vectors of another size than the query's score 0
            asked = q.filter(pa.array(sizes == size))
            a, b = (_matrix(t.column(vector).combine_chunks(), max(1, size)) for t in (asked, v))
            keys = v.column(key).to_numpy()
            lengths, own_length = np.linalg.norm(b, axis=1), np.linalg.norm(a, axis=1)
            for i, one in enumerate(asked.column(key).to_pylist()):
                length = own_length[i] * lengths
                scores = np.divide(b @ a[i], length, out=np.zeros(len(b)), where=length > 0)
                allowed = np.flatnonzero(keys != one)
                order = allowed[np.lexsort((keys[allowed], -scores[allowed]))[:k]]
                out_q += [one] * len(order)
                out_k += keys[order].tolist()
                out_s += scores[order].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), key: pa.array(out_k, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = asking.unionByName(base).groupBy("i", "j").applyInArrow(run, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_vectors(vectors: DataFrame, where: Column, vector: str = "embedding", key: str = "vec_id") -> list[tuple[int, list[float]]]:
    """The stated query set, read to the driver; a parameter of the search."""
    return [(r[0], list(r[1])) for r in vectors.where(where).select(key, vector).orderBy(key).collect()]


def duplication(vectors: DataFrame, queries: list[tuple[int, list[float]]], threshold: float = 0.8, k: int = DUPLICATION_LIMIT, keep: int = 3) -> DataFrame:
    """Of the top k those with a similarity of at least the threshold, the first `keep`, rounded to two digits."""
    hits = top_k(vectors, queries, k).where(F.col("score") >= threshold)
    return hits.where(F.col("rank") <= keep).select("query_id", "vec_id", F.round("score", 2).alias("similarity"))


def duplication_summary(vectors: DataFrame, queries: list[tuple[int, list[float]]], threshold: float = 0.8) -> DataFrame:
    """One row a query: whether something similar exists, and the advice."""
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(q,) for q, _ in queries], "query_id long")
    return duplication_verdict(asked, duplication(vectors, queries, threshold))


def duplication_verdict(asked: DataFrame, found: DataFrame) -> DataFrame:
    """One row of asked (query_id): whether found (query_id) has similar rows, and the advice."""
    n = F.coalesce("similar", F.lit(0))
    return asked.join(found.groupBy("query_id").agg(F.count("*").alias("similar")), "query_id", "left").select(
        "query_id", (n > 0).alias("has_duplication"), F.when(n > 0, "Very similar code exists. Consider refactoring to avoid duplication.").otherwise("No duplication detected.").alias("recommendation")
    )


def text_search(docs: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Baseline: the first word as written, all others in any case."""
    return docs.where(X.contains_all_words(F.col(column), query))


def keyword_search(docs: DataFrame, description: str, column: str = "text") -> DataFrame:
    """Rows whose text holds any keyword of the description; a description without keywords finds nothing."""
    found = X.search_keywords(description)
    if not found:
        return docs.where("false")
    return docs.where(X.contains_any(F.col(column), F.array(*(F.lit(w) for w in found))))


def search_columns(hits: DataFrame, key: str = "vec_id") -> DataFrame:
    """The columns of found chunks that are shown: score rounded to four digits, five-line snippet of the document."""
    extra = [c for c in ("file_path", "symbol_name", "symbol_type", "service", "language", "line_start", "line_end") if c in hits.columns]
    tail = [X.snippet(F.col("document"), 5).alias("snippet")] if "document" in hits.columns else []
    return hits.select("query_id", "rank", key, *extra, F.round("score", 4).alias("score"), *tail)


def search_hits(hits: DataFrame, chunks: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits (query_id, rank, score, key) joined with their chunks' columns; which side is sent round is the optimiser's choice by size."""
    return search_columns(chunks.join(hits.select("query_id", "rank", "score", key), key), key)


def dominant_pattern(hits: DataFrame, description: str, most: int = 5) -> DataFrame:
    """One row: pattern_type, count, locations (first seen first), recommendation of the hits whose document holds a keyword.

    hits: rank, file_path, document; at most PATTERN_LIMIT rows. The type with most hits
    wins, ties go to the type seen first; without any hit the type is none.
    """
    stop = set(X.PATTERN_STOP_WORDS)
    words = [w for w in description.lower().split() if len(w) > 3 and w not in stop][:3]
    fitting = hits.where(X.contains_any(F.col("document"), F.array(*(F.lit(w) for w in words)))) if words else hits.where("false")
    typed = fitting.withColumn("pattern_type", P.location_class(F.col("file_path")))
    by = typed.groupBy("pattern_type").agg(F.count("*").alias("count"), F.min("rank").alias("__first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"])).alias("locations"))
    best = by.orderBy(F.desc("count"), "__first").limit(1).drop("__first")
    one = hits.sparkSession.range(1).select(F.lit("none").alias("__none"))
    found = one.join(best, F.lit(True), "left")  # one row
    text = F.when(F.col("pattern_type").isNull(), "No similar patterns found. Start with inline solution.").otherwise(K.pattern_recommendation(F.col("pattern_type"), F.col("count"), F.try_element_at("locations", F.lit(1))))
    return found.select(F.coalesce("pattern_type", "__none").alias("pattern_type"), F.coalesce("count", F.lit(0)).alias("count"), F.slice(F.coalesce("locations", F.array().cast("array<string>")), 1, most).alias("locations"), text.alias("recommendation"))
