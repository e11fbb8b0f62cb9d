"""Queries: vector search, text search, hits by service, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import paths as P
from ..functions import text as X
from ..operators import scope as C
from ..operators import search as S
from ..operators import vector_index as V
from .common import HITS_SQL, PATHS_SQL, WHOLE, document_grams, page_paths, table, vector_hits, whole_hits

ALL_WORDS = "the And THAT"
DESCRIPTION = "Update that export from ation"
PHRASE = 40


def _one(where: str | None):
    def run(spark, sf):
        e = table(spark, sf, "embeddings")
        hits = S.nearest(e, S.query_vectors(e, F.col("vec_id") == 0)[0], 10, F.expr(where) if where else None)
        return hits.select("rank", "vec_id", "label", F.round("score", 4).alias("score"))

    return run


def _one_sql(where: str) -> str:
    return f"""
WITH s AS (
  SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sc
  FROM embeddings WHERE vec_id <> 0 AND {where})
SELECT CAST(row_number() OVER (ORDER BY sc DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(sc, 4) AS score
FROM s ORDER BY sc DESC, vec_id LIMIT 10"""


def batch(spark, sf):
    return whole_hits(spark, sf, WHOLE, 10).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def _similar(hits, threshold):
    """Of the ten nearest the first three that reach the threshold."""
    return hits.where((F.col("score") >= threshold) & (F.col("rank") <= 3))


def near_duplicates(spark, sf):
    return _similar(whole_hits(spark, sf, WHOLE, 10), 0.3).select("query_id", "vec_id", F.round("score", 2).alias("similarity"))


def index_topk(spark, sf):
    """The approximate mode of the index on the query set."""
    e = table(spark, sf, "embeddings")
    return V.search(V.build(e), e.where(WHOLE), 10).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def index_exact(spark, sf):
    """The exact mode of the index on the query set."""
    e = table(spark, sf, "embeddings")
    return V.exact(V.build(e, recall=None), e.where(WHOLE), 10).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def index_recall(spark, sf):
    """The approximate mode on the query set, against the exact one: whether nine of ten true neighbours are found."""
    e = table(spark, sf, "embeddings")
    index = V.build(e)
    asked = e.where(WHOLE)
    found = V.search(index, asked, 10).select("query_id", "vec_id", F.lit(1).alias("found"))
    true = V.exact(index, asked, 10).select("query_id", "vec_id")
    return true.join(found, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))


def near_duplicates_whole(spark, sf):
    """Near duplicates of every vector: the three nearest, by packs of neighbouring vectors."""
    e = table(spark, sf, "embeddings")
    index = V.build(e, cells=max(1, e.count() // V.PACK), recall=None)
    return V.exact(index, e, 3, 0.3).select("query_id", "vec_id", F.round("score", 2).alias("similarity"))


def duplication_summary(spark, sf):
    asked = table(spark, sf, "embeddings").where(WHOLE).select(F.col("vec_id").alias("query_id"))
    return S.duplication_verdict(asked, _similar(whole_hits(spark, sf, WHOLE, 10), 0.35))


def keyword_all(spark, sf):
    return S.text_search(table(spark, sf, "documents"), ALL_WORDS).select("doc_id", "source")


def keyword_any(spark, sf):
    return S.keyword_search(table(spark, sf, "documents"), DESCRIPTION).select("doc_id", "source")


def gram_all(spark, sf):
    """keyword_search_all through the gram index."""
    return document_grams(spark, sf).text_search(ALL_WORDS).select("doc_id", "source")


def gram_any(spark, sf):
    """keyword_search_any through the gram index."""
    return document_grams(spark, sf).keyword_search(DESCRIPTION).select("doc_id", "source")


def gram_short(spark, sf):
    """Documents that hold a needle of one or two characters."""
    return document_grams(spark, sf).containing_any(["q", "zz"]).select("doc_id", "source")


def gram_phrases(spark, sf):
    """Documents that hold the first PHRASE characters of a benchmark item."""
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.lower(F.substring("text", 1, PHRASE)).alias("needle"))
    return document_grams(spark, sf).matches(needles).select(F.col("needle_id").alias("item_id"), "doc_id", "source")


def label_hits(spark, sf, where="vec_id = 0", k=20, found=vector_hits):
    hits = found(spark, sf, where, k)
    order = F.col("query_id") * 1000 + F.col("rank")
    return hits.select(order.alias("rank"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("service"), F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("file_path"), "score")


def service_hits(spark, sf):
    return C.service_hits(label_hits(spark, sf)).select("service", "hit_count", "first_rank", F.array_join("files", ",").alias("files"))


def key_files(spark, sf):
    hits = label_hits(spark, sf, WHOLE, 10, whole_hits)
    return C.key_files(hits).select("file_path", "rank", "service", F.round("score", 4).alias("relevance_score"))


def dominant_pattern(spark, sf):
    rows = page_paths(spark, sf).where(X.contains_any(F.col("html"), F.array(F.lit("that"), F.lit("nation"))))
    by = rows.withColumn("pattern_type", P.location_class(F.col("path"))).groupBy("pattern_type").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first"), F.min_by("path", "page_id").alias("location"), F.countDistinct("path").alias("locations")
    )
    best = by.orderBy(F.desc("n"), "first").limit(1)
    return best.select("pattern_type", "n", "location", "locations", K.pattern_recommendation(F.col("pattern_type"), F.col("n"), F.col("location")).alias("recommendation"))


LABEL_HITS = """
lh AS (SELECT query_id * 1000 + rank AS rank, 'label' || label AS service, 'vec/' || vec_id AS file_path, score FROM hits)"""
_location = """CASE WHEN regexp_matches(lower(path), 'lib/|library/|libraries/|packages/|pkg/') THEN 'library'
  WHEN regexp_matches(lower(path), 'util|helper|common|shared|core') THEN 'utility'
  WHEN regexp_matches(lower(path), 'service|srv/') THEN 'service' ELSE 'inline' END"""

QUERIES = {
    "vector_topk": (_one(None), _one_sql("true")),
    "vector_topk_filtered": (_one("label = 3"), _one_sql("label = 3")),
    "vector_topk_and": (_one("label = 3 AND vec_id % 2 = 0"), _one_sql("label = 3 AND vec_id % 2 = 0")),
    "vector_topk_batch": (batch, f"WITH {HITS_SQL.format(where=WHOLE, k=10)} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM hits"),
    "near_duplicates": (near_duplicates, f"WITH {HITS_SQL.format(where=WHOLE, k=10)} SELECT query_id, vec_id, round(score, 2) AS similarity FROM hits WHERE score >= 0.3 AND rank <= 3"),
    "duplication_summary": (
        duplication_summary,
        f"""WITH {HITS_SQL.format(where=WHOLE, k=10)}
SELECT query_id, count(vec_id) > 0 AS has_duplication, CASE WHEN count(vec_id) > 0 THEN 'Very similar code exists. Consider refactoring to avoid duplication.' ELSE 'No duplication detected.' END AS recommendation
FROM qv LEFT JOIN (SELECT query_id, vec_id FROM hits WHERE score >= 0.35 AND rank <= 3) USING (query_id) GROUP BY query_id""",
    ),
    "keyword_search_all": (keyword_all, "SELECT doc_id, source FROM documents WHERE contains(text, 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'that')"),
    "keyword_search_any": (keyword_any, "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'that') OR contains(lower(text), 'export') OR contains(lower(text), 'ation')"),
    "service_hits": (
        service_hits,
        f"""WITH {HITS_SQL.format(where='vec_id = 0', k=20)}, {LABEL_HITS},
f AS (SELECT service, file_path, row_number() OVER (PARTITION BY service ORDER BY min(rank), file_path) AS rn FROM lh GROUP BY service, file_path)
SELECT service, count(*) AS hit_count, min(rank) AS first_rank, (SELECT string_agg(file_path, ',' ORDER BY rn) FROM f WHERE f.service = lh.service AND rn <= 10) AS files FROM lh GROUP BY service""",
    ),
    "key_files": (
        key_files,
        f"""WITH {HITS_SQL.format(where=WHOLE, k=10)}, {LABEL_HITS}
SELECT file_path, rank, service, round(score, 4) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS rn FROM lh) WHERE rn = 1""",
    ),
    "dominant_pattern": (
        dominant_pattern,
        f"""WITH {PATHS_SQL},
k AS (SELECT *, {_location} AS pattern_type FROM paths WHERE contains(lower(html), 'that') OR contains(lower(html), 'nation')),
b AS (SELECT pattern_type, count(*) AS n, min(page_id) AS first, arg_min(path, page_id) AS location, count(DISTINCT path) AS locations FROM k GROUP BY 1 ORDER BY n DESC, first LIMIT 1)
SELECT pattern_type, n, location, locations,
  CASE WHEN pattern_type = 'library' AND n >= 3 THEN 'Library pattern detected (' || n || ' occurrences). Consider using existing library: ' || location
       WHEN pattern_type = 'utility' AND n >= 2 THEN 'Utility pattern detected (' || n || ' occurrences). Consider adding to existing utility: ' || location
       WHEN pattern_type = 'service' AND n >= 2 THEN 'Service pattern detected (' || n || ' occurrences). Follow existing service pattern'
       WHEN n = 1 THEN 'Single occurrence found. Inline solution likely sufficient.'
       ELSE 'No established pattern. Start with inline solution, refactor if needed.' END AS recommendation
FROM b""",
    ),
}
QUERIES["near_duplicates_whole"] = (near_duplicates_whole, QUERIES["near_duplicates"][1].replace(WHOLE, "true"))
QUERIES["vector_index_exact"] = (index_exact, QUERIES["vector_topk_batch"][1])
QUERIES["vector_index_topk"] = (index_topk, None)  # approximate; tested against brute force
QUERIES["vector_index_recall"] = (index_recall, f"SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE {WHOLE}")
QUERIES["keyword_index_all"] = (gram_all, QUERIES["keyword_search_all"][1])
QUERIES["keyword_index_any"] = (gram_any, QUERIES["keyword_search_any"][1])
QUERIES["keyword_index_short"] = (gram_short, "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'q') OR contains(lower(text), 'zz')")
QUERIES["keyword_index_phrases"] = (gram_phrases, f"SELECT item_id, doc_id, source FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, {PHRASE})))")
