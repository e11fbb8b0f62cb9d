"""Queries: file scores, graph boost, service coverage, group caps, budgeted prefix, the map itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph as G
from ..operators import repomap as R
from ..operators import symbols as Y
from .common import EDGES_SQL, PATHS_SQL, entity_edges, page_paths, table
from .text import _group, _low, _parts, _test


def _scored(spark, sf):
    s = Y.html_symbols(page_paths(spark, sf))
    score = R.file_score(F.col("path"), F.size("headings"), F.size("links"), F.col("scripts"), F.size("headings"))
    return s.select("page_id", F.col("path").alias("rel_path"), score.alias("score"))


def file_score(spark, sf):
    return _scored(spark, sf).select("page_id", F.round("score", 4).alias("score"))


def graph_boost(spark, sf):
    regions = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("name"))
    d = G.dependents(entity_edges(spark, sf), regions, 1)
    return d.select("name", "dependents", G.graph_boost(F.col("dependents")).alias("boost"))


def best_per_service(spark, sf):
    services = spark.createDataFrame([("svc", "services/", 1), ("libs", "libs/", 2), ("common", "src/common", 3)], "name string, path string, seq int")
    return R.best_per_service(_scored(spark, sf), services).select("service", "rel_path", F.round("score", 4).alias("score"))


def group_cap(spark, sf):
    d = table(spark, sf, "documents")
    return R.group_cap(d, 5, F.col("source"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "n_chars")


def group_cap_paths(spark, sf):
    return R.group_cap(_scored(spark, sf), 5, None, [F.desc(F.round("score", 4)), F.col("rel_path"), F.col("page_id")]).select("page_id", "rel_path")


def budget_prefix(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 0")
    return R.within_budget(d, [F.col("doc_id")], "n_chars", 24_000).select("doc_id", F.col("running").cast("long").alias("running"))


def budget_prefix_by_source(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 0")
    return R.within_budget(d, [F.col("doc_id")], "n_chars", 24_000, part=["source"]).select("doc_id", "source", F.col("running").cast("long").alias("running"))


def repo_map(spark, sf):
    """The map of the pages' symbols, as one text; of pages with one path the first counts."""
    pages = page_paths(spark, sf).groupBy("path").agg(F.min_by("html", "page_id").alias("html"))
    s = Y.html_symbols(pages)
    empty = F.array().cast("array<struct<name:string,kind:string,signature:string,line:int>>")
    symbols = F.transform("headings", lambda h: F.struct(h.alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("class "), h).alias("signature"), F.lit(1).alias("line"), empty.alias("children")))
    files = s.select(F.col("path").alias("rel_path"), symbols.alias("symbols"), R.file_score(F.col("path"), F.size("headings"), F.size("links"), F.col("scripts"), F.lit(0)).alias("score"))
    return R.repo_map(R.rank_files(files))


_entry = "CASE " + " ".join(f"WHEN regexp_matches(path, '(^|/){p}$') THEN {b}" for p, b in P.ENTRY_POINTS) + " ELSE 0.0 END"
_score = rf"""sc AS (
  SELECT page_id, path, len(regexp_extract_all(coalesce(html, ''), '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS h, len(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"', 1)) AS a, len(regexp_extract_all(coalesce(html, ''), '<(script)[ >]', 1)) AS c FROM paths),
scored AS (
  SELECT page_id, path, CASE WHEN h + a + c = 0 THEN 0.0::DOUBLE ELSE greatest(log2((h + a + c + 1)::DOUBLE) + 1.5 * ((h > 0)::INT + (a > 0)::INT + (c > 0)::INT)::DOUBLE + least(h * 0.3::DOUBLE, 3.0) + ({_entry})::DOUBLE - greatest(0.0::DOUBLE, (len(string_split(path, '/')) - 3) * 0.2::DOUBLE), 0.1::DOUBLE) END AS score FROM sc)"""

QUERIES = {
    "file_score": (file_score, f"WITH {PATHS_SQL}, {_score} SELECT page_id, round(score, 4) AS score FROM scored"),
    "graph_boost": (
        graph_boost,
        f"""WITH RECURSIVE {EDGES_SQL}, walk AS (
  SELECT 'region:' || r_regionkey AS start, e.source AS name, 1 AS depth FROM region JOIN edges e ON e.target = 'region:' || r_regionkey
  UNION SELECT w.start, e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.name WHERE w.depth < 2),
n AS (SELECT start, count(DISTINCT name) AS n FROM walk GROUP BY start)
SELECT 'region:' || r_regionkey AS name, coalesce(n, 0) AS dependents, CAST(least(coalesce(n, 0) * 0.5, 5.0) AS DOUBLE) AS boost FROM region LEFT JOIN n ON start = 'region:' || r_regionkey""",
    ),
    "best_per_service": (
        best_per_service,
        f"""WITH {PATHS_SQL}, {_score}, s AS (SELECT * FROM (VALUES ('svc', 'services/'), ('libs', 'libs/'), ('common', 'src/common')) v(service, prefix)),
r AS (SELECT service, path, score, row_number() OVER (PARTITION BY service ORDER BY score + CASE WHEN contains(path, 'main.py') THEN 100 WHEN contains(path, 'server.py') THEN 90 WHEN contains(path, '__init__.py') THEN 80 WHEN contains(path, 'config.py') THEN 70 ELSE 0 END DESC, path) AS rn FROM scored JOIN s ON contains(path, prefix))
SELECT service, path AS rel_path, round(score, 4) AS score FROM r WHERE rn = 1""",
    ),
    "group_cap": (group_cap, "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5"),
    "group_cap_paths": (
        group_cap_paths,
        f"WITH {_parts}, {_score}, g AS (SELECT s.page_id, s.path, round(s.score, 4) AS score, {_group} AS grp FROM scored s JOIN pp USING (page_id)) SELECT page_id, path AS rel_path FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, path, page_id) AS rn FROM g) WHERE rn <= 5",
    ),
    "budget_prefix": (budget_prefix, "SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents WHERE n_chars > 0) WHERE running <= 24000"),
    "budget_prefix_by_source": (
        budget_prefix_by_source,
        "SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents WHERE n_chars > 0) WHERE running <= 24000",
    ),
    "repo_map": (
        repo_map,
        rf"""WITH {PATHS_SQL}, u AS (SELECT path, arg_min(coalesce(html, ''), page_id) AS html FROM paths GROUP BY path),
pp AS (SELECT *, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS hs, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS a, len(regexp_extract_all(html, '<(script)[ >]', 1)) AS c FROM u),
sc AS (SELECT *, {_group} AS grp, CASE WHEN len(hs) + a + c = 0 THEN 0.0::DOUBLE ELSE greatest(log2((len(hs) + a + c + 1)::DOUBLE) + 1.5 * ((len(hs) > 0)::INT + (a > 0)::INT + (c > 0)::INT)::DOUBLE + ({_entry})::DOUBLE - greatest(0.0::DOUBLE, (len(p) - 3) * 0.2::DOUBLE), 0.1::DOUBLE) END AS score
  FROM pp WHERE NOT {_test} AND NOT {_low}),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, path) AS rn FROM sc) WHERE rn <= 5),
k AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, path) AS position, '## ' || path || chr(10) || list_aggregate(list_transform(hs[1:10], lambda h: '  class ' || h || chr(10)), 'string_agg', '') AS block FROM g ORDER BY position LIMIT 80),
r AS (SELECT *, sum(length(block) + 1) OVER (ORDER BY position) + {len(chr(10).join(R.HEADER)) + 1} AS running FROM k)
SELECT '{chr(10).join(R.HEADER)}' || coalesce(chr(10) || string_agg(block, chr(10) ORDER BY position), '') AS map FROM r WHERE running <= 24000""",
    ),
}
