"""Queries: similar commits, type filter, outliers, statistics, common files, recent window, complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import history as H
from .common import COMMITS_SQL, commits, table


def similar(spark, sf):
    return H.similar(commits(spark, sf), ["high", "medium"], 50).select("commit", "message", "files", "lines")


def type_filter(spark, sf):
    words = F.array(*(F.lit(x) for x in ("fix the ", "add test for ", "refactor ", "add api ", "improve ")))
    c = commits(spark, sf).withColumn("message", F.concat(F.element_at(words, (F.col("commit") % 5 + 1).cast("int")), F.lower("message")))
    return H.type_filter(H.similar(c, ["high", "urgent"], 50), "fix").select("commit", "message")


def outliers(spark, sf):
    return H.remove_outliers(commits(spark, sf)).select("commit", "files", "lines")


def stats(spark, sf):
    s = H.statistics(H.remove_outliers(commits(spark, sf)))
    text = K.history_recommendation(F.col("median_files"), F.col("median_lines"), F.col("min_files"), F.col("max_files"), F.array().cast("array<string>"))
    return s.select("n", F.round("avg_files", 4).alias("avg_files"), F.round("avg_lines", 4).alias("avg_lines"), "median_files", "median_lines", "min_files", "min_lines", "max_files", "max_lines", text.alias("recommendation"))


def common_files(spark, sf):
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return H.common_files(changes, commits(spark, sf).select("commit"), 0.001)


def recent(spark, sf):
    r = H.recent(commits(spark, sf), 30)
    return r.select("commits_analyzed", F.round("avg_files_per_commit", 4).alias("avg_files_per_commit"), F.round("avg_lines_per_commit", 4).alias("avg_lines_per_commit"), "period_days")


def complexity(spark, sf):
    c = commits(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), "o_custkey"), "commit")
    medians = H.upper_median_of(c, ["files", "lines"], ["o_custkey"])
    both = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(medians, "o_custkey", "left")
    return both.select("o_custkey", "median_files", "median_lines", K.complexity(F.col("median_files"), F.col("median_lines")).alias("complexity"))


_upper = lambda c: f"list_sort(list({c}))[count({c}) // 2 + 1]"
_clean = f"""{COMMITS_SQL},
m AS (SELECT {_upper('files')} AS mf, {_upper('lines')} AS ml, count(*) AS n FROM commits),
k AS (SELECT c.*, files > 3 * mf AND lines > 3 * ml AS out, n FROM commits c, m),
v AS (SELECT count(*) < 3 OR count(*) FILTER (WHERE NOT out) < 0.5 * count(*) AS keep_all FROM k),
clean AS (SELECT k.* FROM k, v WHERE NOT out OR keep_all)"""
_latest = "latest AS (SELECT * FROM commits ORDER BY ts DESC, \"commit\" DESC LIMIT 50)"

QUERIES = {
    "history_similar": (similar, f"WITH {COMMITS_SQL}, {_latest} SELECT \"commit\", message, files, lines FROM latest WHERE contains(lower(message), 'high') OR contains(lower(message), 'medium')"),
    "history_type_filter": (
        type_filter,
        f"""WITH {COMMITS_SQL}, {_latest},
w AS (SELECT "commit", (['fix the ', 'add test for ', 'refactor ', 'add api ', 'improve '])[CAST("commit" % 5 AS INTEGER) + 1] || lower(message) AS message FROM latest),
s AS (SELECT *, ("commit" % 5) IN (0, 4) AS fits FROM w WHERE contains(message, 'high') OR contains(message, 'urgent'))
SELECT "commit", message FROM s WHERE fits OR (SELECT count(*) FILTER (WHERE fits) < 3 FROM s)""",
    ),
    "history_outliers": (outliers, f'WITH {_clean} SELECT "commit", files, lines FROM clean'),
    "history_stats": (
        stats,
        f"""WITH {_clean},
s AS (SELECT count(*) AS n, round(avg(files), 4) AS avg_files, round(avg(lines), 4) AS avg_lines, {_upper('files')} AS median_files, {_upper('lines')} AS median_lines, min(files) AS min_files, min(lines) AS min_lines, max(files) AS max_files, max(lines) AS max_lines FROM clean)
SELECT *, CASE WHEN median_files <= 5 THEN 'Simple' WHEN median_files <= 10 THEN 'Moderate' ELSE 'Complex' END || ' (median: ' || median_files || ' files, ~' || median_lines || ' lines); Range: ' || min_files || '-' || max_files || ' files - ' ||
  CASE WHEN median_files <= 5 THEN 'start with minimal approach' WHEN median_files <= 10 THEN 'balance simplicity & completeness' ELSE 'plan carefully, test thoroughly' END AS recommendation FROM s""",
    ),
    "common_files": (
        common_files,
        "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 0.001 * (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))",
    ),
    "recent_patterns": (
        recent,
        f"""WITH {COMMITS_SQL} SELECT count(*) AS commits_analyzed, round(coalesce(avg(files), 0), 4) AS avg_files_per_commit, round(coalesce(avg(lines), 0), 4) AS avg_lines_per_commit, 30 AS period_days
FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 30 DAYS""",
    ),
    "complexity": (
        complexity,
        f"""WITH {COMMITS_SQL}, m AS (SELECT o_custkey, {_upper('files')} AS median_files, {_upper('lines')} AS median_lines FROM commits JOIN orders ON o_orderkey = "commit" GROUP BY 1)
SELECT c_custkey AS o_custkey, median_files, median_lines, CASE WHEN median_files IS NULL THEN 'UNKNOWN' WHEN median_files <= 3 AND median_lines < 300 THEN 'LOW' WHEN median_files <= 8 AND median_lines < 1200 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity
FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
    ),
}
