"""Commit history: similar commits, type filter, outliers, statistics, common files, recent window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..shared import kept, spread


def latest(commits: DataFrame, most: int = 50) -> DataFrame:
    """The newest commits; the cut comes before any filter. Ties by key."""
    return commits.orderBy(F.desc("ts"), F.desc("commit")).limit(most)


def similar(commits: DataFrame, words: list[str], most: int = 50) -> DataFrame:
    """Commits among the newest whose message holds any of the words; no words match nothing."""
    recent = latest(commits, most)
    return recent.where(X.contains_any(F.col("message"), F.array(*(F.lit(w) for w in words)))) if words else recent.where("false")


def type_filter(commits: DataFrame, target: str) -> DataFrame:
    """Commits of the target type or of type feature; all of them if that leaves fewer than three or the target is feature."""
    if target == "feature":
        return commits
    kind = K.task_type(F.col("message"))
    marked = commits.withColumn("__fits", (kind == target) | (kind == "feature"))
    enough = marked.agg((F.count_if("__fits") >= 3).alias("__enough"))  # one row
    return marked.crossJoin(F.broadcast(enough)).where("__fits OR NOT __enough").drop("__fits", "__enough")


def upper_median(value: str) -> Column:
    """Aggregate: the value at position n // 2 in ascending order, as a double; nulls do not count.

    The first value of the descending order that covers half the rows. The aggregate counts
    by distinct value, on the map side first, so its state grows with the distinct values
    and no group is gathered in an array.
    """
    return F.expr(f"-(percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`))")


def upper_median_of(rows: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """by..., median_<value> of each value, in one pass over the rows."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.groupBy(*(by or [])).agg(*(upper_median(v).cast(types[v]).alias(f"median_{v}") for v in values))


def remove_outliers(commits: DataFrame, factor: int = 3) -> DataFrame:
    """Drops commits over factor times the upper median in both files and lines; keeps all if under three or under half survive.

    commits: files, lines. The table is written once for its three passes: medians, verdict, filter.
    """
    commits = kept(commits, "commits")
    medians = upper_median_of(commits, ["files", "lines"])  # one row
    out = (F.col("files") > factor * F.col("median_files")) & (F.col("lines") > factor * F.col("median_lines"))
    marked = commits.crossJoin(F.broadcast(medians)).withColumn("__out", F.coalesce(out, F.lit(False)))
    verdict = marked.agg(((F.count("*") < 3) | (F.count_if(~F.col("__out")) < 0.5 * F.count("*"))).alias("__all"))  # one row
    return marked.crossJoin(F.broadcast(verdict)).where("NOT __out OR __all").select(*commits.columns)


def statistics(commits: DataFrame) -> DataFrame:
    """One row: n, means, upper medians, independent least and most files and lines; no row without commits."""
    types = dict(commits.dtypes)
    medians = [upper_median(v).cast(types[v]).alias(f"median_{v}") for v in ("files", "lines")]
    return commits.agg(
        F.count("*").alias("n"), F.avg("files").alias("avg_files"), F.avg("lines").alias("avg_lines"), *medians, F.min("files").alias("min_files"), F.min("lines").alias("min_lines"),
        F.max("files").alias("max_files"), F.max("lines").alias("max_lines"),
    ).where("n > 0")


def common_files(changes: DataFrame, commits: DataFrame, share: float = 0.3) -> DataFrame:
    """file, commits: files changed by at least that share of the commits; changes: commit, file.

    All changes of a commit are in one task, which drops repeats; only counts a file move from there.
    """
    rows = changes.count()
    # an inner join, since Spark moves a semi join in front of the dealing, into fewer tasks
    known = spread(changes, rows, "commit").join(spread(commits.select("commit").distinct(), rows, "commit"), "commit").select("commit", "file").distinct()
    kept = known.groupBy("file").agg(F.count("commit").alias("commits"))
    total = commits.agg(F.count("*").alias("__n"))
    return kept.crossJoin(F.broadcast(total)).where(F.col("commits") >= F.col("__n") * share).drop("__n")


def recent(commits: DataFrame, days: int, anchor: Column | None = None) -> DataFrame:
    """One row over the commits of the last days before the anchor (default: the newest commit): n, mean files and lines, period.

    Without commits the means are 0 and the period is null.
    """
    last = commits.agg(F.max("ts").alias("__last")) if anchor is None else commits.sparkSession.range(1).select(anchor.alias("__last"))
    inside = commits.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("__last") - F.make_dt_interval(F.lit(days)))
    out = inside.agg(F.count("*").alias("commits_analyzed"), F.coalesce(F.avg("files"), F.lit(0.0)).alias("avg_files_per_commit"), F.coalesce(F.avg("lines"), F.lit(0.0)).alias("avg_lines_per_commit"))
    return out.withColumn("period_days", F.when(F.col("commits_analyzed") > 0, F.lit(days)))
