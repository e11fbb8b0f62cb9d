"""Index maintenance: change classes, upserts, deletes, run counters, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_classes(stored: DataFrame, scanned: DataFrame, key: str = "file_path", full: bool = False) -> DataFrame:
    """key, change: new, changed, unchanged or deleted, by comparing content hashes; full takes every scanned file as new.

    stored, scanned: key, content_hash. One full outer join; null hashes compare as equal.
    """
    a = stored.select(key, F.col("content_hash").alias("__old"), F.lit(True).alias("__was"))
    b = scanned.select(key, F.col("content_hash").alias("__new"), F.lit(True).alias("__is"))
    new = F.col("__was").isNull()
    change = (
        F.when(F.col("__is").isNull(), "deleted")
        .when(F.lit(True) if full else new, "new")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def refresh_delta(changed: DataFrame, existing: DataFrame, key: str = "file_path") -> DataFrame:
    """key, action for a list of changed paths: reindex where the file exists, delete where it does not."""
    here = changed.join(existing.select(key), key, "left_semi").select(key, F.lit("reindex").alias("action"))
    return here.unionByName(changed.join(existing.select(key), key, "left_anti").select(key, F.lit("delete").alias("action")))


def with_chunks(classes: DataFrame, chunks: DataFrame, key: str = "file_path") -> DataFrame:
    """classes where a new or changed file without any chunk is skipped: what the index holds of it stays as it was."""
    known = chunks.select(key).distinct().withColumn("__some", F.lit(True))
    empty = F.col("change").isin("new", "changed") & F.col("__some").isNull()
    return classes.join(known, key, "left").withColumn("change", F.when(empty, "skipped").otherwise(F.col("change"))).drop("__some")


def run_counters(classes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, indexed, skipped (unchanged or without chunks), deleted and chunks created."""
    out = classes.agg(
        F.count_if(F.col("change") != "deleted").alias("files_scanned"), F.count_if(F.col("change").isin("new", "changed")).alias("files_indexed"),
        F.count_if(F.col("change").isin("unchanged", "skipped")).alias("files_skipped"), F.count_if(F.col("change") == "deleted").alias("files_deleted"),
    )
    return out if chunks is None else out.crossJoin(chunks.agg(F.count("*").alias("chunks_created")))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The latest row of each key over both tables, by version; partial aggregation, no window over hot keys."""
    both = stored.unionByName(rows)
    payload = F.struct(*both.columns)
    return both.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max_by(payload, version).alias("row")).select("row.*")


def latest_per_key(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    return upsert(rows, rows.where("false"), keys, version)


def delete_by(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def distinct_files(chunks: DataFrame, key: str = "file_path") -> DataFrame:
    return chunks.select(key).distinct()


def totals(files: DataFrame, chunks: str = "chunk_count", lines: str = "line_count") -> DataFrame:
    """One row: files, chunks and lines, 0 for an empty table."""
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(chunks), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum(lines), F.lit(0)).alias("total_lines"))


def counts_by(files: DataFrame, column: str, skip_empty: bool = True) -> DataFrame:
    """column, files: how many files each value has; empty values are left out."""
    rows = files.where(F.coalesce(column, F.lit("")) != "") if skip_empty else files
    return rows.groupBy(column).agg(F.count("*").alias("files"))


def last_run(runs: DataFrame, order: str = "id") -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(1)


def status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: totals, files by service and by language (largest first) and the last run."""
    listed = lambda c: counts_by(files, c, c == "service").agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("order"), c, "files"))).alias(f"by_{c}"))
    last = runs.agg(F.max_by(F.struct(*runs.columns), "id").alias("last_run"))
    return totals(files).crossJoin(listed("service")).crossJoin(listed("language")).crossJoin(last)  # one-row frames
