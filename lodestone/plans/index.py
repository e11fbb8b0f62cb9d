"""Queries: index maintenance and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index as I
from ..operators.snapshots import SnapshotTable
from ..shared import new_path
from .common import table


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    h = X.content_hash(F.col("text"))
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), h)).otherwise(h).alias("content_hash"))
    return old, d.where("doc_id % 11 <> 0").select("doc_id", h.alias("content_hash"))


def documents_table(spark, sf, ranges: int = 200) -> SnapshotTable:
    """documents in a copy-on-write table by ranges of doc_id, then an upsert of its first hundredth with new rows besides, then a deletion."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    top = d.agg(F.max("doc_id")).first()[0] + 1
    stored = SnapshotTable(spark, new_path(spark, "documents-table"), ["doc_id"], F.floor(F.col("doc_id") / F.lit(max(1, top // ranges))))
    stored.change(d)
    first = d.where(F.col("doc_id") < top // 100 + 1)
    stored.change(first.withColumn("lang", F.lit("xx")).unionByName(first.withColumn("doc_id", F.col("doc_id") + top)))
    stored.change(gone=d.where(F.col("doc_id") >= top - top // 100).select("doc_id"))
    return stored


def snapshot_rows(spark, sf):
    return documents_table(spark, sf).read().select("doc_id", "lang", "source", F.length("text").alias("chars"))


def snapshot_history(spark, sf):
    """What each snapshot holds, read after all were made."""
    stored = documents_table(spark, sf)
    rows = [stored.read(v).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "xx").alias("changed"), F.sum(F.length("text")).alias("chars")).select(F.lit(v).alias("version"), "*") for v in stored.versions()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def classes(spark, sf):
    return I.change_classes(*_snapshots(spark, sf), key="doc_id")


def counters(spark, sf):
    return I.run_counters(classes(spark, sf))


def delta(spark, sf):
    d = table(spark, sf, "documents")
    return I.refresh_delta(d.where("doc_id % 4 = 0").select("doc_id"), d.where("doc_id % 3 <> 0").select("doc_id"), "doc_id")


def upsert(spark, sf):
    e = table(spark, sf, "events")
    cols = ["event_id", "ts", "user_id", "value"]
    return I.upsert(e.where("event_id % 2 = 0").select(cols), e.where("event_id % 2 = 1").select(cols), ["user_id"], F.struct("ts", "event_id"))


def delete(spark, sf):
    return I.delete_by(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 0"), "doc_id").select("doc_id", "source")


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("language"), F.col("source").alias("service"), F.lit(1).alias("chunk_count"), F.size(X.lines(F.col("text"))).alias("line_count"))


def totals(spark, sf):
    return I.totals(_files(spark, sf))


def by_language(spark, sf):
    return I.counts_by(_files(spark, sf), "language", False)


def by_service(spark, sf):
    return I.counts_by(_files(spark, sf), "service")


def last_run(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return I.latest_per_key(e, ["event_type"], F.struct("ts", "event_id"))


def last_run_all(spark, sf):
    return I.last_run(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")


def files_distinct(spark, sf):
    return I.distinct_files(table(spark, sf, "conversations"), "conv_id")


def status(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    s = I.status(_files(spark, sf), runs)
    shown = lambda c: F.array_join(F.transform(f"by_{c}", lambda x: F.concat(x[c], F.lit(":"), x["files"].cast("string"))), ",").alias(f"by_{c}")
    return s.select("total_files", "total_chunks", "total_lines", shown("service"), shown("language"), F.col("last_run.id").alias("last_id"), F.col("last_run.event_type").alias("last_type"))


QUERIES = {
    "incremental_classes": (
        classes,
        """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || sha256(text)[1:16] AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, sha256(text)[1:16] AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN n.h IS NULL THEN 'deleted' WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)""",
    ),
    "run_counters": (
        counters,
        """SELECT count(*) FILTER (WHERE doc_id % 11 <> 0) AS files_scanned, count(*) FILTER (WHERE doc_id % 11 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)) AS files_indexed,
  count(*) FILTER (WHERE doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS files_skipped, count(*) FILTER (WHERE doc_id % 11 = 0 AND doc_id % 3 <> 0) AS files_deleted FROM documents""",
    ),
    "refresh_delta": (delta, "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'reindex' ELSE 'delete' END AS action FROM documents WHERE doc_id % 4 = 0"),
    "upsert_latest": (upsert, "SELECT event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "delete_by_file": (delete, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "status_totals": (
        totals,
        "SELECT count(*) AS total_files, CAST(coalesce(sum(1), 0) AS BIGINT) AS total_chunks, CAST(coalesce(sum(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END), 0) AS BIGINT) AS total_lines FROM documents",
    ),
    "language_counts": (by_language, "SELECT lang AS language, count(*) AS files FROM documents GROUP BY 1"),
    "service_counts": (by_service, "SELECT source AS service, count(*) AS files FROM documents WHERE coalesce(source, '') <> '' GROUP BY 1"),
    "last_run": (last_run, "SELECT event_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "last_run_all": (last_run_all, "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1"),
    "distinct_files": (files_distinct, "SELECT DISTINCT conv_id FROM conversations"),
    "status_report": (
        status,
        """WITH t AS (SELECT len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n, source, lang FROM documents),
s AS (SELECT source, count(*) AS n FROM t WHERE coalesce(source, '') <> '' GROUP BY 1), l AS (SELECT lang, count(*) AS n FROM t GROUP BY 1)
SELECT count(*) AS total_files, count(*) AS total_chunks, CAST(sum(n) AS BIGINT) AS total_lines, (SELECT string_agg(source || ':' || n, ',' ORDER BY n DESC, source) FROM s) AS by_service,
  (SELECT string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) FROM l) AS by_language, (SELECT max(event_id) FROM events) AS last_id, (SELECT arg_max(event_type, event_id) FROM events) AS last_type FROM t""",
    ),
}
_snap = """
t AS (SELECT max(doc_id) + 1 AS top FROM documents), d AS (SELECT doc_id, lang, source, length(text) AS chars, top FROM documents, t),
s2 AS (SELECT doc_id, CASE WHEN doc_id < top // 100 + 1 THEN 'xx' ELSE lang END AS lang, source, chars, top FROM d UNION ALL SELECT doc_id + top, lang, source, chars, top FROM d WHERE doc_id < top // 100 + 1),
s3 AS (SELECT * FROM s2 WHERE doc_id < top - top // 100 OR doc_id >= top)"""
_facts = "count(*) AS n, count(*) FILTER (WHERE lang = 'xx') AS changed, CAST(sum(chars) AS BIGINT) AS chars"
QUERIES["snapshot_rows"] = (snapshot_rows, f"WITH {_snap} SELECT doc_id, lang, source, chars FROM s3")
QUERIES["snapshot_history"] = (
    snapshot_history,
    f"WITH {_snap} SELECT CAST(1 AS INTEGER) AS version, {_facts} FROM d UNION ALL SELECT 2, {_facts} FROM s2 UNION ALL SELECT 3, {_facts} FROM s3",
)
