"""Queries: session activity, tokens, comparison, durations, JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as N
from .common import table


def _session_tables(spark, sf):
    """Conversations as sessions (a minute a turn and one more), user turns as messages, all turns as parts."""
    c = table(spark, sf, "conversations")
    sessions = c.groupBy(F.col("conv_id").alias("id")).agg((F.max("turn") * 60000 + 90000).alias("time_updated")).withColumn("time_created", F.lit(0).cast("long"))
    messages = c.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("text").alias("data"))
    parts = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("role").alias("type"), F.col("text").alias("data"))
    return sessions, messages, parts


def activity(spark, sf):
    return N.activity(*_session_tables(spark, sf), fanout=False)


def fanout(spark, sf):
    return N.activity(*_session_tables(spark, sf), fanout=True)


def tokens(spark, sf):
    return N.tokens_by_type(_session_tables(spark, sf)[2])


def compare(spark, sf):
    return N.compare(activity(spark, sf), 0, 1, ["messages", "parts", "message_tokens", "part_tokens"])


def duration(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min(ms).alias("a"), F.max(ms).alias("b"), F.count("*").alias("n"))
    return e.select("user_id", "n", F.round(N.minutes(F.col("a"), F.col("b")), 2).alias("duration_min"), F.date_format(F.timestamp_millis("a"), "yyyy-MM-dd HH:mm:ss").alias("created"))


def recent(spark, sf):
    s = table(spark, sf, "orders").select(F.concat(F.lit("ses_"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time_created"))
    return N.recent(s).select("session_id", "title", F.date_format("created", "yyyy-MM-dd").alias("created"))


def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_tokens(spark, sf):
    m = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.to_json(F.struct(F.col("props").alias("content"))).alias("data"))
    return N.content_tokens(m)


_s = """s AS (SELECT conv_id AS id, max(turn) * 60000 + 90000 AS span FROM conversations GROUP BY 1),
m AS (SELECT conv_id AS id, count(*) AS mr, count(DISTINCT turn) AS messages, sum(length(text)) AS mc FROM conversations WHERE role = 'user' GROUP BY 1),
p AS (SELECT conv_id AS id, count(*) AS pr, count(DISTINCT turn) AS parts, sum(length(text)) AS pc FROM conversations GROUP BY 1)"""


def _activity_sql(mc: str, pc: str) -> str:
    return f"""SELECT s.id, coalesce(messages, 0) AS messages, coalesce(parts, 0) AS parts, CAST(floor({mc} / 4) AS BIGINT) AS message_tokens, CAST(floor({pc} / 4) AS BIGINT) AS part_tokens,
  round(coalesce(parts, 0) / (span / 60000.0::DOUBLE), 2) AS parts_per_minute, round(floor({pc} / 4) / (span / 60000.0::DOUBLE), 0) AS tokens_per_minute FROM s LEFT JOIN m USING (id) LEFT JOIN p USING (id)"""


_diff = lambda c: f"round((b.{c} - a.{c}) / nullif(a.{c}, 0)::DOUBLE * 100, 1) AS {c}_diff"
QUERIES = {
    "session_activity": (activity, f"WITH {_s} {_activity_sql('mc', 'pc')}"),
    "session_tokens_fanout": (fanout, f"WITH {_s} {_activity_sql('(mc * greatest(coalesce(pr, 0), 1))', '(pc * greatest(coalesce(mr, 0), 1))')}"),
    "session_tokens": (tokens, "SELECT conv_id AS session_id, role AS type, count(*) AS n, CAST(round(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM conversations GROUP BY 1, 2"),
    "session_compare": (compare, f"WITH {_s}, x AS ({_activity_sql('mc', 'pc')}) SELECT {', '.join(map(_diff, ('messages', 'parts', 'message_tokens', 'part_tokens')))} FROM x a, x b WHERE a.id = 0 AND b.id = 1"),
    "session_duration": (
        duration,
        "SELECT user_id, count(*) AS n, CAST(round(CAST((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 60000.0::DOUBLE AS DECIMAL(18, 6)), 2) AS DOUBLE) AS duration_min, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM events GROUP BY 1",
    ),
    "recent_sessions": (recent, "SELECT substr('ses_' || o_orderkey, 1, 30) AS session_id, substr(o_orderpriority, 1, 50) AS title, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, 'ses_' || o_orderkey LIMIT 10"),
    "json_field": (json_field, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_tokens": (json_tokens, "SELECT user_id AS session_id, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(round(sum(length(props)) / 4.0) AS BIGINT) AS tokens FROM events GROUP BY 1"),
}
