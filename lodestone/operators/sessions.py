"""Session analytics over session, message and part tables, in the fanned-out and the corrected form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minutes(start: Column, end: Column) -> Column:
    """Minutes between epoch milliseconds."""
    return (end - start) / 60000.0


def timing(sessions: DataFrame) -> DataFrame:
    """id, created, updated, duration in minutes (two digits), whether it was compacted."""
    return sessions.select(
        "id", F.timestamp_millis("time_created").alias("created"), F.timestamp_millis("time_updated").alias("updated"),
        F.round(minutes(F.col("time_created"), F.col("time_updated")), 2).alias("duration_min"), F.col("time_compacting").isNotNull().alias("compacted"),
    )


def activity(sessions: DataFrame, messages: DataFrame, parts: DataFrame, fanout: bool = True) -> DataFrame:
    """id, messages, parts, message_tokens, part_tokens, parts_per_minute, tokens_per_minute.

    fanout=True sums lengths after joining messages with parts, as the session script does:
    message characters count once a part and part characters once a message. fanout=False
    aggregates each side first. Both aggregate before joining, so neither builds the
    product: the fanned-out sums are the plain ones times the other side's rows.
    """
    m = messages.groupBy("session_id").agg(F.count("*").alias("__mr"), F.countDistinct("id").alias("messages"), F.sum(F.length("data")).alias("__mc"))
    p = parts.groupBy("session_id").agg(F.count("*").alias("__pr"), F.countDistinct("id").alias("parts"), F.sum(F.length("data")).alias("__pc"))
    s = sessions.select("id", "time_created", "time_updated")
    joined = s.join(m.withColumnRenamed("session_id", "id"), "id", "left").join(p.withColumnRenamed("session_id", "id"), "id", "left")
    mr, pr = F.greatest(F.coalesce("__mr", F.lit(0)), F.lit(1)), F.greatest(F.coalesce("__pr", F.lit(0)), F.lit(1))
    mc, pc = (F.col("__mc") * pr, F.col("__pc") * mr) if fanout else (F.col("__mc"), F.col("__pc"))
    span = F.nullif(minutes(F.col("time_created"), F.col("time_updated")), F.lit(0.0))
    n_parts = F.coalesce("parts", F.lit(0))
    return joined.select(
        "id", F.coalesce("messages", F.lit(0)).alias("messages"), n_parts.alias("parts"), F.floor(mc / 4).alias("message_tokens"), F.floor(pc / 4).alias("part_tokens"),
        F.round(n_parts / span, 2).alias("parts_per_minute"), F.round(F.floor(pc / 4) / span, 0).alias("tokens_per_minute"),
    )


def tokens_by_type(parts: DataFrame, chars: Column | None = None) -> DataFrame:
    """session_id, type, n, tokens (characters / 4, half up)."""
    chars = F.length("data") if chars is None else chars
    return parts.groupBy("session_id", "type").agg(F.count("*").alias("n"), F.round(F.sum(chars) / 4.0).cast("long").alias("tokens"))


def content_tokens(messages: DataFrame, field: str = "$.content") -> DataFrame:
    """session_id, n, chars and tokens of a JSON field."""
    chars = F.sum(F.length(F.get_json_object("data", field)))
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), chars.alias("chars"), F.round(chars / 4.0).cast("long").alias("tokens"))


def compare(stats: DataFrame, first, second, columns: list[str], key: str = "id") -> DataFrame:
    """One row: difference of the second session against the first in percent, one digit; null where the first has 0."""
    pick = lambda k, prefix: stats.where(F.col(key) == F.lit(k)).select(*(F.col(c).alias(f"{prefix}_{c}") for c in columns))
    both = pick(first, "a").crossJoin(pick(second, "b"))  # one row each
    return both.select(*(F.round((F.col(f"b_{c}") - F.col(f"a_{c}")) / F.nullif(F.col(f"a_{c}"), F.lit(0)) * 100, 1).alias(f"{c}_diff") for c in columns))


def recent(sessions: DataFrame, most: int = 10) -> DataFrame:
    """The newest sessions, ids and titles cut to 30 and 50 characters."""
    return sessions.orderBy(F.desc("time_created"), "id").limit(most).select(F.substring("id", 1, 30).alias("session_id"), F.substring("title", 1, 50).alias("title"), F.timestamp_millis("time_created").alias("created"))
