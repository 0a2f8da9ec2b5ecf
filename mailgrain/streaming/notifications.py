"""Push notifications and sync state (operators Q1-Q5, Q9, Q10).

Every function takes a batch or a streaming frame, except the de-duplication,
which keeps state and is streaming only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOTIFICATION = "emailAddress string, historyId string"


def parse_notifications(frame: DataFrame, column: str = "data") -> DataFrame:
    """Q1: base64 JSON to ``email, history_id``; ``error`` says what is wrong with a bad row."""
    text = F.make_valid_utf8(F.try_to_binary(F.col(column), F.lit("base64")).cast("string"))
    payload = F.from_json(text, _NOTIFICATION)
    parsed = frame.withColumn("_p", payload)
    is_object = F.get_json_object(text, "$").startswith("{")
    email, history = F.col("_p.emailAddress"), F.col("_p.historyId")
    error = (
        F.when(~F.coalesce(is_object, F.lit(False)), "Failed to decode notification")
        .when(F.coalesce(email, F.lit("")) == "", "Missing emailAddress in notification")
        .when(F.coalesce(history, F.lit("")) == "", "Missing historyId in notification")
    )
    return parsed.withColumn("email", email).withColumn("history_id", history).withColumn("error", error).drop("_p")


def valid_notifications(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def bad_notifications(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def dedup_notifications(stream: DataFrame, time_column: str, ttl: str = "300 seconds") -> DataFrame:
    """Q2: drop repeats of (email, history_id) within ``ttl`` of event time.

    A key is remembered until the watermark passes its first sight plus
    ``ttl``, so the state is bounded by time and not by a number of entries.
    """
    return stream.withWatermark(time_column, ttl).dropDuplicatesWithinWatermark(["email", "history_id"])


def match_users(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """Q3: attach ``user_id``; an unknown address has ``error`` set."""
    accounts = users.select("email", "user_id")
    unknown = F.when(F.col("user_id").isNull(), F.concat(F.lit("User not found: "), F.col("email")))
    return notifications.join(accounts, "email", "left").withColumn("error", unknown)


def notification_counters(notifications: DataFrame, time_column: str) -> DataFrame:
    """Q4: notifications and last time per user (update mode when streaming)."""
    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("notification_count"), F.max(time_column).alias("last_notification_at")
    )


def changed_ids(history: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: new message ids per user beyond its mark, and the new marks.

    ``history`` has ``user_id, history_id, messages_added`` (array of
    ``struct<message: struct<id>>``); ``marks`` has ``user_id, last_history_id``.
    History ids are compared as numbers.
    """
    since = marks.select("user_id", F.col("last_history_id").cast("bigint").alias("_mark"))
    fresh = history.join(since, "user_id", "left").filter(
        F.col("history_id").cast("bigint") > F.coalesce("_mark", F.lit(0))
    )
    ids = fresh.select("user_id", F.explode("messages_added").alias("_a")).select(
        "user_id", F.col("_a.message.id").alias("message_id")
    ).filter(F.col("message_id").isNotNull()).distinct()
    seen = fresh.groupBy("user_id").agg(F.max(F.col("history_id").cast("bigint")).alias("_new"))
    new_marks = since.join(seen, "user_id", "full_outer").select(
        "user_id", F.greatest("_mark", "_new").alias("last_history_id")
    )
    return ids, new_marks


def sync_status(log: DataFrame, users: DataFrame) -> DataFrame:
    """Q9: current sync state per user, ``not_synced`` without a log row.

    ``log`` has ``user_id, at, event`` (start, complete, fail),
    ``emails_synced, history_id, error_message``.
    """
    done = F.col("event") == "complete"
    state = log.groupBy("user_id").agg(
        F.max(F.struct("at", "event", "error_message")).alias("_last"),
        F.max(F.when(done, F.struct("at", "emails_synced"))).alias("_done"),
        F.max(F.when(done & F.col("history_id").isNotNull(), F.struct("at", "history_id"))).alias("_mark"),
    )
    status = (
        F.when(F.col("_last.event") == "start", "syncing").when(F.col("_last.event") == "fail", "error")
        .when(F.col("_last.event") == "complete", "idle").otherwise("not_synced")
    )
    return users.select("user_id").join(state, "user_id", "left").select(
        "user_id",
        status.alias("status"),
        F.coalesce("_done.emails_synced", F.lit(0)).alias("emails_synced"),
        F.col("_done.at").alias("last_sync_at"),
        F.col("_mark.history_id").alias("last_history_id"),
        F.when(F.col("_last.event") == "fail", F.col("_last.error_message")).alias("error"),
    )


def active_watches(subscriptions: DataFrame) -> DataFrame:
    """Q10."""
    return subscriptions.filter(F.col("status") == "active")


def expiring_watches(subscriptions: DataFrame, now, hours: int = 24) -> DataFrame:
    """Q10: active subscriptions that end within ``hours``."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return active_watches(subscriptions).filter(F.col("expiration") <= at + F.expr(f"INTERVAL {hours} HOURS"))
