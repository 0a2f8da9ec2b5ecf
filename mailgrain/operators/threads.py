"""Thread roll-up (operators D1-D3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _epoch(c: str):
    return F.unix_micros(F.col(c)) / 1e6


def build_threads(messages: DataFrame) -> DataFrame:
    """D3: one row per thread, counts, span, participants and mean gap.

    Messages are first aggregated per (thread, sender): that is the partial
    result of every count and makes the participants distinct, so a thread
    holding a large share of the mailbox reaches its final task as one row per
    participant.  The mean gap between consecutive messages is the span over
    the number of gaps (the differences telescope), so no ordering is needed.
    """
    threaded = messages.filter(F.col("thread_id").isNotNull())
    by_sender = threaded.groupBy("thread_id", "from_email").agg(
        F.min("subject").alias("subject"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_sent")).alias("n_sent"),
        F.count_if(F.col("is_sent") & F.col("in_reply_to").isNotNull()).alias("n_sent_replies"),
        F.count("date_parsed").alias("n_dated"),
        F.min("date_parsed").alias("first"),
        F.max("date_parsed").alias("last"),
        F.bool_or("has_attachments").alias("any_attachment"),
        F.sum("attachment_count").alias("attachments"),
    )
    rolled = by_sender.groupBy("thread_id").agg(
        F.min("subject").alias("subject"),
        F.array_sort(F.collect_list("from_email")).alias("participants"),
        F.sum("n").alias("email_count"),
        F.sum("n_sent").alias("your_email_count"),
        F.sum("n_sent_replies").alias("your_reply_count"),
        F.min("first").alias("started_at"),
        F.max("last").alias("last_activity"),
        F.sum("n_dated").alias("_dated"),
        F.coalesce(F.bool_or("any_attachment"), F.lit(False)).alias("has_attachments"),
        F.coalesce(F.sum("attachments"), F.lit(0)).alias("total_attachment_count"),
    )
    duration = _epoch("last_activity") - _epoch("started_at")
    return rolled.withColumn("thread_duration_seconds", duration).withColumn(
        "avg_response_time_seconds", F.when(F.col("_dated") > 1, duration / (F.col("_dated") - 1))
    ).drop("_dated")


def thread_rollup(messages: DataFrame) -> DataFrame:
    """The roll-up without the mean gap."""
    return build_threads(messages).drop("avg_response_time_seconds")


def thread_response_gap(messages: DataFrame) -> DataFrame:
    """Mean seconds between consecutive messages, threads with a gap only."""
    dated = messages.filter(F.col("thread_id").isNotNull()).groupBy("thread_id").agg(
        F.count("date_parsed").alias("_dated"), F.min("date_parsed").alias("_first"), F.max("date_parsed").alias("_last")
    )
    gap = (_epoch("_last") - _epoch("_first")) / (F.col("_dated") - 1)
    return dated.filter(F.col("_dated") > 1).select("thread_id", gap.alias("avg_response_time_seconds"))
