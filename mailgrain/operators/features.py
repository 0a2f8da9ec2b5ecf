"""Sender statistics and message features (operators F1-F5, F12)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import scoring as S
from mailgrain.functions.html import strip_html_basic
from mailgrain.functions.normalize import spaced_words, word_count
from mailgrain.operators.actions import reference_date
from mailgrain.session import loose


def _ref(messages: DataFrame, ref: datetime | Column | None) -> Column:
    if isinstance(ref, Column):
        return ref
    return F.lit(ref).cast("timestamp") if ref is not None else reference_date(messages)


def sender_counts(messages: DataFrame, ref: datetime | None = None) -> DataFrame:
    """received per sender: all, last 7, 30 and 90 days, last date."""
    received = messages.filter(~F.col("is_sent")).select("from_email", "date_parsed")
    received = received.withColumn("_age", F.unix_micros(_ref(messages, ref)) - F.unix_micros("date_parsed"))

    def since(days: int) -> Column:
        return F.count_if(F.col("_age") <= days * 86_400_000_000)

    return received.groupBy(F.lower("from_email").alias("sender")).agg(
        F.count(F.lit(1)).alias("emails_all"),
        since(7).alias("emails_7d"),
        since(30).alias("emails_30d"),
        since(90).alias("emails_90d"),
        F.max("date_parsed").alias("last_received"),
    )


def user_replies(messages: DataFrame) -> DataFrame:
    """answered messages and mean response hours per sender.

    Replies are summed per answered message before the sender aggregation, so
    the distinct count is a plain count.
    """
    received = messages.filter(~F.col("is_sent")).select(
        "id", "message_id", F.lower("from_email").alias("sender"), F.col("date_parsed").alias("_asked")
    )
    answers = messages.filter(F.col("is_sent") & F.col("in_reply_to").isNotNull()).select(
        F.col("in_reply_to").alias("message_id"), (F.unix_micros("date_parsed") / 1e6).alias("_answered")
    )
    # reply times have no condition on the received date, so they are summed
    # per answered message before they meet the messages
    per_message = answers.groupBy("message_id").agg(F.sum("_answered").alias("_sum"), F.count("_answered").alias("_n"))
    joined = received.join(per_message, "message_id").withColumn(
        "_seconds", F.col("_sum") - F.col("_n") * (F.unix_micros("_asked") / 1e6)
    )
    return joined.groupBy("sender").agg(
        F.count(F.lit(1)).alias("replied_count"),
        (F.sum("_seconds") / F.sum(F.when(F.col("_seconds").isNotNull(), F.col("_n"))) / 3600).alias("avg_response_hours"),
    )


def user_initiated(messages: DataFrame) -> DataFrame:
    """sent messages per recipient."""
    recipients = messages.filter("is_sent").select(F.explode("to_emails").alias("recipient"))
    return recipients.groupBy(F.lower("recipient").alias("recipient")).agg(F.count(F.lit(1)).alias("initiated_count"))


def sender_reply_rate(messages: DataFrame) -> DataFrame:
    """share of sent messages that drew a received reply, per sending address."""
    sent = messages.filter("is_sent").select("message_id", F.lower("from_email").alias("sender"))
    answered = messages.filter(~F.col("is_sent") & F.col("in_reply_to").isNotNull()).select(
        F.col("in_reply_to").alias("message_id")
    ).distinct().withColumn("_answered", F.lit(1.0))
    return sent.join(answered, "message_id", "left").groupBy("sender").agg(
        F.avg(F.coalesce("_answered", F.lit(0.0))).alias("reply_rate")
    )


def sender_stats(messages: DataFrame, ref: datetime | None = None) -> DataFrame:
    """F1 with F2-F4 attached, zeros where absent."""
    stats = sender_counts(messages, ref)
    stats = stats.join(user_replies(messages), "sender", "left")
    stats = stats.join(user_initiated(messages).withColumnRenamed("recipient", "sender"), "sender", "left")
    stats = stats.join(sender_reply_rate(messages), "sender", "left")
    return stats.select(
        "sender", "emails_all", "emails_7d", "emails_30d", "emails_90d", "last_received",
        F.coalesce("replied_count", F.lit(0)).alias("user_replied_count"),
        F.coalesce("avg_response_hours", F.lit(0.0)).alias("avg_response_hours"),
        F.coalesce("initiated_count", F.lit(0)).alias("user_initiated_count"),
        F.coalesce("reply_rate", F.lit(0.0)).alias("sender_reply_rate"),
    )


def message_features(
    messages: DataFrame, stats: DataFrame | None = None, ref: datetime | Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """one feature row per received message.

    The sender lookup has one row per sender.  It grows with the mailbox, so
    it carries no broadcast hint: the planner broadcasts it while it is small,
    and beyond that it is dealt out apart from its aggregation, which lets
    adaptive execution split a hot sender.

    Columns of the messages in ``keep`` come along; ``stats`` then has a row
    for each sender and value of them.
    """
    stats = stats if stats is not None else sender_stats(messages, ref)
    latest = _ref(messages, ref)
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    attached = F.array_contains(labels, "Has attachment") | F.exists(
        labels, lambda label: F.lower(label).contains("has:attachment")
    )
    # everything read off the texts first: the rows that meet the sender
    # statistics carry flags and counts, not bodies
    received = messages.filter(~F.col("is_sent")).select(
        F.col("id").alias("email_id"), F.lower(F.coalesce("from_email", F.lit(""))).alias("sender"),
        F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body_text", F.lit("")).alias("body"),
        "date_parsed", "to_emails", "cc_emails", "labels", *keep,
    ).withColumns({
        "plain_body": strip_html_basic("body"),
        "head": F.lower("subject"),
        "text": F.lower("body"),
        "hour_of_day": F.coalesce(F.hour("date_parsed"), F.lit(0)),
        "day_of_week": F.coalesce(F.weekday("date_parsed"), F.lit(0)),
        "has_attachments": F.coalesce(attached, F.lit(False)),
    })
    received = received.withColumn("kind", S.service_type("sender", "head"))
    received = received.withColumn("service", S.service_detection("sender", "head", "text", F.col("kind")))
    received = received.select(
        "email_id", "sender", "date_parsed", "service", "hour_of_day", "day_of_week", "has_attachments", *keep,
        S.service_importance("sender", "head", F.col("service.is_service")).alias("service_importance"),
        F.lower("plain_body").contains("unsubscribe").alias("has_unsubscribe_link"),
        S.from_service_address("sender").alias("from_common_service_domain"),
        word_count("subject").alias("subject_word_count"),
        spaced_words(F.col("plain_body")).alias("body_word_count"),
        (
            F.coalesce(F.size("to_emails"), F.lit(0)) + F.coalesce(F.size("cc_emails"), F.lit(0))
        ).alias("recipient_count"),
    )
    rows = received.join(loose(stats), ["sender", *keep], "left")

    def stat(name: str, default=0) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    total = stat("emails_all")
    initiated = stat("user_initiated_count")
    rows = rows.withColumns({
        "days_since_received": F.coalesce(S.whole_days(latest, F.col("date_parsed")), F.lit(0)),
        "days_since_last_interaction": F.coalesce(S.whole_days(latest, F.col("last_received")), F.lit(0)),
        "replied_rate": F.when(total > 0, stat("user_replied_count") / total).otherwise(0.0),
        "initiated_ratio": F.when(total + initiated > 0, initiated / (total + initiated)).otherwise(0.0),
        "is_business_hours": S.business_hours(F.col("hour_of_day"), F.col("day_of_week")),
    })
    rows = rows.withColumn(
        "relationship_strength",
        S.relationship_strength(
            stat("emails_30d"), F.col("replied_rate"), stat("sender_reply_rate", 0.0),
            F.col("days_since_last_interaction"), F.col("initiated_ratio"),
        ),
    )
    is_service = F.col("service.is_service")
    return rows.select(
        "email_id",
        stat("emails_7d").alias("emails_from_sender_7d"),
        stat("emails_30d").alias("emails_from_sender_30d"),
        stat("emails_90d").alias("emails_from_sender_90d"),
        total.alias("emails_from_sender_all"),
        stat("user_replied_count").alias("user_replied_to_sender_count"),
        F.col("replied_rate").alias("user_replied_to_sender_rate"),
        stat("avg_response_hours", 0.0).alias("avg_response_time_hours"),
        F.col("initiated_ratio").alias("user_initiated_ratio"),
        "days_since_last_interaction",
        stat("sender_reply_rate", 0.0).alias("sender_replies_to_you_rate"),
        "relationship_strength",
        is_service.alias("is_service_email"),
        F.col("service.confidence").alias("service_confidence"),
        F.col("service.service_type").alias("service_type"),
        "service_importance",
        "has_unsubscribe_link",
        F.lit(False).alias("has_list_unsubscribe_header"),
        "from_common_service_domain",
        "hour_of_day",
        "day_of_week",
        (F.col("day_of_week") >= 5).alias("is_weekend"),
        "is_business_hours",
        "days_since_received",
        (F.col("days_since_received") < 7).alias("is_recent"),
        S.time_bucket(F.col("hour_of_day")).alias("time_bucket"),
        S.urgency_score(
            F.col("relationship_strength"), F.col("days_since_received"), F.col("is_business_hours"),
            F.col("has_attachments"),
        ).alias("urgency_score"),
        "subject_word_count",
        "body_word_count",
        "has_attachments",
        F.col("has_attachments").cast("int").alias("attachment_count"),
        "recipient_count",
        *keep,
    )
