"""How each message was handled (operators E1-E9)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.constants import (
    AUTOMATED_REPLY_SENDERS, AUTOMATED_REPLY_SUBJECTS, FREQUENT_SENDER_ABOVE, IMMEDIATE_BELOW,
    NEXT_DAY_BELOW, SAME_DAY_BELOW, STALE_AFTER_DAYS,
)
from mailgrain.functions.normalize import contains_any
from mailgrain.session import loose


LABEL_COLUMNS = ["action", "timing", "response_time_seconds"]


def response_bucket(seconds: Column) -> Column:
    """How fast a reply came."""
    return (
        F.when(seconds < IMMEDIATE_BELOW, "IMMEDIATE")
        .when(seconds < SAME_DAY_BELOW, "SAME_DAY")
        .when(seconds < NEXT_DAY_BELOW, "NEXT_DAY")
        .when(seconds.isNotNull(), "LATER")
    )


def mark_sent(messages: DataFrame, addresses: list[str]) -> DataFrame:
    """Messages from one of the user's own addresses are sent."""
    if not addresses:
        return messages
    own = F.lower("from_email").isin([a.lower() for a in addresses])
    return messages.withColumn("is_sent", F.when(own, F.lit(True)).otherwise(F.col("is_sent")))


def _automated_reply() -> Column:
    # a null sender or subject leaves it open whether a person answered
    return contains_any("lower(from_email)", AUTOMATED_REPLY_SENDERS) | contains_any(
        "lower(subject)", AUTOMATED_REPLY_SUBJECTS
    )


def _first_answers(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """``id, response_seconds`` of the earliest later reply to each message.

    ``message_id`` is unique, so the join keeps one row per reply; the minimum
    per ``id`` is taken map-side before its shuffle.  The aggregation key is
    not the join key, which leaves adaptive execution free to split a message
    that drew a large share of all replies.
    """
    asked = messages.select("id", "message_id", F.col("date_parsed").alias("_asked"), F.col("is_sent").alias("_own"))
    answers = replies.filter(F.col("in_reply_to").isNotNull() & F.col("date_parsed").isNotNull()).select(
        F.col("in_reply_to").alias("message_id"), F.col("date_parsed").alias("_answered"), F.col("is_sent").alias("_by_me")
    )
    pairs = asked.join(answers, "message_id").filter(
        (F.col("_answered") > F.col("_asked")) & (F.col("_own") != F.col("_by_me"))
    )
    first = pairs.groupBy("id").agg(F.min("_answered").alias("_answered"), F.min("_asked").alias("_asked"))
    seconds = (F.unix_micros("_answered") - F.unix_micros("_asked")) / 1e6
    return first.select("id", seconds.alias("response_seconds"))


def replied(messages: DataFrame) -> DataFrame:
    """Received messages the user answered; earliest answer counts."""
    answers = _first_answers(messages.filter(~F.col("is_sent")), messages.filter("is_sent"))
    return _with_timing(answers)


def reverse_tracking(messages: DataFrame) -> DataFrame:
    """Sent messages others answered, bounces and auto-replies excluded."""
    # a null sender or subject makes the exclusion unknown, hence no match
    human = messages.filter(~F.col("is_sent") & ~_automated_reply())
    return _with_timing(_first_answers(messages.filter("is_sent"), human))


def _with_timing(answers: DataFrame) -> DataFrame:
    return answers.select(
        "id",
        F.round("response_seconds").cast("int").alias("response_time_seconds"),
        response_bucket(F.col("response_seconds")).alias("timing"),
    )


def _has_label(label: str) -> Column:
    return F.coalesce(F.array_contains("labels", label), F.lit(False))


def frequent_senders(contacts: DataFrame) -> DataFrame:
    """Lower-cased addresses that sent more than the threshold; a hot sender can be split at the join with them."""
    return loose(contacts.filter(F.col("emails_from") > FREQUENT_SENDER_ABOVE).select(
        F.lower("email").alias("_sender")
    ).distinct())


def is_starred() -> Column:
    """E4."""
    return _has_label("Starred")


def is_archivable(cutoff: Column) -> Column:
    """E5: old, and filed, shared, addressed to several or from a frequent sender.

    Needs the boolean ``_frequent``.
    """
    filed = _has_label("Archived") | (F.col("labels").isNotNull() & ~_has_label("Unread") & ~_has_label("Inbox"))
    shared = (F.coalesce(F.size("cc_emails"), F.lit(0)) >= 1) | (F.coalesce(F.size("to_emails"), F.lit(0)) > 1)
    return (F.col("date_parsed") < cutoff) & (filed | shared | F.col("_frequent"))


def is_ignorable(cutoff: Column) -> Column:
    """Old, unread, to the user alone and not from a frequent sender."""
    alone = F.col("cc_emails").isNull() & (F.col("to_emails").isNull() | (F.size("to_emails") == 1))
    return (F.col("date_parsed") < cutoff) & _has_label("Unread") & alone & ~F.col("_frequent")


def reference_date(messages: DataFrame) -> Column:
    """Latest message date, as a scalar subquery."""
    return messages.agg(F.max("date_parsed")).scalar()


def _cutoff(messages: DataFrame, ref: datetime | None) -> Column:
    ref_col = F.lit(ref).cast("timestamp") if ref is not None else reference_date(messages)
    return ref_col - F.expr(f"INTERVAL {STALE_AFTER_DAYS} DAYS")


def with_frequent_flag(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    senders = frequent_senders(contacts).withColumn("_frequent", F.lit(True))
    joined = messages.join(senders, F.lower(messages["from_email"]) == F.col("_sender"), "left")
    return joined.withColumn("_frequent", F.coalesce("_frequent", F.lit(False))).drop("_sender")


def starred(messages: DataFrame) -> DataFrame:
    """Received, not yet labelled messages with the Starred label."""
    return messages.filter(~F.col("is_sent") & F.col("action").isNull() & is_starred())


def archived(messages: DataFrame, contacts: DataFrame, ref: datetime | None = None) -> DataFrame:
    """E5 on its own: received, not yet labelled, archivable messages."""
    open_mail = with_frequent_flag(messages.filter(~F.col("is_sent") & F.col("action").isNull()), contacts)
    return open_mail.filter(is_archivable(_cutoff(messages, ref))).drop("_frequent")


def ignored(messages: DataFrame, contacts: DataFrame, ref: datetime | None = None) -> DataFrame:
    """E6 on its own: received, not yet labelled, ignorable messages."""
    open_mail = messages.filter(~F.col("is_sent") & F.col("action").isNull())
    open_mail = open_mail.join(
        frequent_senders(contacts), F.lower(open_mail["from_email"]) == F.col("_sender"), "left_anti"
    ).withColumn("_frequent", F.lit(False))
    return open_mail.filter(is_ignorable(_cutoff(messages, ref))).drop("_frequent")


def pending_composed(messages: DataFrame) -> DataFrame:
    """The rest: received is PENDING, sent is COMPOSED."""
    rest = F.when(F.col("is_sent"), "COMPOSED").when(~F.col("is_sent"), "PENDING")
    return messages.withColumn("action", F.coalesce(F.col("action"), rest))


def label_actions(
    messages: DataFrame, contacts: DataFrame, addresses: list[str], ref: datetime | None = None
) -> DataFrame:
    """E2 to E8 as one cascade; sets ``action, timing, response_time_seconds``.

    Both directions of reply tracking share one join: a message is either sent
    or received, so it has at most one kind of answer.  The cascade runs on the
    columns it reads; message texts are shuffled once, when the labels are
    joined to them.
    """
    marked = mark_sent(messages, addresses)
    counts_as_answer = F.when(F.col("is_sent"), F.lit(True)).otherwise(~_automated_reply())
    answers = _first_answers(marked, marked.filter(counts_as_answer))
    narrow = marked.select(
        "id", "from_email", "date_parsed", "labels", "to_emails", "cc_emails", "is_sent", *LABEL_COLUMNS
    )
    flagged = with_frequent_flag(narrow, contacts).join(answers, "id", "left")

    answered = F.col("response_seconds").isNotNull()
    received, sent = ~F.col("is_sent"), F.col("is_sent")
    flagged = flagged.withColumn("_cutoff", _cutoff(messages, ref))
    label = (
        F.when(received & answered, "REPLIED")
        .when(received & is_starred(), "STARRED")
        .when(received & is_archivable(F.col("_cutoff")), "ARCHIVED")
        .when(received & is_ignorable(F.col("_cutoff")), "IGNORED")
        .when(received, "PENDING")
        .when(sent, "COMPOSED")
    )
    flagged = flagged.withColumn("_label", F.when(F.col("action").isNull(), label))
    tracked = (F.col("_label") == "REPLIED") | (sent & answered)
    never = F.col("_label").isin("ARCHIVED", "IGNORED")
    labels = flagged.select(
        "id",
        F.coalesce("action", "_label").alias("action"),
        F.when(tracked, response_bucket(F.col("response_seconds")))
        .when(never, "NEVER").otherwise(F.col("timing")).alias("timing"),
        F.when(tracked, F.round("response_seconds").cast("int"))
        .otherwise(F.col("response_time_seconds")).alias("response_time_seconds"),
    )
    return marked.drop(*LABEL_COLUMNS).join(labels, "id").select(
        *[c for c in messages.columns if c not in LABEL_COLUMNS], *LABEL_COLUMNS
    )


def action_counts(labelled: DataFrame) -> DataFrame:
    """Messages per action."""
    return labelled.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
