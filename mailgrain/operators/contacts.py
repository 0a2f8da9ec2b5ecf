"""Contact profiles (operators G1-G11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _address(c: Column) -> Column:
    return F.lower(F.trim(c))


def contact_roles(messages: DataFrame) -> DataFrame:
    """One narrow row per (message, role, address): the input of every profile count."""
    sender = F.array(
        F.struct(_address(F.col("from_email")).alias("email"), F.lit("from").alias("role"), F.col("from_name").alias("name"))
    )

    def listed(column: str, role: str) -> Column:
        return F.transform(
            F.coalesce(column, F.array().cast("array<string>")),
            lambda a: F.struct(
                _address(a).alias("email"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("name")
            ),
        )

    exploded = messages.select(
        "thread_id", "in_reply_to", "response_time_seconds", "date_parsed",
        F.explode(F.concat(sender, listed("to_emails", "to"), listed("cc_emails", "cc"))).alias("r"),
    )
    return exploded.select(
        "r.email", "r.role", "r.name", "thread_id", "in_reply_to", "response_time_seconds", "date_parsed"
    ).filter(F.col("email").contains("@"))


def is_you(email: Column, you: str) -> Column:
    """The address itself, or the same domain with the local part inside."""
    you = (you or "").lower()
    if not you:
        return F.lit(False)
    same = F.lower(email) == you
    if "@" in you:
        local, domain = you.split("@")[0], you.split("@")[1]
        same = same | (F.lower(email).endswith("@" + domain) & F.lower(email).contains(local))
    return same


def _is_from() -> Column:
    return F.col("role") == "from"


def _sent_count() -> Column:
    return F.count_if(_is_from())


def _received_count() -> Column:
    return F.count_if(~_is_from())


def _reply_count() -> Column:
    return F.count_if(_is_from() & F.col("in_reply_to").isNotNull() & (F.col("in_reply_to") != ""))


def _mean_response() -> Column:
    return F.round(
        F.avg(F.when(_is_from() & (F.col("response_time_seconds") > 0), F.col("response_time_seconds")))
    ).cast("int")


def address_universe(messages: DataFrame) -> DataFrame:
    """G1: every address seen, with the largest display name."""
    return contact_roles(messages).groupBy("email").agg(F.max("name").alias("name"))


def emails_from(messages: DataFrame) -> DataFrame:
    """G3."""
    return contact_roles(messages).filter(_is_from()).groupBy("email").agg(F.count(F.lit(1)).alias("emails_from"))


def emails_to(messages: DataFrame) -> DataFrame:
    """G4."""
    return contact_roles(messages).filter(~_is_from()).groupBy("email").agg(F.count(F.lit(1)).alias("emails_to"))


def threads_with(messages: DataFrame) -> DataFrame:
    """Distinct threads; made distinct before the per-address count."""
    pairs = contact_roles(messages).filter(F.col("thread_id").isNotNull()).select("email", "thread_id").distinct()
    return pairs.groupBy("email").agg(F.count(F.lit(1)).alias("threads_with"))


def reply_count(messages: DataFrame) -> DataFrame:
    """G6."""
    return contact_roles(messages).groupBy("email").agg(_reply_count().alias("reply_count")).filter("reply_count > 0")


def avg_response(messages: DataFrame) -> DataFrame:
    """G7."""
    return contact_roles(messages).groupBy("email").agg(
        _mean_response().alias("avg_response_time_seconds")
    ).filter(F.col("avg_response_time_seconds").isNotNull())


def contact_span(messages: DataFrame) -> DataFrame:
    """G10."""
    dated = contact_roles(messages).filter(F.col("date_parsed").isNotNull())
    return dated.groupBy("email").agg(F.min("date_parsed").alias("first_contact"), F.max("date_parsed").alias("last_contact"))


def reply_rate(contacts: DataFrame) -> DataFrame:
    """Add ``reply_rate`` = min(1, replies / received); null without replies and receipts."""
    rate = F.when(
        F.col("emails_to") > 0, F.least(F.lit(1.0), F.col("reply_count") / F.col("emails_to"))
    ).when(F.col("reply_count") > 0, 0.0)
    return contacts.withColumn("reply_rate", rate)


def important_sender(contacts: DataFrame) -> DataFrame:
    """Add ``is_important_sender``."""
    rate, sent, received = F.col("reply_rate"), F.col("emails_from"), F.col("emails_to")
    engaged = ((rate >= 0.5) & (received >= 2)) | ((sent >= 3) & (received >= 3)) | (rate >= 0.8)
    important = ~F.col("is_you") & (sent > 0) & engaged
    return contacts.withColumn("is_important_sender", F.coalesce(important, F.lit(False)))


def build_contacts(messages: DataFrame, you: str) -> DataFrame:
    """All profile columns from one explode.

    The user's own address is part of nearly every message.  Rows are
    aggregated per (address, thread) first and per address after that, which
    spreads such an address over many tasks and makes the thread count exact
    without a distinct aggregate.
    """
    per_thread = contact_roles(messages).groupBy("email", "thread_id").agg(
        F.max("name").alias("name"),
        _sent_count().alias("n_from"),
        _received_count().alias("n_to"),
        _reply_count().alias("n_replies"),
        F.sum(F.when(_is_from() & (F.col("response_time_seconds") > 0), F.col("response_time_seconds"))).alias("s_resp"),
        F.count_if(_is_from() & (F.col("response_time_seconds") > 0)).alias("n_resp"),
        F.min("date_parsed").alias("first"),
        F.max("date_parsed").alias("last"),
    )
    contacts = per_thread.groupBy("email").agg(
        F.max("name").alias("name"),
        F.sum("n_from").alias("emails_from"),
        F.sum("n_to").alias("emails_to"),
        F.count("thread_id").alias("threads_with"),
        F.sum("n_replies").alias("reply_count"),
        F.round(F.sum("s_resp") / F.sum("n_resp")).cast("int").alias("avg_response_time_seconds"),
        F.min("first").alias("first_contact"),
        F.max("last").alias("last_contact"),
    )
    return important_sender(reply_rate(contacts.withColumn("is_you", is_you(F.col("email"), you))))


def contact_totals(contacts: DataFrame) -> DataFrame:
    """How many contacts, own addresses and important senders."""
    return contacts.agg(
        F.count(F.lit(1)).alias("unique_emails"),
        F.count_if("is_you").alias("is_you_count"),
        F.count_if("is_important_sender").alias("important_sender_count"),
    )
