"""Rule classification of received messages (operator H4 over H1-H3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import scoring as S
from mailgrain.functions.normalize import lowered

STORED_FLAGS = [
    "has_question", "has_request", "has_scheduling", "has_deadline", "has_approval", "has_confirm",
    "is_newsletter", "is_fyi", "is_calendar_response", "has_attachment_ref",
]


def classify_messages(messages: DataFrame, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """H4: one class row per received message that has features; ``keep`` names columns of both that come along."""
    # patterns are read off the texts before the join, which then moves flags only
    rows = lowered(messages.filter(~F.col("is_sent")), body="body_text", head="subject").select(
        F.col("id").alias("email_id"), S.content_patterns("body", "head").alias("patterns"),
        S.order_mentions("body").alias("order"), *keep,
    )
    rows = rows.join(
        features.select("email_id", "relationship_strength", "is_service_email", "service_type", *keep), ["email_id", *keep]
    )
    rows = rows.withColumn(
        "outcome",
        S.handleability(
            F.col("patterns"), F.col("order"), F.col("relationship_strength"), F.col("is_service_email"),
            F.col("service_type"),
        ),
    )
    return rows.select(
        "email_id",
        F.col("outcome.class").alias("predicted_handleability"),
        F.col("outcome.reason").alias("classification_reason"),
        F.to_json("outcome.metadata").alias("classification_metadata"),
        *[F.col(f"patterns.{flag}").alias(flag) for flag in STORED_FLAGS],
        (F.col("outcome.class") == "needs_llm").alias("needs_llm_classification"),
        F.col("outcome.metadata.llm_priority").alias("llm_priority"),
        *keep,
    )


def class_counts(classes: DataFrame) -> DataFrame:
    """H4: messages per class."""
    return classes.groupBy("predicted_handleability").agg(F.count(F.lit(1)).alias("n"))
