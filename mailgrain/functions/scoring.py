"""Per-message scores and rule outcomes.

Text arguments given as strings are names of lower-cased, non-null columns
(see :func:`mailgrain.functions.normalize.lowered`); the rest are columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailgrain.constants import (
    CONTENT_PATTERNS, IMPORTANT_SENDER_WORDS, IMPORTANT_SUBJECT_WORDS, MARKETING_LIKE, ORDER_BODY_WORDS,
    SERVICE_ADDRESS_WORDS, SERVICE_TYPE_WORDS, UNIMPORTANT_SUBJECT_WORDS,
)
from mailgrain.functions.normalize import contains_any, count_hits, like_any


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def whole_days(later: Column, earlier: Column) -> Column:
    """Number of complete 86400-second days, not calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("int")


def from_service_address(sender: str) -> Column:
    return contains_any(sender, SERVICE_ADDRESS_WORDS)


def service_type(sender: str, subject: str) -> Column:
    kind = F.when(F.lit(False), F.lit(""))
    for name, words in SERVICE_TYPE_WORDS.items():
        kind = kind.when(contains_any(subject, words) | contains_any(sender, words), name)
    return kind


def service_detection(sender: str, subject: str, body: str, kind: Column | None = None) -> Column:
    """``struct(is_service, confidence, service_type)``."""
    kind = kind if kind is not None else service_type(sender, subject)
    confidence = (
        F.when(from_service_address(sender), 0.3).otherwise(0.0)
        + F.when(contains_any(body, ["unsubscribe"]), 0.3).otherwise(0.0)
        + F.when(kind.isNotNull(), 0.2).otherwise(0.0)
    )
    confidence = F.least(F.lit(1.0), confidence)
    return F.struct(
        (confidence >= 0.3).alias("is_service"), confidence.alias("confidence"), kind.alias("service_type")
    )


def service_importance(sender: str, subject: str, is_service: Column) -> Column:
    """half from subject words, half from sender words; 0 for people."""
    good = count_hits(subject, IMPORTANT_SUBJECT_WORDS)
    poor = count_hits(subject, UNIMPORTANT_SUBJECT_WORDS)
    subject_score = (
        F.when((good > 0) & (poor == 0), F.least(F.lit(1.0), 0.5 + good * 0.2))
        .when((poor > 0) & (good == 0), F.greatest(F.lit(0.0), 0.3 - poor * 0.1))
        .when(good > poor, 0.6)
        .when(poor > good, 0.2)
        .otherwise(0.4)
    )
    senders = count_hits(sender, IMPORTANT_SENDER_WORDS)
    sender_score = F.when(senders > 0, F.least(F.lit(1.0), 0.5 + senders * 0.25)).otherwise(0.3)
    return F.when(is_service, clamp(0.5 * subject_score + 0.5 * sender_score)).otherwise(0.0)


def time_bucket(hour: Column) -> Column:
    """F8."""
    return (
        F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 20), "evening").otherwise("night")
    )


def business_hours(hour: Column, weekday: Column) -> Column:
    """Monday (0) to Friday, from 9 until before 17."""
    return weekday.between(0, 4) & (hour >= 9) & (hour < 17)


def relationship_strength(
    recent: Column, replied_rate: Column, sender_rate: Column, days_silent: Column, initiated: Column
) -> Column:
    """F10."""
    return clamp(
        0.35 * F.least(recent / 10.0, F.lit(1.0)) + 0.45 * replied_rate + 0.10 * sender_rate
        + 0.05 * (1.0 - F.least(days_silent / 90.0, F.lit(1.0))) + 0.05 * initiated
    )


def urgency_score(strength: Column, age_days: Column, in_hours: Column, attachment: Column) -> Column:
    """F11."""
    return clamp(
        0.4 * strength + 0.3 * F.greatest(F.lit(0.0), 1.0 - age_days / 7.0)
        + 0.2 * F.when(in_hours, 1.0).otherwise(0.5) + 0.1 * F.when(attachment, 1.0).otherwise(0.0)
    )


def content_patterns(body: str, subject: str) -> Column:
    """H1: struct of 11 booleans."""
    fields = {"body": body, "subject": subject}
    return F.struct(
        F.expr(f"contains({body}, '?') OR contains({subject}, '?')").alias("has_question"),
        *[contains_any(fields[field], words).alias(name) for name, (field, words) in CONTENT_PATTERNS.items()],
    )


def order_mentions(body: str) -> Column:
    """What H2 asks of an order mail: ``struct(any_word, delivery)``."""
    return F.struct(
        contains_any(body, ORDER_BODY_WORDS).alias("any_word"),
        contains_any(body, ["shipped", "tracking"]).alias("delivery"),
    )


def handleability(
    patterns: Column, order: Column, strength: Column, is_service: Column, kind: Column
) -> Column:
    """H2: first matching rule as ``struct(class, reason, metadata)``.

    ``patterns`` is H1's struct and ``order`` that of :func:`order_mentions`.

    Absent metadata keys are null, which ``to_json`` leaves out.
    """
    strength, service = F.coalesce(strength, F.lit(0.0)), F.coalesce(is_service, F.lit(False))
    kind = F.coalesce(kind, F.lit(""))
    p = {name: patterns[name] for name in ["has_question", *CONTENT_PATTERNS]}

    def outcome(name, reason, action=None, folder=None, tracked=None, priority=None, relation=None,
                personal=None, approval=None, draft=None, rank=None):
        def opt(value, kind_name):
            return (value if isinstance(value, Column) else F.lit(value)).cast(kind_name)

        return F.struct(
            F.lit(name).alias("class"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
            F.struct(
                opt(action, "string").alias("action"), opt(folder, "string").alias("folder"),
                opt(tracked, "boolean").alias("track_delivery"), opt(priority, "string").alias("priority"),
                opt(relation, "double").alias("relationship"),
                opt(personal, "boolean").alias("needs_personalization"),
                opt(approval, "boolean").alias("needs_approval"), opt(draft, "string").alias("draft_type"),
                opt(rank, "int").alias("llm_priority"), patterns.alias("patterns"),
            ).alias("metadata"),
        )

    bulk = service & kind.isin("marketing", "newsletter", "notification")
    bulk_folder = F.when(kind == "marketing", "Promotions").otherwise("Updates")
    file_it = "FILE_TO_FOLDER"
    return (
        F.when(bulk, outcome("ai_full", F.concat(F.lit("service_"), kind), file_it, bulk_folder))
        .when(p["is_calendar_response"], outcome("ai_full", "calendar_response", file_it, "Calendar"))
        .when(p["is_auto_reply"], outcome("ai_full", "auto_reply", file_it, "Auto-replies"))
        .when(p["is_newsletter"] & (strength < 0.2), outcome("ai_full", "newsletter_pattern", file_it, "Newsletters"))
        .when(
            service & (kind == "transactional") & order["any_word"],
            outcome("ai_full", "transactional", file_it, "Orders", tracked=order["delivery"]),
        )
        .when(p["has_approval"], outcome("human_required", "approval_request", "PREPARE_DECISION_CONTEXT", priority="high"))
        .when(
            (strength > 0.6) & ~service,
            outcome("human_required", "important_relationship", "PREPARE_DECISION_CONTEXT", relation=strength),
        )
        .when(
            ~service & p["has_confirm"] & (strength > 0.2),
            outcome("human_required", "explicit_reply_request", "DRAFT_REPLY", personal=True),
        )
        .when(
            p["has_deadline"] & p["has_request"] & ~service,
            outcome("human_required", "deadline_request", "PREPARE_DECISION_CONTEXT", priority="high"),
        )
        .when(
            p["has_scheduling"] & ~service & (strength < 0.5),
            outcome("ai_partial", "scheduling_request", "SCHEDULE_MEETING", approval=True),
        )
        .when(
            p["is_fyi"] & (strength > 0.1) & ~service,
            outcome("ai_partial", "fyi_from_contact", "DRAFT_REPLY", draft="acknowledgment"),
        )
        .when(
            p["has_confirm"] & (strength < 0.3),
            outcome("ai_partial", "confirm_request", "DRAFT_REPLY", draft="confirmation"),
        )
        .when(p["has_attachment_ref"], outcome("ai_partial", "has_attachment", "SUMMARIZE_ATTACHMENT"))
        .otherwise(outcome("needs_llm", "ambiguous", rank=model_priority(patterns, strength, service)))
    )


def model_priority(patterns: Column, strength: Column, is_service: Column) -> Column:
    """H3: 1 (first) to 5 (last) in the queue for the model."""
    return (
        F.when(strength > 0.4, 1).when(patterns["has_request"], 2).when(is_service, 4)
        .when(strength < 0.1, 5).otherwise(3)
    )


def feature_score(strength: Column, urgency: Column, is_service: Column, importance: Column) -> Column:
    """K1."""
    strength, urgency = F.coalesce(strength, F.lit(0.0)), F.coalesce(urgency, F.lit(0.0))
    importance = F.coalesce(importance, F.lit(0.5))
    return clamp(
        F.when(is_service, importance * 0.5 + urgency * 0.5).otherwise(strength * 0.6 + urgency * 0.4)
    )


def is_marketing(sender: str) -> Column:
    """M1: case-sensitive LIKE patterns on the named address column, ``_`` stands for any character."""
    return like_any(sender, MARKETING_LIKE)


def is_real_person(sender: str, reply_rate: Column, important: Column, emails_from: Column) -> Column:
    """M2."""
    return (
        F.when(is_marketing(sender), False).when(reply_rate > 0, True).when(important, True)
        .when(emails_from.between(1, 3), True).otherwise(False)
    )


def project_score(size, pct_replied, participants, last_activity, coherence, now: Column, config) -> tuple[Column, Column]:
    """(score, reason); every factor counts from its own threshold on."""
    size, participants = F.coalesce(size, F.lit(0)), F.coalesce(participants, F.lit(0))
    engagement = F.coalesce(pct_replied, F.lit(0.0)) / 100.0
    days = whole_days(now, last_activity)
    factors = [
        (size >= config.min_size, F.least(size / 50, F.lit(1.0)) * 0.25, F.concat(F.lit("size="), size)),
        (
            engagement >= config.min_engagement,
            F.least(engagement / 0.5, F.lit(1.0)) * 0.3,
            F.format_string("engagement=%.1f%%", engagement * 100),
        ),
        (
            participants >= config.min_participants,
            F.least(participants / 10, F.lit(1.0)) * 0.2,
            F.concat(F.lit("participants="), participants),
        ),
        (
            days < config.stale_days,
            F.greatest(F.lit(0.0), 1 - days / config.stale_days) * 0.25,
            F.concat(F.lit("days_since="), days),
        ),
        (coherence >= config.min_coherence, coherence * 0.1, F.format_string("coherence=%.2f", coherence)),
    ]
    score = F.lit(0.0)
    for gate, points, _ in factors:
        score = score + F.when(gate, points).otherwise(0.0)
    return score, F.concat_ws(", ", *[F.when(gate, reason) for gate, _, reason in factors])


def project_status(last_activity: Column, now: Column, config) -> Column:
    """N3."""
    days = whole_days(now, last_activity)
    return (
        F.when(last_activity.isNull(), "stale").when(days > config.completed_days, "completed")
        .when(days > config.stale_days, "stale").otherwise("active")
    )


def temporal_strength(last_7d: Column, prev_7d: Column, last_activity: Column, now: Column) -> tuple[Column, Column, Column]:
    """(strength, velocity, trend)."""
    velocity = F.least(last_7d / 7.0, F.lit(5.0)) / 5.0
    trend = (
        F.when(prev_7d > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (last_7d - prev_7d) / prev_7d)))
        .when(last_7d > 0, 1.0).otherwise(0.0)
    )
    recency = F.coalesce(F.pow(F.lit(2.0), -whole_days(now, last_activity) / 7.0), F.lit(0.0))
    return recency * 0.35 + velocity * 0.35 + (trend + 1) / 2 * 0.30, velocity, trend
