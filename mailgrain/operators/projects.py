"""Cluster activity and project detection (operators N1-N11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions import scoring as S


@dataclass(frozen=True)
class ProjectRules:
    """Thresholds of N2 and N3 (fixed values)."""

    min_size: int = 5
    min_engagement: float = 0.2
    stale_days: int = 14
    completed_days: int = 30
    min_coherence: float = 0.5
    min_participants: int = 2


def _now(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _members(assignments: DataFrame, messages: DataFrame) -> DataFrame:
    placed = assignments.filter(F.col("content_cluster_id").isNotNull()).select(
        "email_id", F.col("content_cluster_id").alias("cluster_id")
    )
    return placed.join(messages.select(F.col("id").alias("email_id"), "from_email", "date_parsed"), "email_id")


def cluster_activity(assignments: DataFrame, messages: DataFrame) -> DataFrame:
    """Last activity, messages and senders of every content cluster.

    Aggregated per (cluster, sender) first, so a cluster that holds a large
    share of the messages is spread by its senders.
    """
    by_sender = _members(assignments, messages).groupBy("cluster_id", "from_email").agg(
        F.max("date_parsed").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return by_sender.groupBy("cluster_id").agg(
        F.max("last").alias("last_activity"),
        F.sum("n").alias("email_count"),
        F.count("from_email").alias("participant_count"),
    )


def _content(meta: DataFrame, user_id: str | None = None) -> DataFrame:
    rows = meta.filter(F.col("dimension") == "content")
    return rows if user_id is None else rows.filter(F.col("user_id") == user_id)


def _with_activity(meta: DataFrame, activity: DataFrame) -> DataFrame:
    found = activity.select(
        "cluster_id", F.col("last_activity").alias("_last"), F.col("participant_count").alias("_people")
    )
    return meta.join(found, "cluster_id", "left")


def detect_projects(
    meta: DataFrame, activity: DataFrame, now, min_score: float = 0.4, limit: int | None = None,
    rules: ProjectRules = ProjectRules(), user_id: str | None = None,
) -> DataFrame:
    """Score content clusters, all or the ``limit`` largest, and flag projects.

    ``cluster_id, is_project, status, confidence, reason``.
    """
    largest = _content(meta, user_id)
    if limit is not None:
        largest = largest.orderBy(F.desc("size"), "cluster_id").limit(limit)
    rows = _with_activity(largest, activity)
    score, reason = S.project_score(
        F.col("size"), F.col("pct_replied"), F.col("_people"), F.col("_last"), F.col("coherence_score"), _now(now), rules
    )
    rows = rows.withColumn("confidence", score).withColumn("reason", reason)
    rows = rows.withColumn("is_project", F.col("confidence") >= min_score)
    status = F.when(F.col("is_project"), S.project_status(F.col("_last"), _now(now), rules))
    return rows.select("cluster_id", "is_project", status.alias("status"), "confidence", "reason", F.col("_last").alias("last_activity"))


def detection_summary(detected: DataFrame) -> DataFrame:
    """Clusters analysed, projects, and projects per status."""
    return detected.agg(
        F.count(F.lit(1)).alias("clusters_analyzed"),
        F.count_if("is_project").alias("projects_detected"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_projects") for s in ("active", "stale", "completed")],
    )


def apply_detection(meta: DataFrame, detected: DataFrame) -> DataFrame:
    """Write flags, status and last activity of detected projects into the metadata."""
    hits = detected.filter("is_project").select(
        F.lit("content").alias("dimension"), "cluster_id", F.col("status").alias("_status"), F.col("last_activity").alias("_last")
    )
    out = meta.join(hits, ["dimension", "cluster_id"], "left")
    return out.withColumn("is_project", F.col("is_project") | F.col("_status").isNotNull()).withColumn(
        "project_status", F.coalesce("_status", "project_status")
    ).withColumn("last_activity_at", F.coalesce("_last", "last_activity_at")).select(*meta.columns)


def refresh_project_status(
    meta: DataFrame, activity: DataFrame, now, rules: ProjectRules = ProjectRules()
) -> tuple[DataFrame, DataFrame]:
    """The metadata with statuses brought up to date, and the transition counts."""
    projects = _with_activity(_content(meta).filter("is_project"), activity)
    current = S.project_status(F.col("_last"), _now(now), rules)
    moves = projects.select("dimension", "cluster_id", F.col("project_status").alias("_was"), current.alias("_status"))
    unchanged = F.col("_was").eqNullSafe(F.col("_status"))
    counts = moves.agg(
        *[F.count_if(~unchanged & (F.col("_status") == s)).alias(f"to_{s}") for s in ("active", "stale", "completed")],
        F.count_if(unchanged).alias("unchanged"),
    )
    out = meta.join(moves.drop("_was"), ["dimension", "cluster_id"], "left")
    return out.withColumn("project_status", F.coalesce("_status", "project_status")).select(*meta.columns), counts


def cluster_stats(meta: DataFrame, dimension: str) -> DataFrame:
    """One row of counts and sizes."""
    project = F.coalesce("is_project", F.lit(False))
    return meta.filter(F.col("dimension") == dimension).agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_emails"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_cluster_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_cluster_size"),
        F.coalesce(F.min("size"), F.lit(0)).alias("smallest_cluster_size"),
        F.count("auto_label").alias("labeled_clusters"),
        F.count_if(project).alias("project_clusters"),
        F.count_if(project & (F.col("project_status") == "active")).alias("active_projects"),
    )


def project_summary(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals, and the ten latest active projects."""
    totals = cluster_stats(meta, "content").select(
        F.col("project_clusters").alias("total_projects"), "active_projects",
        F.col("total_clusters").alias("total_content_clusters"),
    )
    top = list_projects(meta, status="active", limit=10)[0].select(
        "cluster_id", F.col("auto_label").alias("label"), "size", F.col("pct_replied").alias("engagement")
    )
    return totals, top


def enrich_clusters(meta: DataFrame, activity: DataFrame) -> DataFrame:
    """Participants and last activity on the content clusters."""
    found = activity.select(
        F.lit("content").alias("dimension"), "cluster_id", F.col("participant_count").alias("_people"),
        F.col("last_activity").alias("_last"),
    )
    content = F.col("dimension") == "content"
    out = meta.join(found, ["dimension", "cluster_id"], "left")
    return (
        out.withColumn(
            "participant_count", F.when(content, F.coalesce("_people", F.lit(0))).otherwise(F.col("participant_count"))
        )
        .withColumn("last_activity_at", F.coalesce("_last", "last_activity_at"))
        .select(*meta.columns)
    )


def temporal_activity(assignments: DataFrame, messages: DataFrame, now) -> DataFrame:
    """First and last date, and trailing counts, per content cluster."""
    at, date = _now(now), F.col("date_parsed")

    def days(n: int) -> Column:
        return at - F.expr(f"INTERVAL {n} DAYS")

    return _members(assignments, messages).groupBy("cluster_id").agg(
        F.min("date_parsed").alias("first_activity"),
        F.max("date_parsed").alias("last_activity"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(date > days(7)).alias("emails_7d"),
        F.count_if(date > days(30)).alias("emails_30d"),
        F.count_if((date > days(14)) & (date <= days(7))).alias("emails_prev_7d"),
    )


def temporal_strength(activity: DataFrame, now) -> DataFrame:
    """Add ``temporal_strength, activity_velocity, activity_trend``."""
    strength, velocity, trend = S.temporal_strength(
        F.col("emails_7d"), F.col("emails_prev_7d"), F.col("last_activity"), _now(now)
    )
    return activity.withColumn("activity_velocity", velocity).withColumn("activity_trend", trend).withColumn(
        "temporal_strength", strength
    )


def _page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit), total


def list_clusters(
    meta: DataFrame, dimension: str, user_id: str | None = None, is_project: bool | None = None,
    limit: int = 100, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Page of clusters by size, and the total."""
    rows = meta.filter(F.col("dimension") == dimension)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    if is_project is not None:
        rows = rows.filter(F.col("is_project") == is_project)
    return _page(rows, [F.desc("size"), F.asc("cluster_id")], limit, offset)


def list_projects(
    meta: DataFrame, user_id: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Page of project clusters by last activity, and the total."""
    rows = _content(meta, user_id).filter("is_project")
    if status is not None:
        rows = rows.filter(F.col("project_status") == status)
    return _page(rows, [F.desc_nulls_last("last_activity_at"), F.asc("cluster_id")], limit, offset)
