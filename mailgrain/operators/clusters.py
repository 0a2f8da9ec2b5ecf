"""Clustering in five dimensions and what is known per cluster (operators J1-J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.constants import (
    ACTION_CODES, DIMENSIONS, MAX_CLUSTERS, NO_RESPONSE_HOURS, SERVICE_TYPE_CODES, TIMING_CODES,
)
from mailgrain.operators import density, lloyd
from mailgrain.session import cut_lineage


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False)).cast("double")


def _code(c: Column, codes: dict[str, int], default: int) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for value, code in codes.items():
        out = out.when(c == value, F.lit(code))
    return out.otherwise(F.lit(default)).cast("double")


def _received(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("is_sent")).select(F.col("id").alias("email_id"))


def people_matrix(features: DataFrame, messages: DataFrame) -> DataFrame:
    """J1."""
    return features.join(_received(messages), "email_id").select(
        "email_id",
        F.coalesce("relationship_strength", F.lit(0.0)).alias("relationship_strength"),
        F.coalesce("user_replied_to_sender_rate", F.lit(0.0)).alias("reply_rate"),
        F.coalesce("avg_response_time_hours", F.lit(NO_RESPONSE_HOURS)).alias("avg_response_hours"),
        F.coalesce("emails_from_sender_all", F.lit(1)).cast("double").alias("emails_from_sender"),
        F.coalesce("sender_replies_to_you_rate", F.lit(0.0)).alias("sender_reply_rate"),
        _flag("is_service_email").alias("is_service"),
    )


def behavior_matrix(messages: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Action, response hours and timing as numbers.

    The timing codes are keyed by lower-case names while stored timings are
    upper case, so by default every timing falls into the rest;
    ``case_sensitive=False`` tells them apart.
    """
    timing = F.col("timing") if case_sensitive else F.lower("timing")
    return messages.filter(~F.col("is_sent")).select(
        F.col("id").alias("email_id"),
        _code(F.col("action"), ACTION_CODES, 5).alias("action_code"),
        F.coalesce(F.col("response_time_seconds") / 3600.0, F.lit(NO_RESPONSE_HOURS)).alias("response_hours"),
        _code(timing, TIMING_CODES, 5).alias("timing_code"),
    )


def service_matrix(features: DataFrame, messages: DataFrame) -> DataFrame:
    """J3."""
    return features.join(_received(messages), "email_id").select(
        "email_id",
        _flag("is_service_email").alias("is_service"),
        F.coalesce("service_importance", F.lit(0.5)).alias("service_importance"),
        _flag("has_unsubscribe_link").alias("has_unsub"),
        _flag("from_common_service_domain").alias("common_domain"),
        _code(F.col("service_type"), SERVICE_TYPE_CODES, 0).alias("service_type_code"),
    )


def temporal_matrix(features: DataFrame, messages: DataFrame) -> DataFrame:
    """J4."""
    return features.join(_received(messages), "email_id").select(
        "email_id",
        F.col("hour_of_day").cast("double").alias("hour_of_day"),
        F.col("day_of_week").cast("double").alias("day_of_week"),
        _flag("is_business_hours").alias("is_business"),
        _flag("is_weekend").alias("is_weekend"),
    )


def standardised(matrices: dict[str, DataFrame]) -> DataFrame:
    """``email_id`` and, for every name, an array column of the matrix's values with mean 0 and deviation 1.

    A column without any spread is 0.  Messages that a matrix lacks have a null array.
    """
    joined = None
    for name, matrix in matrices.items():
        values = matrix.select("email_id", F.struct(*[c for c in matrix.columns if c != "email_id"]).alias(name))
        joined = values if joined is None else joined.join(values, "email_id", "full_outer")
    joined = cut_lineage(joined)
    columns = {name: [c for c in matrix.columns if c != "email_id"] for name, matrix in matrices.items()}
    moments = joined.agg(*[
        f(f"{name}.{c}").alias(f"{kind}_{name}_{c}") for name, own in columns.items() for c in own
        for kind, f in (("mean", F.avg), ("spread", F.stddev))]).first()

    def scaled(name: str, c: str) -> Column:
        mean, spread = moments[f"mean_{name}_{c}"], moments[f"spread_{name}_{c}"]
        return (F.col(f"{name}.{c}") - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)

    return joined.select("email_id", *[
        F.when(F.col(name).isNotNull(), F.array(*[scaled(name, c) for c in own])).alias(name) for name, own in columns.items()])


def cluster_all(matrices: dict[str, DataFrame], seed: int = 42, restarts: int = 10) -> DataFrame:
    """J5 of several dimensions at once: ``email_id``, ``<name>_cluster`` and ``<name>_distance`` to the own centre.

    Equal rows of a matrix are one weighted point, so hours, flags and codes shrink to the values that occur.  All
    dimensions and restarts share each reading of the points.
    """
    rows = standardised(matrices)
    names = list(matrices)
    points = rows.select(F.posexplode(F.array(*names)).alias("space", "point")).filter(F.col("point").isNotNull())
    points = cut_lineage(points.groupBy("space", "point").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    # never more clusters than messages
    sizes = {r["space"]: int(r["n"]) for r in points.groupBy("space").agg(F.sum("weight").alias("n")).collect()}
    wanted = {i: min(MAX_CLUSTERS[name], sizes[i]) for i, name in enumerate(names) if i in sizes}
    if not wanted:
        raise ValueError("nothing to cluster")
    fits = lloyd.fit_spaces(points, wanted, seed, restarts)
    return lloyd.assign(rows, "email_id", {names[i]: (names[i], fit) for i, fit in fits.items()})


def _one(assigned: DataFrame, name: str) -> DataFrame:
    return assigned.filter(F.col(f"{name}_cluster").isNotNull()).select(
        "email_id", F.col(f"{name}_cluster").alias("cluster"), F.col(f"{name}_distance").alias("distance"))


def cluster(matrix: DataFrame, dimension: str, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Standardised k-means over all columns but ``email_id``: ``email_id, cluster, distance``."""
    return _one(cluster_all({dimension: matrix}, seed, restarts), dimension)


def cluster_content(vectors: DataFrame, seed: int = 42, restarts: int = 10) -> DataFrame:
    """K-means on the vectors as they are."""
    rows = cut_lineage(vectors.select("email_id", F.col("embedding").cast("array<double>").alias("content")))
    points = rows.filter(F.col("content").isNotNull()).select(F.lit(0).alias("space"), F.col("content").alias("point"), F.lit(1.0).alias("weight"))
    k = points.limit(MAX_CLUSTERS["content"]).count()
    if k == 0:
        raise ValueError("nothing to cluster")
    return _one(lloyd.assign(rows, "email_id", {"content": ("content", lloyd.fit_spaces(points, {0: k}, seed, restarts)[0])}), "content")


def cluster_count(assigned: DataFrame) -> DataFrame:
    """Number of clusters, noise (-1) not counted."""
    return assigned.filter(F.col("cluster") != -1).select("cluster").distinct().agg(F.count(F.lit(1)).alias("n_clusters"))


def membership(assigned: DataFrame) -> DataFrame:
    """1 - distance / largest distance, 1 when all distances are 0."""
    largest = assigned.agg(F.max("distance")).scalar()
    return assigned.withColumn("_max", largest).withColumn(
        "prob", F.when(F.col("_max") > 0, 1 - F.col("distance") / F.col("_max")).otherwise(1.0)
    ).drop("_max")


def cluster_assignments(
    people: DataFrame, content: DataFrame, behavior: DataFrame, service: DataFrame, temporal: DataFrame
) -> DataFrame:
    """Five labels and two membership degrees per message of the people set.

    Each input has ``email_id`` and ``cluster``; people and content also ``prob``.
    """
    out = people.select(
        "email_id", F.col("cluster").alias("people_cluster_id"), F.col("prob").alias("people_cluster_prob")
    ).join(
        content.select(
            "email_id", F.col("cluster").alias("content_cluster_id"), F.col("prob").alias("content_cluster_prob")
        ),
        "email_id", "left",
    )
    for name, part in (("behavior", behavior), ("service", service), ("temporal", temporal)):
        out = out.join(part.select("email_id", F.col("cluster").alias(f"{name}_cluster_id")), "email_id", "left")
    return out.select(
        "email_id", *[f"{d}_cluster_id" for d in DIMENSIONS], "people_cluster_prob", "content_cluster_prob"
    )


def assign_clusters(
    messages: DataFrame, features: DataFrame, vectors: DataFrame, seed: int = 42, restarts: int = 10, content: str = "kmeans",
) -> DataFrame:
    """J1-J8 end to end; ``content`` is ``"kmeans"`` or ``"density"``, which leaves noise in cluster -1."""
    if content not in ("kmeans", "density"):
        raise ValueError(f"unknown content clustering {content!r}")
    found = cluster_all({
        "people": people_matrix(features, messages), "behavior": behavior_matrix(messages),
        "service": service_matrix(features, messages), "temporal": temporal_matrix(features, messages),
    }, seed, restarts)
    people = membership(_one(found, "people"))
    if vectors.isEmpty():
        topics = people.select("email_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("prob"))
    elif content == "density":
        topics = density.density_clusters(vectors, seed=seed)
    else:
        topics = membership(cluster_content(vectors, seed, restarts))
    return cluster_assignments(people, topics, _one(found, "behavior"), _one(found, "service"), _one(found, "temporal"))


METADATA_DEFAULTS = {
    "auto_label": "string", "is_project": "boolean", "project_status": "string", "coherence_score": "double",
    "participant_count": "bigint", "last_activity_at": "timestamp", "user_id": "string",
}


def cluster_rollup(assignments: DataFrame, messages: DataFrame, features: DataFrame) -> DataFrame:
    """Size and averages of every cluster in all five dimensions.

    Message and feature values are attached once per message; the five labels
    are unpivoted after that, and each (dimension, cluster) is summed map-side.
    The smallest member id represents the cluster.
    """
    values = assignments.join(
        messages.select(
            F.col("id").alias("email_id"), (F.col("action") == "REPLIED").alias("_replied"),
            F.coalesce(F.col("response_time_seconds") / 3600.0, F.lit(0.0)).alias("_hours"),
        ),
        "email_id",
    ).join(features.select("email_id", "relationship_strength"), "email_id", "left")
    stacked = ", ".join(f"'{d}', {d}_cluster_id" for d in DIMENSIONS)
    members = values.selectExpr(
        "email_id", "_replied", "_hours", "relationship_strength",
        f"stack({len(DIMENSIONS)}, {stacked}) AS (dimension, cluster_id)",
    ).filter(F.col("cluster_id").isNotNull())
    return members.groupBy("dimension", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.round(F.avg(F.coalesce("_replied", F.lit(False)).cast("int")) * 100, 1).alias("pct_replied"),
        F.round(F.avg("_hours"), 1).alias("avg_response_time_hours"),
        F.round(F.avg(F.coalesce("relationship_strength", F.lit(0.0))), 3).alias("avg_relationship_strength"),
        F.min("email_id").alias("representative_email_id"),
    )


def cluster_metadata(rollup: DataFrame) -> DataFrame:
    """The roll-up as a metadata table: label and project columns still empty."""
    out = rollup
    for name, kind in METADATA_DEFAULTS.items():
        default = F.lit(False) if name == "is_project" else F.lit(None)
        out = out.withColumn(name, default.cast(kind))
    return out
