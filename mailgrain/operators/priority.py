"""Priority ranking (operators K1-K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.constants import MIN_SENDER_VECTORS, PRIORITY_WEIGHTS
from mailgrain.functions import scoring as S
from mailgrain.functions.vectors import cosine_distance
from mailgrain.operators.vectors import centroid, minmax, range_of, scaled
from mailgrain.session import cut_lineage, loose

COMPONENTS = ["replied_similarity", "cluster_novelty", "sender_novelty"]


def feature_score(messages: DataFrame, features: DataFrame) -> DataFrame:
    """K1: ``email_id, feature_score`` of received messages with features."""
    received = messages.filter(~F.col("is_sent")).select(F.col("id").alias("email_id"))
    score = S.feature_score(
        F.col("relationship_strength"), F.col("urgency_score"), F.col("is_service_email"), F.col("service_importance")
    )
    return features.join(received, "email_id").select("email_id", score.alias("feature_score"))


#: centroids of senders are broadcast up to so many numbers (64 MB of doubles), and joined by a split shuffle beyond
BROADCAST_NUMBERS = 8_000_000


def placed_vectors(vectors: DataFrame, messages: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Checkpointed ``email_id, embedding, action, from_email, is_sent, content_cluster_id``.

    The narrow attributes meet the vectors once; every centroid and distance is then computed on this table.
    """
    mail = messages.select(F.col("id").alias("email_id"), "action", "from_email", "is_sent")
    if assignments is None:
        mail = mail.withColumn("content_cluster_id", F.lit(None).cast("int")).withColumn("_assigned", F.lit(False))
    else:
        own = assignments.select("email_id", "content_cluster_id", F.lit(True).alias("_assigned"))
        mail = mail.join(own, "email_id", "full")
    return cut_lineage(vectors.select("email_id", "embedding").join(mail, "email_id", "left"))


def _replied_raw(placed: DataFrame) -> DataFrame:
    target = centroid(placed.filter(F.col("action") == "REPLIED")).select("centroid").scalar()
    return placed.withColumn("_target", target).select(
        "email_id", (1 - cosine_distance("embedding", "_target")).alias("replied_similarity")
    )


def replied_similarity(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """K2: scaled cosine to the centroid of answered messages; no rows if none was answered."""
    return minmax(_replied_raw(placed_vectors(vectors, messages)), "replied_similarity", costly=True)


def _with_centroids(rows: DataFrame, centers: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``centroid`` by ``key``, so that a key with many vectors holds up no task.

    Centroids are counted first: while they are small they are broadcast and no vector moves; beyond, they are dealt
    out apart from their aggregation and adaptive execution splits hot keys.
    """
    centers = cut_lineage(centers)
    size = centers.agg(F.sum(F.size("centroid"))).first()[0] or 0
    return rows.join(F.broadcast(centers) if size <= BROADCAST_NUMBERS else loose(centers), key, "left")


def _cluster_raw(placed: DataFrame) -> DataFrame:
    rows = placed.filter("_assigned")
    real = F.col("content_cluster_id").isNotNull() & (F.col("content_cluster_id") != -1)
    centers = centroid(rows.filter(real), ["content_cluster_id"]).drop("n")
    novelty = (
        F.when(F.col("content_cluster_id") == -1, 1.0).when(F.col("centroid").isNull(), 0.5)
        .otherwise(cosine_distance("embedding", "centroid"))
    )
    return _with_centroids(rows, centers, "content_cluster_id").select("email_id", novelty.alias("cluster_novelty"))


def cluster_novelty(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """K3: scaled distance to the own content cluster; noise is 1, no centroid 0.5."""
    own = assignments.select("email_id", "content_cluster_id", F.lit(True).alias("_assigned"))
    placed = cut_lineage(vectors.select("email_id", "embedding").join(own, "email_id"))
    return minmax(_cluster_raw(placed), "cluster_novelty", costly=True)


def _sender_raw(placed: DataFrame) -> DataFrame:
    rows = placed.filter(~F.col("is_sent"))
    centers = centroid(rows, ["from_email"]).filter(F.col("n") >= MIN_SENDER_VECTORS).drop("n")
    novelty = F.when(F.col("centroid").isNull(), 0.5).otherwise(cosine_distance("embedding", "centroid"))
    return _with_centroids(rows, centers, "from_email").select("email_id", novelty.alias("sender_novelty"))


def sender_novelty(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """K4: scaled distance to the sender's centroid; 0.5 below three vectors."""
    return minmax(_sender_raw(placed_vectors(vectors, messages)), "sender_novelty", costly=True)


def _blend() -> Column:
    total = F.lit(0.0)
    for name, weight in PRIORITY_WEIGHTS.items():
        total = total + F.col(name) * weight
    return total


def combine_priority(
    feature_scores: DataFrame, similarity: DataFrame, cluster: DataFrame, sender: DataFrame
) -> DataFrame:
    """K5: weighted blend; a missing component counts 0.5."""
    out = feature_scores
    for part in (similarity, cluster, sender):
        out = out.join(part, "email_id", "left")
    out = out.select("email_id", *[F.coalesce(c, F.lit(0.5)).alias(c) for c in PRIORITY_WEIGHTS])
    return out.withColumn("priority_score", _blend())


def llm_flags(priorities: DataFrame, messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """K6: add ``needs_llm_analysis`` and ``llm_reason``."""
    received = messages.filter(~F.col("is_sent")).select(F.col("id").alias("email_id"), F.col("action").alias("_action"))
    clusters = assignments.select("email_id", F.col("content_cluster_id").alias("_cluster"))
    out = priorities.join(received, "email_id", "left").join(clusters, "email_id", "left")
    return _flagged(out, F.col("_action"), F.col("_cluster")).drop("_action", "_cluster")


def _flagged(df: DataFrame, action: Column, cluster: Column) -> DataFrame:
    score = F.col("priority_score")
    reason = (
        F.when(score >= 0.7, "high_priority").when(action == "REPLIED", "replied_training")
        .when((score >= 0.5) & (action == "IGNORED"), "high_priority_ignored")
        .when((cluster == -1) & (score >= 0.4), "novel_content")
    )
    return df.withColumn("llm_reason", reason).withColumn("needs_llm_analysis", F.col("llm_reason").isNotNull())


def rank_globally(df: DataFrame, order_by: list[Column], rank: str) -> DataFrame:
    """Number all rows 1..n in a total order without a single-task window.

    The rows are range-partitioned and sorted, and the position inside the
    partition is fixed by a reliable checkpoint.  The offsets are one row per
    partition (their number is the shuffle partition setting), so they are
    small whatever the data and are broadcast.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # partition in the upper 31 bits, position in the lower 33
    ordered = cut_lineage(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    partition = F.shiftrightunsigned("_slot", 33)
    sizes = ordered.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    position = F.col("_slot").bitwiseAND((1 << 33) - 1)
    return (
        ordered.withColumn("_part", partition).join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_offset") + position + 1).select(*df.columns, rank)
    )


def priority_rank(priorities: DataFrame) -> DataFrame:
    """K7: ``priority_rank`` 1..n by falling score, then by id."""
    return rank_globally(priorities, [F.desc("priority_score"), F.asc("email_id")], "priority_rank")


def score_messages(
    messages: DataFrame, features: DataFrame, vectors: DataFrame, assignments: DataFrame
) -> DataFrame:
    """K1-K6 in one frame.

    The vectors are scanned once, with their attributes, into a checkpointed table, and the three components become
    columns of its rows where centroids are small; the narrow result is checkpointed too, as its ranges and its rows
    are both needed.
    """
    placed = placed_vectors(vectors, messages, assignments)
    real = F.col("content_cluster_id").isNotNull() & (F.col("content_cluster_id") != -1)
    target = centroid(placed.filter(F.col("action") == "REPLIED")).select("centroid").scalar()
    clusters = centroid(placed.filter(F.col("_assigned") & real), ["content_cluster_id"]).drop("n")
    senders = centroid(placed.filter(~F.col("is_sent")), ["from_email"]).filter(F.col("n") >= MIN_SENDER_VECTORS).drop("n")
    rows = placed.withColumn("_target", target).withColumn(
        "replied_similarity", 1 - cosine_distance("embedding", "_target")).drop("_target")
    rows = _with_centroids(rows, clusters, "content_cluster_id").withColumn(
        "cluster_novelty",
        F.when(F.col("_assigned"), F.when(F.col("content_cluster_id") == -1, 1.0).when(F.col("centroid").isNull(), 0.5)
               .otherwise(cosine_distance("embedding", "centroid"))),
    ).drop("centroid")
    raw = _with_centroids(rows, senders, "from_email").select(
        "email_id", "replied_similarity", "cluster_novelty",
        F.when(~F.col("is_sent"), F.when(F.col("centroid").isNull(), 0.5).otherwise(cosine_distance("embedding", "centroid")))
        .alias("sender_novelty"),
    )
    raw = cut_lineage(raw)
    parts = raw.withColumn("_b", range_of(raw, COMPONENTS)).select("email_id", *[scaled(c, F.col("_b")).alias(c) for c in COMPONENTS])
    blended = feature_score(messages, features).join(parts, "email_id", "left").select(
        "email_id", *[F.coalesce(c, F.lit(0.5)).alias(c) for c in PRIORITY_WEIGHTS]
    ).withColumn("priority_score", _blend())
    return llm_flags(blended, messages, assignments)


def rank_messages(
    messages: DataFrame, features: DataFrame, vectors: DataFrame, assignments: DataFrame
) -> DataFrame:
    """K8: the priority table, K1 to K7."""
    return priority_rank(score_messages(messages, features, vectors, assignments))
