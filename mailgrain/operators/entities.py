"""Tasks, projects and priority contexts (operators M1-M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgrain.constants import TASK_TYPES_BY_ACTION, URGENCY_SCORES
from mailgrain.functions import scoring as S
from mailgrain.operators.tables import upsert, upsert_counts


def _mapped(c: Column, values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for key, value in values.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def with_sender(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Messages with the profile of their sender and ``is_real_person`` (M2)."""
    people = contacts.select(
        F.col("email").alias("from_email"), F.col("name").alias("sender_name"), "reply_rate", "is_important_sender",
        "emails_from",
    )
    return messages.join(people, "from_email", "left").withColumn(
        "is_real_person",
        S.is_real_person("from_email", F.col("reply_rate"), F.col("is_important_sender"), F.col("emails_from")),
    )


def not_marketing(messages: DataFrame) -> DataFrame:
    """M1: messages whose sender matches no marketing pattern."""
    return messages.filter(~S.is_marketing("from_email"))


def _described(text: Column) -> Column:
    named = F.col("sender_name").isNotNull() & (F.col("sender_name") != "") & (F.col("sender_name") != F.col("from_email"))
    full = F.when(named, F.concat(F.lit("["), F.col("sender_name"), F.lit("] "), text)).otherwise(text)
    return _cut(full, 1000)


def _cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def _filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _boosted(score: Column) -> Column:
    return F.when(F.col("reply_rate") > 0.5, F.least(F.lit(1.0), score + 0.1)).otherwise(score)


TASK_TABLE = (
    "task_id string, email_id bigint, description string, task_type string, urgency_score double, extraction_method string, "
    "status string, assigned_by string, user_id string, project_id bigint, complexity string, deadline timestamp, "
    "created_at timestamp, completed_at timestamp"
)
TASK_UPDATES = ["description", "urgency_score", "task_type", "extraction_method", "assigned_by"]


def _model_candidates(labels: DataFrame, messages: DataFrame, contacts: DataFrame) -> DataFrame:
    wanted = labels.filter(F.col("action_type").isin(list(TASK_TYPES_BY_ACTION))).select(
        "email_id", "action_type", "urgency", "one_liner"
    )
    mail = messages.select(F.col("id").alias("email_id"), "subject", "from_email")
    return with_sender(wanted.join(mail, "email_id"), contacts)


def tasks_from_model(labels: DataFrame, messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """M3: tasks from model labels, real people only."""
    rows = _model_candidates(labels, messages, contacts).filter("is_real_person")
    urgency = _mapped(F.coalesce("urgency", F.lit("none")), URGENCY_SCORES, 0.1)
    return rows.select(
        F.format_string("llm_%d_%s", "email_id", "action_type").alias("task_id"),
        "email_id",
        _described(F.coalesce(_filled("one_liner"), _filled("subject"), F.lit("Task from email"))).alias("description"),
        _mapped(F.col("action_type"), TASK_TYPES_BY_ACTION, "other").alias("task_type"),
        _boosted(urgency).alias("urgency_score"),
        F.lit("llm_real_person").alias("extraction_method"),
        F.lit("pending").alias("status"),
        F.col("from_email").alias("assigned_by"),
    )


def _signal_candidates(classes: DataFrame, messages: DataFrame, contacts: DataFrame, tasks: DataFrame) -> DataFrame:
    signals = classes.filter("has_request OR has_deadline OR has_approval").select(
        "email_id", "has_request", "has_deadline", "has_approval"
    )
    fresh = signals.join(tasks.select("email_id"), "email_id", "left_anti")
    mail = messages.select(F.col("id").alias("email_id"), "subject", "from_email")
    return with_sender(fresh.join(mail, "email_id"), contacts)


def tasks_from_signals(classes: DataFrame, messages: DataFrame, contacts: DataFrame, tasks: DataFrame) -> DataFrame:
    """M4: tasks from rule flags of messages that have no task yet, real people only."""
    rows = _signal_candidates(classes, messages, contacts, tasks).filter("is_real_person")
    base = F.when(F.col("has_deadline"), 0.7).when(F.col("has_approval"), 0.6).otherwise(0.4)
    kind = F.when(F.col("has_approval"), "decision").when(F.col("has_request"), "follow_up").otherwise("other")
    return rows.select(
        F.format_string("ai_%d", "email_id").alias("task_id"),
        "email_id",
        _described(F.coalesce(_filled("subject"), F.lit("Task detected from email"))).alias("description"),
        kind.alias("task_type"),
        _boosted(base).alias("urgency_score"),
        F.lit("ai_real_person").alias("extraction_method"),
        F.lit("pending").alias("status"),
        F.col("from_email").alias("assigned_by"),
    )


PROJECT_TABLE = (
    "project_id bigint, name string, project_type string, owner_email string, email_count bigint, last_activity timestamp, "
    "cluster_id int, detected_from string, confidence double, user_id string, is_active boolean, priority int, created_at timestamp"
)
PROJECT_KEY = ["detected_from", "owner_email", "cluster_id"]
PROJECT_UPDATES = ["name", "email_count", "last_activity", "confidence"]


def projects_from_people(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """M5: one project per answered contact with two or more received messages.

    Only the smallest subject is used in the name, so no subject list is built.
    """
    people = contacts.filter((F.col("reply_rate") > 0) & ~F.col("is_you")).select(
        F.col("email").alias("from_email"), "name", "reply_rate", "is_important_sender"
    )
    received = messages.filter(~F.col("is_sent")).groupBy("from_email").agg(
        F.count(F.lit(1)).alias("email_count"),
        F.max("date_parsed").alias("last_activity"),
        F.min(F.substring("subject", 1, 100)).alias("_subject"),
    )
    rows = received.filter(F.col("email_count") >= 2).join(people, "from_email")
    known = F.col("name").isNotNull() & (F.col("name") != "") & (F.col("name") != F.col("from_email"))
    who = F.when(known, F.col("name")).otherwise(F.split("from_email", "@", 2)[0])
    topic = F.substring("_subject", 1, 50)
    fresh = (F.length("_subject") > 5) & ~topic.contains("Re:") & ~topic.contains("Fwd:")
    name = F.concat(F.lit("Conversation: "), who, F.when(fresh, F.concat(F.lit(" - "), topic)).otherwise(""))
    engaged = F.col("reply_rate") > 0.5
    return rows.select(
        _cut(name, 200).alias("name"),
        F.when(F.col("is_important_sender"), "key_relationship").when(engaged, "active_conversation")
        .otherwise("conversation").alias("project_type"),
        F.col("from_email").alias("owner_email"),
        "email_count",
        "last_activity",
        F.lit(None).cast("int").alias("cluster_id"),
        F.lit("real_person_thread").alias("detected_from"),
        F.when(F.col("is_important_sender"), 0.95).when(engaged, 0.9).otherwise(0.7).alias("confidence"),
    )


def _cluster_candidates(
    meta: DataFrame, assignments: DataFrame, messages: DataFrame, contacts: DataFrame, projects: DataFrame
) -> DataFrame:
    clusters = meta.filter((F.col("dimension") == "content") & (F.col("size") >= 3)).select(
        "cluster_id", "size", "auto_label", "last_activity_at"
    )
    placed = assignments.select("email_id", F.col("content_cluster_id").alias("cluster_id"))
    mail = messages.select(F.col("id").alias("email_id"), "from_email", "subject")
    # per (cluster, sender) first: whether a person and whether already
    # covered are properties of the sender
    by_sender = placed.join(mail, "email_id").groupBy("cluster_id", "from_email").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.substring("subject", 1, 60)).alias("subject")
    )
    covered = projects.filter(F.col("detected_from") == "real_person_thread").select(
        F.col("owner_email").alias("from_email"), F.lit(True).alias("_covered")
    ).distinct()
    by_sender = with_sender(by_sender, contacts).join(covered, "from_email", "left")
    rolled = by_sender.groupBy("cluster_id").agg(
        F.sum("n").alias("email_count"),
        F.sum(F.when(F.col("is_real_person"), F.col("n")).otherwise(0)).alias("people"),
        F.min("subject").alias("subject"),
        F.coalesce(F.bool_or("_covered"), F.lit(False)).alias("covered"),
    )
    return clusters.join(rolled.filter(F.col("people") > 0), "cluster_id").withColumn(
        "ratio", F.col("people") / F.col("email_count")
    )


def projects_from_clusters(
    meta: DataFrame, assignments: DataFrame, messages: DataFrame, contacts: DataFrame, projects: DataFrame
) -> DataFrame:
    """M6: projects from content clusters of three or more, at least half from
    real people and none of their senders covered by M5."""
    rows = _cluster_candidates(meta, assignments, messages, contacts, projects)
    rows = rows.filter((F.col("ratio") >= 0.5) & ~F.col("covered"))
    name = F.coalesce(_filled("auto_label"), _filled("subject"), F.concat(F.lit("Topic Cluster "), F.col("cluster_id")))
    return rows.select(
        _cut(name, 200).alias("name"),
        F.lit("topic_cluster").alias("project_type"),
        F.lit(None).cast("string").alias("owner_email"),
        "email_count",
        F.col("last_activity_at").alias("last_activity"),
        F.col("cluster_id").cast("int").alias("cluster_id"),
        F.lit("content_cluster_real").alias("detected_from"),
        F.least(F.lit(0.9), 0.5 + F.col("ratio") * 0.4).alias("confidence"),
    )


def priority_contexts(
    priority: DataFrame, messages: DataFrame, contacts: DataFrame, threads: DataFrame, now
) -> DataFrame:
    """M7: why each ranked message has its priority."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    mail = messages.select(F.col("id").alias("email_id"), "from_email", "thread_id", "date_parsed")
    rows = with_sender(priority.select("email_id", "sender_novelty", "priority_score").join(mail, "email_id"), contacts)
    rows = rows.join(threads.select("thread_id", F.col("email_count").alias("thread_length")), "thread_id", "left")
    person, rate = F.col("is_real_person"), F.coalesce("reply_rate", F.lit(0.0))
    age = (F.unix_micros(at) - F.unix_micros("date_parsed")) / 3.6e9
    hour = F.hour("date_parsed")
    # a score of exactly 0 counts as missing
    score = F.when(F.col("priority_score") != 0, F.col("priority_score")).otherwise(0.5)
    novelty = F.when(F.col("sender_novelty") != 0, F.col("sender_novelty")).otherwise(0.5)
    return rows.select(
        "email_id",
        F.col("from_email").alias("sender_email"),
        F.coalesce("emails_from", F.lit(0)).cast("double").alias("sender_frequency"),
        F.when(person, 1.0).otherwise(0.0).alias("sender_importance"),
        F.when(rate != 0, rate).alias("sender_reply_rate"),
        "thread_id",
        "thread_length",
        F.col("date_parsed").alias("email_timestamp"),
        (hour.between(9, 17) & (F.weekday("date_parsed") < 5)).alias("is_business_hours"),
        age.alias("age_hours"),
        F.when(
            person,
            0.5 + F.when(F.col("is_important_sender"), 0.3).otherwise(0.0) + F.when(rate > 0.5, 0.2).otherwise(0.0),
        ).otherwise(0.1).alias("people_score"),
        F.when(age < 24, 0.8).when(age < 72, 0.5).when(age.isNotNull(), 0.2).otherwise(0.0).alias("temporal_score"),
        F.when(person, 0.5 + F.least(F.lit(0.5), rate)).otherwise(1.0 - novelty).alias("relationship_score"),
        F.when(person, F.least(F.lit(1.0), score * 1.5)).otherwise(score * 0.5).alias("overall_priority"),
    )


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of a DDL schema, null where it has none."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def merge_tasks(existing: DataFrame, found: DataFrame, now, user_id: str | None = None) -> DataFrame:
    """The task table after an extraction, keyed by ``task_id``.

    A task that is there already takes new text, type and urgency; its status, dates and the user's own columns stay.
    New tasks get ``user_id`` and ``created_at``.
    """
    fresh = conform(found.withColumns({"user_id": F.lit(user_id), "created_at": _at(now)}), TASK_TABLE)
    merged = upsert(conform(existing, TASK_TABLE), fresh, ["task_id"], TASK_UPDATES)
    return merged.withColumn("status", F.coalesce("status", F.lit("pending")))


def merge_projects(existing: DataFrame, found: DataFrame, now, user_id: str | None = None) -> DataFrame:
    """The project table after an extraction, keyed by how and for whom a project was detected.

    Projects of contacts also take a new type; identity, activity flag and priority of known projects stay.
    """
    key = F.xxhash64("detected_from", F.coalesce("owner_email", F.lit("")), F.coalesce("cluster_id", F.lit(-1)))
    fresh = conform(found.withColumns({
        "project_id": key.bitwiseAND((1 << 62) - 1), "user_id": F.lit(user_id), "is_active": F.lit(True), "created_at": _at(now),
    }), PROJECT_TABLE)
    known = conform(existing, PROJECT_TABLE)
    merged = upsert(known, fresh, PROJECT_KEY, PROJECT_UPDATES)
    kinds = fresh.filter(F.col("detected_from") == "real_person_thread").select(*PROJECT_KEY, F.col("project_type").alias("_type"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"k.{k}")) for k in PROJECT_KEY]
    joined = merged.alias("m").join(kinds.alias("k"), same, "left")
    return joined.select(*[
        F.coalesce("k._type", "m.project_type").alias(c) if c == "project_type" else F.col(f"m.{c}") for c in merged.columns
    ])


def merge_contexts(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The context table after an extraction, keyed by ``email_id``; matched rows are replaced."""
    known = existing.select(*[(F.col(f.name) if f.name in existing.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema.fields])
    return upsert(known, found, ["email_id"])


def _at(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def extract_entities(
    labels: DataFrame, classes: DataFrame, messages: DataFrame, contacts: DataFrame, meta: DataFrame,
    assignments: DataFrame, priority: DataFrame, threads: DataFrame, existing_tasks: DataFrame,
    existing_projects: DataFrame, existing_contexts: DataFrame, now, user_id: str | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """M8: tables ``tasks, projects, contexts`` merged with the existing ones, and one row of counts.

    The counts say how many rows were created, updated and filtered.
    """
    from_model = tasks_from_model(labels, messages, contacts)
    known_tasks = existing_tasks.select("email_id").unionByName(from_model.select("email_id"))
    from_signals = tasks_from_signals(classes, messages, contacts, known_tasks)
    people = projects_from_people(messages, contacts)
    known_projects = existing_projects.select("owner_email", "detected_from").unionByName(
        people.select("owner_email", "detected_from")
    )
    topics = projects_from_clusters(meta, assignments, messages, contacts, known_projects)
    contexts = priority_contexts(priority, messages, contacts, threads, now)

    tasks = from_model.unionByName(from_signals)
    projects = people.unionByName(topics)
    task_counts = upsert_counts(existing_tasks, tasks, ["task_id"])
    project_counts = upsert_counts(existing_projects, projects, PROJECT_KEY)
    context_counts = upsert_counts(existing_contexts, contexts, ["email_id"])
    dropped_tasks = (
        _model_candidates(labels, messages, contacts).select("is_real_person")
        .unionByName(_signal_candidates(classes, messages, contacts, known_tasks).select("is_real_person"))
        .agg(F.count_if(~F.col("is_real_person")))
    )
    candidates = _cluster_candidates(meta, assignments, messages, contacts, known_projects)
    dropped_projects = candidates.agg(F.count_if((F.col("ratio") < 0.5) | F.col("covered")))
    counts = task_counts.select(
        F.col("created").alias("tasks_created"),
        F.col("updated").alias("tasks_updated"),
        project_counts.select("created").scalar().alias("projects_created"),
        project_counts.select("updated").scalar().alias("projects_updated"),
        context_counts.select("created").scalar().alias("priority_contexts_created"),
        context_counts.select("updated").scalar().alias("priority_contexts_updated"),
        dropped_tasks.scalar().alias("tasks_filtered_marketing"),
        dropped_projects.scalar().alias("projects_filtered_marketing"),
    )
    merged = {
        "tasks": merge_tasks(existing_tasks, tasks, now, user_id),
        "projects": merge_projects(existing_projects, projects, now, user_id),
        "contexts": merge_contexts(existing_contexts, contexts),
    }
    return merged, counts
