"""Inbox, digest, task and project queries (operators O1-O11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.session import cut_lineage

ACTIONABLE = ("received",)


def _at(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _days_before(now, days: int) -> Column:
    return _at(now) - F.expr(f"INTERVAL {days} DAYS")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


INBOX_COLUMNS = [
    "id", "message_id", "thread_id", "subject", "from_email", "from_name", "date_parsed", "body_preview", "is_sent",
    "action", "has_attachments", "labels",
]
CONTEXT_COLUMNS = [
    "sender_email", "sender_importance", "sender_reply_rate", "thread_length", "is_business_hours", "age_hours",
    "people_score", "temporal_score", "relationship_score", "overall_priority",
]


def priority_inbox(
    messages: DataFrame, priority: DataFrame, contexts: DataFrame, tasks: DataFrame, projects: DataFrame,
    project_links: DataFrame, limit: int = 20, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """O1: one inbox page in priority order, and one row ``total, has_more``.

    The page is chosen from messages and ranks alone; contexts, task counts
    and project names are joined to the page only.
    """
    inbox = messages.filter(~F.col("is_sent"))
    ranked = inbox.select("id", "date_parsed").join(
        priority.select(F.col("email_id").alias("id"), "priority_rank", "priority_score"), "id", "left"
    )
    page = ranked.orderBy(F.asc_nulls_last("priority_rank"), F.desc("date_parsed"), "id").offset(offset).limit(limit)
    # at most ``limit`` rows, used five times below: the inbox is ranked once, wide columns are read for the page only
    page = cut_lineage(page.select("id", "priority_rank", "priority_score"))
    keys = F.broadcast(page.select("id"))
    page = inbox.select(*INBOX_COLUMNS).join(F.broadcast(page), "id")
    open_tasks = tasks.filter(F.col("status") == "pending").select(F.col("email_id").alias("id")).join(keys, "id", "left_semi")
    task_count = open_tasks.groupBy("id").agg(F.count(F.lit(1)).alias("task_count"))
    links = project_links.select(F.col("email_id").alias("id"), "project_id").join(keys, "id", "left_semi")
    names = links.join(projects.select("project_id", "name"), "project_id")
    project_name = names.groupBy("id").agg(F.min("name").alias("project_name"))
    context = contexts.select(F.col("email_id").alias("id"), *CONTEXT_COLUMNS).join(keys, "id", "left_semi")
    rows = page.join(context, "id", "left").join(task_count, "id", "left").join(project_name, "id", "left")
    rows = rows.withColumn("task_count", F.coalesce("task_count", F.lit(0))).orderBy(
        F.asc_nulls_last("priority_rank"), F.desc("date_parsed"), "id"
    )
    total = _count(inbox, "total").withColumn("has_more", F.col("total") > offset + limit)
    return rows, total


def inbox_stats(messages: DataFrame, tasks: DataFrame, priority: DataFrame, contexts: DataFrame) -> DataFrame:
    """O2: one row of inbox totals."""
    scores = priority.agg(F.struct(F.count_if(F.col("priority_score") > 0.7).alias("urgent"), F.avg("priority_score").alias("mean")))
    return messages.agg(F.count_if(~F.col("is_sent")).alias("total_emails")).select(
        "total_emails",
        tasks.agg(F.count_if(F.col("status") == "pending")).scalar().alias("pending_tasks"),
        scores.scalar()["urgent"].alias("urgent_emails"),
        contexts.agg(F.count_if(F.col("sender_importance") > 0)).scalar().alias("from_real_people"),
        scores.scalar()["mean"].alias("avg_priority_score"),
    )


def oldest_unanswered(messages: DataFrame, now, actions: tuple[str, ...] = ACTIONABLE) -> DataFrame:
    """O3: hours since the oldest actionable message of 30 days without a reply."""
    open_mail = messages.filter(
        ~F.col("is_sent") & F.col("action").isin(*actions) & (F.col("date_parsed") > _days_before(now, 30))
    ).select("message_id", "date_parsed")
    answered = messages.filter(F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id"))
    oldest = open_mail.join(answered, "message_id", "left_anti").agg(F.min("date_parsed").alias("_oldest"))
    hours = (F.unix_micros(_at(now)) - F.unix_micros("_oldest")) / 3.6e9
    return oldest.select(hours.alias("oldest_unanswered_hours"))


def digest_todos(
    messages: DataFrame, priority: DataFrame, contexts: DataFrame, now, limit: int | None = 5,
    actions: tuple[str, ...] = ACTIONABLE,
) -> DataFrame:
    """The best-ranked actionable messages of the last 7 days."""
    recent = messages.filter(
        ~F.col("is_sent") & F.col("action").isin(*actions) & (F.col("date_parsed") > _days_before(now, 7))
    ).select("id", "subject", "from_email", "from_name")
    rows = recent.join(priority.select(F.col("email_id").alias("id"), "priority_rank", "priority_score"), "id", "left")
    rows = rows.join(contexts.select(F.col("email_id").alias("id"), "age_hours"), "id", "left")
    if limit is not None:
        rows = rows.orderBy(F.asc_nulls_last("priority_rank"), "id").limit(limit)
    score, age = F.coalesce("priority_score", F.lit(0.0)), F.coalesce("age_hours", F.lit(0.0))
    subject = F.when(F.col("subject") != "", F.col("subject")).otherwise("No subject")
    title = F.concat(F.substring(subject, 1, 80), F.when(F.length(subject) > 80, "...").otherwise(""))
    who = F.coalesce(F.when(F.col("from_name") != "", F.col("from_name")), F.col("from_email"), F.lit(""))
    return rows.select(
        F.concat(F.lit("email_"), F.col("id")).alias("todo_id"),
        title.alias("title"),
        F.concat(F.lit("Email from "), who).alias("source"),
        F.when((score > 0.7) | (age > 48), "high").when(score > 0.4, "medium").otherwise("low").alias("urgency"),
        F.when(age > 72, "Overdue").when(age > 24, "Today").alias("due"),
        F.col("id").alias("email_id"),
        "priority_rank",
    )


def digest_topics(messages: DataFrame, now, limit: int = 5) -> DataFrame:
    """Latest threads with more than one message in 7 days.

    The threads are picked from counts; senders are looked up for the picked
    threads only, three per thread.
    """
    recent = messages.filter(F.col("date_parsed") > _days_before(now, 7)).select(
        "thread_id", "subject", "date_parsed", F.coalesce("from_name", "from_email").alias("participant")
    )
    picked = recent.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("email_count"), F.max("date_parsed").alias("last"),
        F.min("subject").alias("_first"), F.max("subject").alias("_last_subject"),
    ).filter(F.col("email_count") > 1).orderBy(F.desc("last"), "thread_id").limit(limit)
    # at most ``limit`` rows, used twice
    picked = cut_lineage(picked)

    people = recent.join(F.broadcast(picked.select("thread_id")), "thread_id", "left_semi").select(
        "thread_id", "participant"
    ).filter(F.col("participant").isNotNull()).distinct()
    order = Window.partitionBy("thread_id").orderBy("participant")
    people = people.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 3)
    people = people.groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_list("participant")), ", ").alias("participants"))

    empty = F.col("_first").isNull() | (F.col("_last_subject") == "")
    first = F.trim(F.split(F.when(empty, "Thread").otherwise(F.col("_first")), ",")[0])
    age = (F.unix_micros(_at(now)) - F.unix_micros("last")) / 1e6
    ago = (
        F.when(age < 3600, F.concat(F.floor(age / 60), F.lit(" minutes ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600), F.lit(" hours ago")))
        .when(age.isNotNull(), F.concat(F.floor(age / 86400), F.lit(" days ago")))
        .otherwise("Unknown")
    )
    return picked.join(people, "thread_id", "left").select(
        F.concat(F.lit("thread_"), F.col("thread_id")).alias("topic_id"),
        F.concat(F.substring(first, 1, 60), F.when(F.length(first) > 60, "...").otherwise("")).alias("title"),
        "email_count",
        F.coalesce("participants", F.lit("")).alias("participants"),
        ago.alias("last_activity"),
        F.when(F.col("email_count") > 5, "high").when(F.col("email_count") > 3, "medium").otherwise("low").alias("urgency"),
    )


def digest_counts(todos: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Urgent and total to-dos, and the summary line."""
    counts = todos.groupBy(*(by or [])).agg(
        F.count_if(F.col("urgency") == "high").alias("urgent"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn("subtitle", subtitle(F.col("urgent"), F.col("total")))


def subtitle(urgent: Column, total: Column) -> Column:
    return (
        F.when(urgent == 1, "1 urgent item needs attention")
        .when(urgent > 1, F.concat(urgent, F.lit(" urgent items need attention")))
        .when(total == 1, "1 item to review")
        .when(total > 1, F.concat(total, F.lit(" items to review")))
        .otherwise("All caught up!")
    )


def list_tasks(
    tasks: DataFrame, user_id: str | None = None, status: str | None = None, project_id: int | None = None,
    limit: int = 100, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Page of tasks by urgency then age, and the total."""
    rows = tasks
    for column, value in (("user_id", user_id), ("status", status), ("project_id", project_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    page = rows.orderBy(F.desc_nulls_last("urgency_score"), F.desc("created_at"), "task_id").offset(offset).limit(limit)
    return page, _count(rows, "total")


def task_counts(tasks: DataFrame) -> DataFrame:
    """Pending and urgent tasks per user."""
    pending = F.col("status") == "pending"
    return tasks.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(pending).alias("pending"),
        F.count_if(pending & (F.col("urgency_score") > 0.7)).alias("urgent"),
    )


def list_project_rows(
    projects: DataFrame, user_id: str | None = None, is_active: bool | None = None, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Page of projects by last activity, and the total."""
    rows = projects
    for column, value in (("user_id", user_id), ("is_active", is_active)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    page = rows.orderBy(F.desc_nulls_last("last_activity"), F.desc("created_at"), "project_id").offset(offset).limit(limit)
    return page, _count(rows, "total")


PATCHABLE = ["description", "task_type", "complexity", "deadline", "urgency_score", "status"]


def apply_task_actions(tasks: DataFrame, actions: DataFrame, patchable: list[str] | None = None) -> DataFrame:
    """Apply a change table ``task_id, verb, at, <patched columns>``.

    Verbs are complete, dismiss, delete and patch; one change per task.  A
    patch sets the columns it has a value for.
    """
    columns = [c for c in (patchable or PATCHABLE) if c in actions.columns and c in tasks.columns]
    change = actions.select(
        "task_id", F.col("verb").alias("_verb"), F.col("at").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    out = tasks.join(change, "task_id", "left").filter(~F.col("_verb").eqNullSafe("delete"))
    verb = F.col("_verb")
    for c in columns:
        out = out.withColumn(c, F.when(verb == "patch", F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)))
    done = F.when(verb == "complete", "completed").when(verb == "dismiss", "dismissed").otherwise(F.col("status"))
    out = out.withColumn("status", done)
    out = out.withColumn("completed_at", F.when(verb == "complete", F.col("_at")).otherwise(F.col("completed_at")))
    return out.select(*tasks.columns)


def action_results(tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """Per change whether its task was found."""
    known = tasks.select("task_id", F.lit(True).alias("_known"))
    found = F.coalesce("_known", F.lit(False))
    return actions.join(known, "task_id", "left").select(
        "task_id", "verb", found.alias("success"), F.when(~found, "NOT_FOUND").alias("error")
    )


def search_messages(messages: DataFrame, priority: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Received messages with the words in subject or body, in rank order."""
    needle = query.lower()
    hits = messages.filter(
        ~F.col("is_sent") & (F.lower("subject").contains(needle) | F.lower("body_text").contains(needle))
    ).select("id", "subject", "from_email", "date_parsed")
    ranked = hits.join(priority.select(F.col("email_id").alias("id"), "priority_rank"), "id", "left")
    if limit is None:
        return ranked
    return ranked.orderBy(F.asc_nulls_last("priority_rank"), F.desc("date_parsed"), "id").limit(limit)
