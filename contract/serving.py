"""Queries for labelling, entities, serving, event log, streaming and whole runs (L, M, O-R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapter import NOW_S, YOU, driver_table, now, present, table
from contract.analysis import FEATURE_TYPES, feature_rows, sender_sql
from contract.registry import query
from mailgrain import constants as K
from mailgrain.operators import entities, eventlog, labeling, serving, textindex, threads
from mailgrain.operators.features import message_features
from mailgrain.plans.mailbox import MailboxRun, refresh_after_batch
from mailgrain.schemas import MESSAGE
from mailgrain.session import shared_folder
from mailgrain.streaming import ingest, notifications

# ------------------------------------------------------------------ labelling

QUEUE = """
    queue AS (SELECT l.id AS email_id, l.from_email, l.subject, l.date_s, substring(l.body_text, 1, 800) AS body_preview, f.relationship_strength,
      f.user_replied_to_sender_rate, f.is_service_email, c.llm_priority, coalesce(u.is_important_sender, false) AS is_important_sender,
      coalesce(p.priority_score, 0) AS priority_score, coalesce(p.priority_rank, 9999) AS priority_rank
    FROM labelled l JOIN features f ON f.email_id = l.id JOIN classes c ON c.email_id = l.id
      LEFT JOIN contacts u ON lower(u.email) = lower(l.from_email) LEFT JOIN priority p ON p.email_id = l.id
    WHERE c.predicted_handleability = 'needs_llm' AND NOT l.is_sent AND length(l.body_text) > 50
      AND l.id NOT IN (SELECT email_id FROM model_labels))
"""
QUEUE_BLOCKS = ("labelled", "features", "classes", "contacts", "priority", "model_labels")


def _queue(spark, d, limit):
    names = ("labelled", "features", "classes", "contacts", "priority", "model_labels")
    return labeling.llm_queue(*[table(spark, d, n) for n in names], limit=limit)


@query(
    "L1_llm_queue",
    "SELECT email_id, llm_priority, is_important_sender, round(priority_score, 6) AS priority_score FROM queue ORDER BY llm_priority, email_id LIMIT 50",
    QUEUE_BLOCKS, QUEUE,
)
def l1(spark, d):
    return present(_queue(spark, d, 50).select("email_id", "llm_priority", "is_important_sender", "priority_score"))


@query(
    "L2_llm_queue_status",
    "SELECT (SELECT count(*) FROM labelled l JOIN classes c ON c.email_id = l.id WHERE c.predicted_handleability = 'needs_llm' AND NOT l.is_sent AND length(l.body_text) > 50) AS total, "
    "(SELECT count(*) FROM model_labels) AS processed, (SELECT count(*) FROM labelled l JOIN classes c ON c.email_id = l.id WHERE c.predicted_handleability = 'needs_llm' AND NOT l.is_sent AND length(l.body_text) > 50) - (SELECT count(*) FROM model_labels) AS remaining",
    ("labelled", "classes", "model_labels"),
)
def l2(spark, d):
    return labeling.llm_queue_status(table(spark, d, "labelled"), table(spark, d, "classes"), table(spark, d, "model_labels"))


def _prompt_sql() -> str:
    number = "CASE WHEN {0} <> 0 THEN CAST(round({0}, {1}) AS VARCHAR) ELSE '0' END"
    values = [
        "coalesce(from_email, 'None')", "coalesce(subject, 'None')", "strftime(make_timestamp(date_s * 1000000), '%Y-%m-%d')",
        "CASE WHEN substring(body_preview, 1, 500) <> '' THEN substring(body_preview, 1, 500) ELSE '(empty body)' END", "relationship_level",
        number.format("(user_replied_to_sender_rate * 100)", 1), "CASE WHEN is_important_sender THEN 'Yes (high engagement history)' ELSE 'No' END",
        "CASE WHEN is_service_email THEN 'Yes' ELSE 'No' END", number.format("CAST(priority_score AS DOUBLE)", 2),
        "CASE WHEN priority_rank < 9999 THEN CAST(priority_rank AS VARCHAR) ELSE 'N/A' END", "CAST(llm_priority AS VARCHAR)",
    ]
    texts = labeling.MESSAGE_PROMPT.replace("%%", "\0").split("%s")
    parts = []
    for i, text in enumerate(texts):
        parts.append("'" + text.replace("\0", "%").replace("'", "''") + "'")
        if i < len(values):
            parts.append(values[i])
    return "concat(" + ", ".join(parts) + ")"


@query(
    "L3_build_prompts",
    f"SELECT email_id, relationship_level, md5({_prompt_sql()}) AS prompt_md5 FROM (SELECT *, CASE WHEN relationship_strength > 0.6 THEN 'STRONG' "
    "WHEN relationship_strength > 0.3 THEN 'MODERATE' WHEN relationship_strength > 0.1 THEN 'WEAK' ELSE 'MINIMAL' END AS relationship_level FROM queue)",
    QUEUE_BLOCKS, QUEUE,
)
def l3(spark, d):
    out = labeling.build_prompts(_queue(spark, d, None))
    return out.select("email_id", "relationship_level", F.md5("prompt").alias("prompt_md5"))


def _stub_scorer(prompts):
    """Deterministic stand-in for a model; every 11th prompt length fails."""
    out = []
    for p in prompts:
        if len(p) % 11 == 0:
            out.append(None)
            continue
        action = ["reply", "task", "fyi"][len(p) % 3]
        text = f'{{"action_type": "{action}", "urgency": "today", "one_liner": "n{len(p)}"}}'
        if len(p) % 2:
            text = f"```json\n{text}\n```"
        out.append({"response": text, "prompt_tokens": len(p) // 4, "completion_tokens": 20})
    return out


DOC_PROMPTS = "docs AS (SELECT doc_id, text AS prompt, length(text) AS n FROM documents)"


def _scored(spark, d):
    docs = driver_table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return labeling.score_with(docs, _stub_scorer, ["doc_id"])


@query(
    "L4_score_with",
    "SELECT doc_id, CASE WHEN n % 11 <> 0 THEN ['reply', 'task', 'fyi'][n % 3 + 1] END AS action_type, CASE WHEN n % 11 <> 0 THEN CAST(n // 4 + 20 AS INT) END AS total_tokens, "
    "n % 11 = 0 AS failed FROM docs",
    extra=DOC_PROMPTS,
)
def l4(spark, d):
    rows = _scored(spark, d)
    label = labeling.parse_model_json("raw_response")["result"]["action_type"]
    return rows.select("doc_id", label.alias("action_type"), "total_tokens", F.col("error").isNotNull().alias("failed"))


@query(
    "L5_parse_model_json",
    "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'task' END AS action_type, CASE WHEN doc_id % 4 <> 3 THEN replace(replace(replace(replace(text, chr(10), ' '), '\"', ''), '\\', ''), chr(9), ' ') END AS one_liner, "
    "doc_id % 4 = 3 AS parse_error FROM documents",
)
def l5(spark, d):
    line = F.translate("text", '\n\t"\\', "  ")
    json = F.concat(F.lit('{"action_type": "task", "one_liner": "'), line, F.lit('"}'))
    reply = (
        F.when(F.col("doc_id") % 4 == 0, json).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), json, F.lit("\n```\n")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```"), json, F.lit("```"))).otherwise(F.concat(F.lit("no json, "), line))
    )
    rows = driver_table(spark, d, "documents").select("doc_id", labeling.parse_model_json(reply).alias("p"))
    return rows.select("doc_id", "p.result.action_type", "p.result.one_liner", "p.parse_error")


@query(
    "L6_usage_rollup",
    "SELECT count(*) AS calls, CAST(sum(n // 4 + 20) FILTER (n % 11 <> 0) AS BIGINT) AS tokens, count(*) FILTER (n % 11 = 0) AS errors, count(*) FILTER (n % 11 <> 0) AS saved FROM docs",
    extra=DOC_PROMPTS,
)
def l6(spark, d):
    return labeling.usage_rollup(_scored(spark, d))


@query(
    "L7_cluster_label_prompts",
    "SELECT dimension, cluster_id, contains(lower(dimension), 'temporal') AS is_short, coalesce(l.subject, '(no subject)') AS subject FROM meta m JOIN labelled l ON l.id = m.representative_email_id",
    ("meta", "labelled"),
)
def l7(spark, d):
    out = labeling.cluster_label_prompts(table(spark, d, "meta"), table(spark, d, "labelled"), table(spark, d, "features"))
    subject = F.regexp_extract("prompt", r"Subject: ([^\n]*)", 1)
    return out.select("dimension", "cluster_id", F.col("prompt").contains("time pattern").alias("is_short"), subject.alias("subject"))


@query(
    "L8_unlabeled_clusters",
    "SELECT dimension, cluster_id, size FROM meta WHERE auto_label IS NULL ORDER BY size DESC, dimension, cluster_id LIMIT 8", ("meta",),
)
def l8(spark, d):
    return labeling.unlabeled_clusters(table(spark, d, "meta"), limit=8).select("dimension", "cluster_id", "size")


@query(
    "L9_labeling_stats",
    "SELECT dimension, count(cluster_id) AS total_clusters, count(auto_label) AS labeled_clusters, count(cluster_id) - count(auto_label) AS unlabeled_clusters "
    "FROM (VALUES ('people'), ('content'), ('behavior'), ('service'), ('temporal')) v(dimension) LEFT JOIN meta USING (dimension) GROUP BY dimension",
    ("meta",),
)
def l9(spark, d):
    return labeling.labeling_stats(table(spark, d, "meta"))


@query(
    "L10_apply_cluster_labels",
    "SELECT dimension, cluster_id, CASE WHEN cluster_id % 3 = 0 THEN concat('Topic ', cluster_id) WHEN cluster_id % 3 = 1 THEN concat('plain words ', cluster_id) ELSE auto_label END AS auto_label FROM meta",
    ("meta",),
)
def l10(spark, d):
    meta = table(spark, d, "meta")
    c = F.col("cluster_id")
    reply = F.when(c % 3 == 0, F.concat(F.lit('{"label": " Topic '), c, F.lit(' ", "confidence": 0.9}'))).when(
        c % 3 == 1, F.concat(F.lit("plain words "), c)
    )
    replies = meta.select("dimension", "cluster_id", reply.alias("raw_response"))
    return labeling.apply_cluster_labels(meta, labeling.cluster_labels(replies)).select("dimension", "cluster_id", "auto_label")


# ------------------------------------------------------------------ entities

MARKETING = " OR ".join(f"from_email LIKE '{p}'" for p in K.MARKETING_LIKE)
PERSON = f"""
    person AS (SELECT l.*, u.name, u.reply_rate, u.is_important_sender, u.emails_from, CASE WHEN {MARKETING} THEN false WHEN u.reply_rate > 0 THEN true
      WHEN u.is_important_sender THEN true WHEN u.emails_from BETWEEN 1 AND 3 THEN true ELSE false END AS real FROM labelled l LEFT JOIN contacts u ON u.email = l.from_email),
    named AS (SELECT *, CASE WHEN name <> from_email THEN '[' || name || '] ' ELSE '' END AS tag, CASE WHEN reply_rate > 0.5 THEN 0.1 ELSE 0 END AS boost FROM person),
    m3 AS (SELECT concat('llm_', n.id, '_', action_type) AS task_id, n.id AS email_id, tag || coalesce(one_liner, CASE WHEN subject <> '' THEN subject END, 'Task from email') AS description,
      CASE action_type WHEN 'reply' THEN 'send' WHEN 'decision' THEN 'decision' ELSE 'other' END AS task_type,
      least(1.0, CASE coalesce(urgency, 'none') WHEN 'immediate' THEN 1.0 WHEN 'today' THEN 0.8 WHEN 'this_week' THEN 0.5 WHEN 'whenever' THEN 0.2 ELSE 0.1 END + boost) AS urgency_score,
      from_email AS assigned_by FROM model_labels k JOIN named n ON n.id = k.email_id WHERE action_type IN ('task', 'reply', 'decision') AND real),
    signals AS (SELECT c.*, n.* FROM classes c JOIN named n ON n.id = c.email_id WHERE (has_request OR has_deadline OR has_approval) AND n.id NOT IN (SELECT email_id FROM m3)),
    m4 AS (SELECT concat('ai_', id) AS task_id, email_id, tag || coalesce(CASE WHEN subject <> '' THEN subject END, 'Task detected from email') AS description,
      CASE WHEN has_approval THEN 'decision' WHEN has_request THEN 'follow_up' ELSE 'other' END AS task_type,
      least(1.0, CASE WHEN has_deadline THEN 0.7 WHEN has_approval THEN 0.6 ELSE 0.4 END + boost) AS urgency_score, from_email AS assigned_by FROM signals WHERE real),
    m5 AS (SELECT p.from_email AS owner_email, count(*) AS email_count, max(date_s) AS last_activity, min(substring(subject, 1, 100)) AS first,
      any_value(name) AS name, any_value(reply_rate) AS rate, any_value(is_important_sender) AS vip FROM person p WHERE reply_rate > 0 AND p.from_email <> '{YOU}' AND NOT is_sent
      GROUP BY p.from_email HAVING count(*) >= 2)
"""
ENTITY = {"blocks": ("labelled", "contacts", "classes", "model_labels"), "extra": PERSON}


@query("M1_not_marketing", f"SELECT id FROM labelled WHERE NOT ({MARKETING})", ("labelled",))
def m1(spark, d):
    return entities.not_marketing(table(spark, d, "labelled")).select("id")


@query("M2_is_real_person", "SELECT id, real AS is_real_person FROM person", **ENTITY)
def m2(spark, d):
    return entities.with_sender(table(spark, d, "labelled"), table(spark, d, "contacts")).select("id", "is_real_person")


TASK_SELECT = "SELECT task_id, email_id, description, task_type, round(CAST(urgency_score AS DOUBLE), 6) AS urgency_score, assigned_by FROM "


def _model_tasks(spark, d):
    return entities.tasks_from_model(table(spark, d, "model_labels"), table(spark, d, "labelled"), table(spark, d, "contacts"))


@query("M3_tasks_from_model", TASK_SELECT + "m3", **ENTITY)
def m3(spark, d):
    return present(_model_tasks(spark, d).drop("status", "extraction_method"))


@query("M4_tasks_from_signals", TASK_SELECT + "m4", **ENTITY)
def m4(spark, d):
    out = entities.tasks_from_signals(
        table(spark, d, "classes"), table(spark, d, "labelled"), table(spark, d, "contacts"), _model_tasks(spark, d)
    )
    return present(out.drop("status", "extraction_method"))


@query(
    "M5_projects_from_people",
    "SELECT concat('Conversation: ', CASE WHEN name <> owner_email THEN name ELSE split_part(owner_email, '@', 1) END, CASE WHEN length(first) > 5 AND NOT contains(substring(first, 1, 50), 'Re:') "
    "AND NOT contains(substring(first, 1, 50), 'Fwd:') THEN ' - ' || substring(first, 1, 50) ELSE '' END) AS name, CASE WHEN vip THEN 'key_relationship' WHEN rate > 0.5 THEN 'active_conversation' ELSE 'conversation' END AS project_type, "
    "owner_email, email_count, last_activity, CASE WHEN vip THEN 0.95 WHEN rate > 0.5 THEN 0.9 ELSE 0.7 END AS confidence FROM m5",
    **ENTITY,
    casts="confidence DOUBLE",
)
def m5(spark, d):
    out = entities.projects_from_people(table(spark, d, "labelled"), table(spark, d, "contacts"))
    return present(out.drop("cluster_id", "detected_from"))


@query(
    "M6_projects_from_clusters",
    """
    SELECT coalesce(auto_label, CASE WHEN subject <> '' THEN subject END, concat('Topic Cluster ', cluster_id)) AS name, cluster_id, email_count, last_activity, round(CAST(least(0.9, 0.5 + people / email_count * 0.4) AS DOUBLE), 6) AS confidence
    FROM (SELECT m.cluster_id, m.auto_label, m.activity_s AS last_activity, count(*) AS email_count, count(*) FILTER (p.real) AS people, min(substring(p.subject, 1, 60)) AS subject,
        bool_or(p.from_email IN (SELECT owner_email FROM projects WHERE detected_from = 'real_person_thread' AND owner_email LIKE '%studio%')) AS covered
      FROM meta m JOIN assignments a ON a.content_cluster_id = m.cluster_id JOIN person p ON p.id = a.email_id WHERE m.dimension = 'content' AND m.size >= 3 GROUP BY ALL)
    WHERE people > 0 AND people / email_count >= 0.5 AND NOT covered
    """,
    ("labelled", "contacts", "classes", "model_labels", "meta", "assignments", "projects"), PERSON,
    casts="last_activity BIGINT",
)
def m6(spark, d):
    known = table(spark, d, "projects").filter(F.col("owner_email").contains("studio"))
    out = entities.projects_from_clusters(
        table(spark, d, "meta"), table(spark, d, "assignments"), table(spark, d, "labelled"), table(spark, d, "contacts"), known
    )
    return present(out.select("name", "cluster_id", "email_count", "last_activity", "confidence"))


CONTEXT_SQL = f"""
    ctx AS (SELECT p.email_id, n.from_email AS sender_email, CAST(coalesce(n.emails_from, 0) AS DOUBLE) AS sender_frequency, CASE WHEN real THEN 1.0 ELSE 0.0 END AS sender_importance,
      CASE WHEN n.reply_rate <> 0 THEN n.reply_rate END AS sender_reply_rate, n.thread_id, t.n AS thread_length, n.date_s AS email_timestamp,
      (n.date_s // 3600) % 24 BETWEEN 9 AND 17 AND (n.date_s // 86400 + 3) % 7 < 5 AS is_business_hours, ({NOW_S} - n.date_s) / 3600.0 AS age_hours,
      CASE WHEN real THEN 0.5 + CASE WHEN is_important_sender THEN 0.3 ELSE 0 END + CASE WHEN reply_rate > 0.5 THEN 0.2 ELSE 0 END ELSE 0.1 END AS people_score,
      CASE WHEN real THEN 0.5 + least(0.5, coalesce(reply_rate, 0)) ELSE 1 - CASE WHEN sender_novelty = 0 THEN 0.5 ELSE sender_novelty END END AS relationship_score,
      CASE WHEN real THEN least(1.0, CASE WHEN priority_score = 0 THEN 0.5 ELSE priority_score END * 1.5) ELSE CASE WHEN priority_score = 0 THEN 0.5 ELSE priority_score END * 0.5 END AS overall_priority
      FROM priority p JOIN named n ON n.id = p.email_id LEFT JOIN (SELECT thread_id, count(*) AS n FROM labelled GROUP BY 1) t ON t.thread_id = n.thread_id)
"""


def _contexts(spark, d):
    m = table(spark, d, "labelled")
    return entities.priority_contexts(table(spark, d, "priority"), m, table(spark, d, "contacts"), threads.build_threads(m), now())


@query(
    "M7_priority_contexts",
    "SELECT * REPLACE (round(age_hours, 6) AS age_hours, round(CAST(people_score AS DOUBLE), 6) AS people_score, round(CAST(relationship_score AS DOUBLE), 6) AS relationship_score, "
    "round(CAST(overall_priority AS DOUBLE), 6) AS overall_priority), CASE WHEN age_hours < 24 THEN 0.8 WHEN age_hours < 72 THEN 0.5 ELSE 0.2 END AS temporal_score FROM ctx",
    ("labelled", "contacts", "classes", "model_labels", "priority"), PERSON.rstrip() + "," + CONTEXT_SQL,
    casts="sender_importance DOUBLE, sender_reply_rate DOUBLE, temporal_score DOUBLE",
)
def m7(spark, d):
    return present(_contexts(spark, d))


@query(
    "M8_extract_entities",
    """
    SELECT (SELECT count(*) FROM m3 WHERE email_id % 2 = 1) + (SELECT count(*) FROM m4) AS tasks_created,
      (SELECT count(*) FROM m3 WHERE email_id % 2 = 0) AS tasks_updated,
      (SELECT count(*) FROM m5 WHERE length(owner_email) % 2 = 1) + (SELECT count(*) FROM m6c WHERE people / email_count >= 0.5 AND NOT covered) AS projects_created,
      (SELECT count(*) FROM m5 WHERE length(owner_email) % 2 = 0) AS projects_updated,
      (SELECT count(*) FROM priority WHERE email_id % 3 <> 0) AS priority_contexts_created,
      (SELECT count(*) FROM priority WHERE email_id % 3 = 0) AS priority_contexts_updated,
      (SELECT count(*) FROM model_labels k JOIN person p ON p.id = k.email_id WHERE action_type IN ('task', 'reply', 'decision') AND NOT real)
        + (SELECT count(*) FROM signals WHERE NOT real) AS tasks_filtered_marketing,
      (SELECT count(*) FROM m6c WHERE people / email_count < 0.5 OR covered) AS projects_filtered_marketing
    """,
    ("labelled", "contacts", "classes", "model_labels", "meta", "assignments", "priority"),
    PERSON.rstrip() + """, m6c AS (
      SELECT * FROM (SELECT m.cluster_id, count(*) AS email_count, count(*) FILTER (p.real) AS people, bool_or(p.from_email IN (SELECT owner_email FROM m5)) AS covered
        FROM meta m JOIN assignments a ON a.content_cluster_id = m.cluster_id JOIN person p ON p.id = a.email_id WHERE m.dimension = 'content' AND m.size >= 3 GROUP BY m.cluster_id) WHERE people > 0)
    """,
)
def m8(spark, d):
    """Half of the tasks and projects and a third of the contexts exist before."""
    return _extracted(spark, d)[1]


@query(
    "M8_merged_tasks",
    """
    SELECT task_id, description, task_type, CASE WHEN email_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status,
      CASE WHEN email_id % 2 = 0 THEN 'before' ELSE 'u1' END AS user_id FROM m3
    UNION ALL SELECT task_id, description, task_type, 'pending', 'u1' FROM m4
    """,
    **ENTITY,
)
def m8_tasks(spark, d):
    """What an extraction leaves of tasks the user has completed: new text, old status and owner."""
    return _extracted(spark, d)[0]["tasks"].select("task_id", "description", "task_type", "status", "user_id")


def _extracted(spark, d):
    t = {n: table(spark, d, n) for n in ("labelled", "contacts", "classes", "model_labels", "meta", "assignments", "priority")}
    tasks = entities.tasks_from_model(t["model_labels"], t["labelled"], t["contacts"]).filter("email_id % 2 = 0").withColumns(
        {"status": F.lit("completed"), "description": F.lit("old"), "user_id": F.lit("before")})
    owners = entities.projects_from_people(t["labelled"], t["contacts"]).filter("length(owner_email) % 2 = 0")
    contexts = t["priority"].filter("email_id % 3 = 0").select("email_id")
    return entities.extract_entities(
        t["model_labels"], t["classes"], t["labelled"], t["contacts"], t["meta"], t["assignments"], t["priority"],
        threads.build_threads(t["labelled"]), tasks, owners, contexts, now(), "u1",
    )


# ------------------------------------------------------------------ serving


@query(
    "O1_priority_inbox",
    """
    SELECT l.id, p.priority_rank, c.sender_email, round(c.overall_priority, 6) AS overall_priority,
      (SELECT count(*) FROM tasks t WHERE t.email_id = l.id AND t.status = 'pending') AS task_count,
      (SELECT min(pr.name) FROM links k JOIN projects pr ON pr.project_id = k.project_id WHERE k.email_id = l.id) AS project_name
    FROM labelled l LEFT JOIN priority p ON p.email_id = l.id LEFT JOIN contexts c ON c.email_id = l.id WHERE NOT l.is_sent
    ORDER BY p.priority_rank ASC NULLS LAST, l.date_s DESC, l.id LIMIT 40 OFFSET 10
    """,
    ("labelled", "priority", "contexts", "tasks", "links", "projects"),
)
def o1(spark, d):
    names = ("labelled", "priority", "contexts", "tasks", "projects", "links")
    page, _ = serving.priority_inbox(*[table(spark, d, n) for n in names], limit=40, offset=10)
    return present(page.select("id", "priority_rank", "sender_email", "overall_priority", "task_count", "project_name"))


@query(
    "O1_inbox_total", "SELECT count(*) AS total, count(*) > 50 AS has_more FROM labelled WHERE NOT is_sent", ("labelled",),
)
def o1_total(spark, d):
    names = ("labelled", "priority", "contexts", "tasks", "projects", "links")
    return serving.priority_inbox(*[table(spark, d, n) for n in names], limit=40, offset=10)[1]


@query(
    "O2_inbox_stats",
    "SELECT (SELECT count(*) FROM labelled WHERE NOT is_sent) AS total_emails, (SELECT count(*) FROM tasks WHERE status = 'pending') AS pending_tasks, "
    "(SELECT count(*) FROM priority WHERE priority_score > 0.7) AS urgent_emails, (SELECT count(*) FROM contexts WHERE sender_importance > 0) AS from_real_people, "
    "(SELECT round(avg(priority_score), 6) FROM priority) AS avg_priority_score",
    ("labelled", "tasks", "priority", "contexts"),
)
def o2(spark, d):
    return present(serving.inbox_stats(*[table(spark, d, n) for n in ("labelled", "tasks", "priority", "contexts")]))


@query(
    "O3_oldest_unanswered",
    f"SELECT round(({NOW_S} - min(date_s)) / 3600.0, 6) AS oldest_unanswered_hours FROM labelled WHERE NOT is_sent AND action = 'PENDING' "
    f"AND date_s > {NOW_S} - 30 * 86400 AND message_id NOT IN (SELECT in_reply_to FROM labelled WHERE in_reply_to IS NOT NULL)",
    ("labelled",),
)
def o3(spark, d):
    return present(serving.oldest_unanswered(table(spark, d, "labelled"), now(), ("PENDING",)))


TODO_SQL = f"""
    todos AS (SELECT l.id, concat('email_', l.id) AS todo_id, CASE WHEN subject <> '' THEN subject ELSE 'No subject' END AS title, concat('Email from ', coalesce(from_name, from_email, '')) AS source,
      CASE WHEN coalesce(priority_score, 0) > 0.7 OR coalesce(age_hours, 0) > 48 THEN 'high' WHEN coalesce(priority_score, 0) > 0.4 THEN 'medium' ELSE 'low' END AS urgency,
      CASE WHEN age_hours > 72 THEN 'Overdue' WHEN age_hours > 24 THEN 'Today' END AS due, priority_rank
      FROM labelled l LEFT JOIN priority p ON p.email_id = l.id LEFT JOIN contexts c ON c.email_id = l.id
      WHERE NOT is_sent AND action IN ('PENDING', 'STARRED') AND date_s > {NOW_S} - 7 * 86400)
"""


@query(
    "O4_digest_todos", "SELECT todo_id, title, source, urgency, due FROM todos ORDER BY priority_rank NULLS LAST, id LIMIT 20",
    ("labelled", "priority", "contexts"), TODO_SQL,
)
def o4(spark, d):
    out = serving.digest_todos(
        table(spark, d, "labelled"), table(spark, d, "priority"), table(spark, d, "contexts"), now(), 20, ("PENDING", "STARRED")
    )
    return out.select("todo_id", "title", "source", "urgency", "due")


@query(
    "O5_digest_topics",
    f"""
    SELECT concat('thread_', thread_id) AS topic_id, trim(split_part(CASE WHEN first IS NULL OR last_subject = '' THEN 'Thread' ELSE first END, ',', 1)) AS title, email_count,
      array_to_string(people[1:3], ', ') AS participants, CASE WHEN age < 3600 THEN concat(CAST(floor(age / 60) AS BIGINT), ' minutes ago') WHEN age < 86400 THEN concat(CAST(floor(age / 3600) AS BIGINT), ' hours ago')
        ELSE concat(CAST(floor(age / 86400) AS BIGINT), ' days ago') END AS last_activity, CASE WHEN email_count > 5 THEN 'high' WHEN email_count > 3 THEN 'medium' ELSE 'low' END AS urgency
    FROM (SELECT thread_id, count(*) AS email_count, {NOW_S} - max(date_s) AS age, max(date_s) AS last, min(subject) AS first, max(subject) AS last_subject,
        list_sort(list(DISTINCT coalesce(from_name, from_email))) AS people FROM labelled WHERE date_s > {NOW_S} - 7 * 86400 AND date_s < {NOW_S} GROUP BY thread_id HAVING count(*) > 1)
    ORDER BY last DESC, thread_id LIMIT 25
    """,
    ("labelled",),
)
def o5(spark, d):
    past = table(spark, d, "labelled").filter(F.col("date_parsed") < now())
    return serving.digest_topics(past, now(), 25)


@query(
    "O6_digest_counts",
    "SELECT count(*) FILTER (urgency = 'high') AS urgent, count(*) AS total, CASE WHEN count(*) FILTER (urgency = 'high') = 1 THEN '1 urgent item needs attention' "
    "WHEN count(*) FILTER (urgency = 'high') > 1 THEN concat(count(*) FILTER (urgency = 'high'), ' urgent items need attention') WHEN count(*) = 1 THEN '1 item to review' "
    "WHEN count(*) > 1 THEN concat(count(*), ' items to review') ELSE 'All caught up!' END AS subtitle FROM todos",
    ("labelled", "priority", "contexts"), TODO_SQL,
)
def o6(spark, d):
    out = serving.digest_todos(
        table(spark, d, "labelled"), table(spark, d, "priority"), table(spark, d, "contexts"), now(), None, ("PENDING", "STARRED")
    )
    return serving.digest_counts(out)


@query(
    "O7_list_tasks",
    "SELECT task_id, round(urgency_score, 6) AS urgency_score FROM tasks WHERE user_id = 'u1' AND status = 'pending' ORDER BY urgency_score DESC NULLS LAST, created_s DESC, task_id LIMIT 10 OFFSET 5",
    ("tasks",),
)
def o7(spark, d):
    page, _ = serving.list_tasks(table(spark, d, "tasks"), user_id="u1", status="pending", limit=10, offset=5)
    return present(page.select("task_id", "urgency_score"))


@query(
    "O8_task_counts",
    "SELECT user_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending' AND urgency_score > 0.7) AS urgent FROM tasks GROUP BY user_id",
    ("tasks",),
)
def o8(spark, d):
    return serving.task_counts(table(spark, d, "tasks"))


@query(
    "O9_list_project_rows",
    "SELECT project_id, name FROM projects WHERE is_active ORDER BY activity_s DESC NULLS LAST, created_s DESC, project_id LIMIT 15 OFFSET 2", ("projects",),
)
def o9(spark, d):
    page, _ = serving.list_project_rows(table(spark, d, "projects"), is_active=True, limit=15, offset=2)
    return page.select("project_id", "name")


@query(
    "O10_apply_task_actions",
    f"SELECT task_id, CASE email_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'dismissed' ELSE status END AS status, CASE WHEN email_id % 5 = 3 THEN 'patched' ELSE description END AS description, "
    f"CASE WHEN email_id % 5 = 0 THEN {NOW_S} END AS completed_at FROM tasks WHERE email_id % 5 <> 2",
    ("tasks",),
    casts="completed_at BIGINT",
)
def o10(spark, d):
    t = table(spark, d, "tasks")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("complete", "dismiss", "delete", "patch")]), (F.col("email_id") % 5 + 1).cast("int"))
    changes = t.filter("email_id % 5 < 4").select("task_id", verb.alias("verb"), now().alias("at"), F.lit("patched").alias("description"))
    out = serving.apply_task_actions(t, changes)
    return present(out.select("task_id", "status", "description", "completed_at"))


@query(
    "O10_action_results",
    "SELECT task_id, 'complete' AS verb, email_id % 2 = 0 AS success, CASE WHEN email_id % 2 <> 0 THEN 'NOT_FOUND' END AS error FROM tasks", ("tasks",),
)
def o10_results(spark, d):
    t = table(spark, d, "tasks")
    return serving.action_results(t.filter("email_id % 2 = 0"), t.select("task_id", F.lit("complete").alias("verb")))


@query(
    "O11_search_messages",
    "SELECT l.id, priority_rank FROM labelled l LEFT JOIN priority p ON p.email_id = l.id WHERE NOT is_sent AND (contains(lower(subject), 'project') OR contains(lower(body_text), 'project')) "
    "ORDER BY priority_rank NULLS LAST, date_s DESC, l.id LIMIT 10",
    ("labelled", "priority"),
)
def o11(spark, d):
    return serving.search_messages(table(spark, d, "labelled"), table(spark, d, "priority"), "Project").select("id", "priority_rank")


@query(
    "O11_indexed_search",
    "SELECT id, priority_rank FROM (SELECT l.id, priority_rank FROM labelled l LEFT JOIN priority p ON p.email_id = l.id WHERE NOT is_sent AND "
    "(contains(lower(subject), 'project') OR contains(lower(body_text), 'project')))",
    ("labelled", "priority"),
)
def o11_indexed(spark, d):
    """All hits of the scan, from posting lists."""
    path = shared_folder(spark, "text-index")
    textindex.build_text_index(table(spark, d, "labelled"), path)
    return textindex.search_index(spark, path, table(spark, d, "priority"), "Project", None).select("id", "priority_rank")


# ------------------------------------------------------------------ event log


@query(
    "P1_append_events",
    "SELECT event_id, thread_id, coalesce((SELECT max(o.seq) FROM log o WHERE o.thread_id = n.thread_id AND o.seq % 4 = 0), 0) + row_number() OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS seq "
    "FROM log n WHERE seq % 4 <> 0",
    ("log",),
)
def p1(spark, d):
    log = table(spark, d, "log")
    return eventlog.append_events(log.filter("seq % 4 = 0"), log.filter("seq % 4 <> 0").drop("seq")).select("event_id", "thread_id", "seq")


@query("P2_events_after", "SELECT event_id, seq FROM log WHERE thread_id = 't8' AND seq > 100 ORDER BY seq LIMIT 20", ("log",))
def p2(spark, d):
    return eventlog.events_after(table(spark, d, "log"), "t8", 100, 20)[0].select("event_id", "seq")


@query(
    "P2_next_page",
    "SELECT count(*) > 20 AS has_more, max(seq) FILTER (n <= 20) AS next_seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM log WHERE thread_id = 't8' AND seq > 100 ORDER BY seq LIMIT 21)",
    ("log",),
)
def p2_next(spark, d):
    return eventlog.events_after(table(spark, d, "log"), "t8", 100, 20)[1]


@query("P3_latest_seq", "SELECT thread_id, max(seq) AS latest_seq FROM log GROUP BY thread_id", ("log",))
def p3(spark, d):
    return eventlog.latest_seq(table(spark, d, "log"))


@query("P4_events_by_correlation", "SELECT event_id, seq FROM log WHERE correlation_id = 'c8-1' ORDER BY seq", ("log",))
def p4(spark, d):
    return eventlog.events_by_correlation(table(spark, d, "log"), "c8-1").select("event_id", "seq")


@query("P5_events_by_type", "SELECT event_id, seq FROM log WHERE thread_id = 't8' AND type = 'ui.action' ORDER BY seq LIMIT 100", ("log",))
def p5(spark, d):
    return eventlog.events_by_type(table(spark, d, "log"), "t8", "ui.action").select("event_id", "seq")


@query("P6_count_events", "SELECT thread_id, org_id, count(*) AS n_events FROM log GROUP BY thread_id, org_id", ("log",))
def p6(spark, d):
    return eventlog.count_events(table(spark, d, "log"), ["thread_id", "org_id"])


@query(
    "P7_expand_turns",
    "SELECT concat(correlation_id, '-', pos) AS event_id, thread_id, ts, CASE pos WHEN 0 THEN 'turn.user.open' WHEN 2 THEN 'turn.user.close' ELSE CASE input_type WHEN 'text' THEN 'ui.text.submit' "
    "ELSE 'stt.final' END END AS type, CASE WHEN pos = 1 THEN md5(text) END AS said FROM turns, (VALUES (0), (1), (2)) v(pos)",
    ("turns",),
)
def p7(spark, d):
    out = eventlog.expand_turns(table(spark, d, "turns"))
    said = F.coalesce(F.get_json_object("payload", "$.text"), F.get_json_object("payload", "$.transcript"))
    return out.select("event_id", "thread_id", "ts", "type", F.md5(said).alias("said"))


@query(
    "P8_turn_timeline",
    "SELECT correlation_id, min(ts) FILTER (type = 'turn.agent.open') AS opened_at, max(ts) FILTER (type = 'turn.agent.close') AS closed_at, count(*) FILTER (type = 'assistant.text.delta') AS events_emitted, "
    "coalesce(max(json_extract_string(payload, '$.reason')), 'open') AS status FROM agent_log GROUP BY correlation_id HAVING opened_at IS NOT NULL",
    ("agent_log",),
)
def p8(spark, d):
    return eventlog.turn_timeline(table(spark, d, "agent_log"))


@query(
    "P9_active_sessions",
    "SELECT thread_id, max_by(session_id, started_s) AS session_id, max(started_s) AS started_at FROM sessions WHERE status = 'active' GROUP BY thread_id", ("sessions",),
)
def p9(spark, d):
    return present(eventlog.active_sessions(table(spark, d, "sessions")))


@query(
    "P9_list_sessions", "SELECT session_id FROM sessions WHERE thread_id = 't8' ORDER BY started_s DESC, session_id LIMIT 7 OFFSET 2", ("sessions",),
)
def p9_list(spark, d):
    return eventlog.list_sessions(table(spark, d, "sessions"), "t8", 7, 2)[0].select("session_id")


@query(
    "P10_list_threads",
    "SELECT thread_id, max(started_s) AS updated_at FROM sessions WHERE user_id = 'u3' GROUP BY thread_id ORDER BY updated_at DESC, thread_id LIMIT 10", ("sessions",),
)
def p10(spark, d):
    t = table(spark, d, "sessions").groupBy("user_id", "thread_id").agg(F.max("started_at").alias("updated_at"))
    return present(eventlog.list_threads(t, "u3", 10)[0].select("thread_id", "updated_at"))


@query(
    "P11_latest_session_state",
    "SELECT session_id, CASE WHEN started_s % 2 = 0 THEN 'ended' ELSE status END AS status, CASE WHEN started_s % 2 = 0 THEN started_s + 60 END AS ended_at FROM sessions", ("sessions",),
)
def p11(spark, d):
    s = table(spark, d, "sessions")
    started = F.unix_timestamp("started_at")
    ends = s.filter(started % 2 == 0).select("session_id", F.timestamp_seconds(started + 60).alias("ended_at"))
    return present(eventlog.latest_session_state(s, ends).select("session_id", "status", "ended_at"))


# ------------------------------------------------------------------ streaming


def _notices(frame):
    """Notification messages made of the events: every 7th is broken, every 5th has no address."""
    e = F.col("event_id")
    payload = F.to_json(F.struct(
        F.when(e % 5 != 0, F.concat(F.lit("user"), F.col("user_id"), F.lit("@x.example"))).alias("emailAddress"),
        F.floor(e / 3).alias("historyId"),
    ))
    data = F.when(e % 7 == 0, F.lit("%%not base64")).otherwise(F.base64(payload.cast("binary")))
    return frame.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), data.alias("data"))


PARSED = (
    "notices AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN concat('user', user_id, '@x.example') END AS email, "
    "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id // 3 AS VARCHAR) END AS history_id, CASE WHEN event_id % 7 = 0 THEN 'Failed to decode notification' "
    "WHEN event_id % 5 = 0 THEN 'Missing emailAddress in notification' END AS error FROM events)"
)


@query("Q1_parse_notifications", "SELECT event_id, email, history_id, error FROM notices", extra=PARSED)
def q1(spark, d):
    out = notifications.parse_notifications(_notices(driver_table(spark, d, "events")))
    return out.select("event_id", "email", "history_id", "error")


@query("Q2_dedup_notifications", "SELECT DISTINCT email, history_id FROM notices WHERE error IS NULL", extra=PARSED)
def q2(spark, d):
    """Run as a stream over the events file until all of it is read."""
    source = driver_table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    valid = notifications.valid_notifications(notifications.parse_notifications(_notices(stream)))
    fresh = notifications.dedup_notifications(valid, "ts")
    out, state = shared_folder(spark, "dedup"), shared_folder(spark, "dedup-state")
    run = fresh.select("email", "history_id").writeStream.format("parquet").option("checkpointLocation", state)
    run.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("email string, history_id string").parquet(out)


@query(
    "Q3_match_users",
    "SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN user_id % 4 = 0 THEN concat('User not found: ', email) END AS error FROM notices WHERE error IS NULL",
    extra=PARSED,
)
def q3(spark, d):
    events = driver_table(spark, d, "events")
    users = events.filter("user_id % 4 <> 0").select(F.concat(F.lit("user"), "user_id", F.lit("@x.example")).alias("email"), "user_id").distinct()
    valid = notifications.valid_notifications(notifications.parse_notifications(_notices(events)))
    return notifications.match_users(valid.drop("user_id"), users).select("event_id", "user_id", "error")


@query(
    "Q4_notification_counters",
    "SELECT user_id, count(*) AS notification_count, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_notification_at FROM events GROUP BY user_id",
)
def q4(spark, d):
    """Complete-mode streaming aggregate, read back from its last batch."""
    source = driver_table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = shared_folder(spark, "counters"), shared_folder(spark, "counters-state")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counted = notifications.notification_counters(stream, "ts")
    run = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state)
    run.trigger(availableNow=True).start().awaitTermination()
    return present(spark.read.parquet(out))


HISTORY = (
    "history AS (SELECT user_id, event_id // 2 AS history_id, concat('x', event_id // 4) AS message_id FROM events), "
    "marks AS (SELECT user_id, max(history_id) // 2 AS mark FROM history WHERE user_id % 3 <> 0 GROUP BY user_id)"
)


def _history(spark, d):
    events = driver_table(spark, d, "events")
    history = events.select(
        "user_id", F.floor(F.col("event_id") / 2).cast("string").alias("history_id"),
        F.array(F.struct(F.struct(F.concat(F.lit("x"), F.floor(F.col("event_id") / 4)).alias("id")).alias("message"))).alias("messages_added"),
    )
    marks = events.filter("user_id % 3 <> 0").groupBy("user_id").agg(
        F.floor(F.max(F.floor(F.col("event_id") / 2)) / 2).cast("string").alias("last_history_id")
    )
    return history, marks


@query(
    "Q5_changed_ids",
    "SELECT DISTINCT h.user_id, message_id FROM history h LEFT JOIN marks m USING (user_id) WHERE history_id > coalesce(mark, 0)", extra=HISTORY,
)
def q5(spark, d):
    return notifications.changed_ids(*_history(spark, d))[0]


@query(
    "Q5_new_marks",
    "SELECT user_id, greatest(max(history_id) FILTER (history_id > coalesce(mark, 0)), max(mark)) AS last_history_id FROM history LEFT JOIN marks USING (user_id) GROUP BY user_id "
    "HAVING last_history_id IS NOT NULL",
    extra=HISTORY,
)
def q5_marks(spark, d):
    return notifications.changed_ids(*_history(spark, d))[1]


@query(
    "Q6_ingest_stream",
    "SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM messages WHERE NOT is_sent) AS features, (SELECT count(*) FROM messages WHERE NOT is_sent) AS classes",
    ("messages",),
)
def q6(spark, d):
    """The messages arrive twice, in two files; every derived table must hold each once."""
    m = table(spark, d, "messages").withColumn("word_count", F.lit(0)).select(*MESSAGE.fieldNames())
    incoming = shared_folder(spark, "incoming")
    m.filter("id % 2 = 0").unionByName(m).write.parquet(incoming)
    tables = ingest.MailTables(spark, shared_folder(spark, "tables"))
    stream = spark.readStream.schema(MESSAGE).parquet(incoming)
    ingest.ingest_stream(stream, tables, shared_folder(spark, "ingest-state")).awaitTermination()

    def size(name, schema):
        return tables.read(name, schema).agg(F.count(F.lit(1)))

    return size("messages", MESSAGE).toDF("messages").select(
        "messages", size("features", "email_id bigint").scalar().alias("features"),
        size("classes", "email_id bigint").scalar().alias("classes"),
    )


def _ingested(spark, source, parts):
    """A store after ``parts`` micro-batches of the messages and the first one again.

    Each part comes as the files of one parallel write, and the stream takes all of them as one micro-batch.
    """
    incoming, state = shared_folder(spark, "incoming"), shared_folder(spark, "ingest-state")
    mail = source.select(*[F.col(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGE])
    tables = ingest.MailTables(spark, shared_folder(spark, "tables"))
    for part in [*range(parts), 0]:
        mail.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).write.mode("append").parquet(incoming)
        ingest.ingest_stream(spark.readStream.schema(MESSAGE).parquet(incoming), tables, state).awaitTermination()
    return tables


@query(
    "Q6_sender_state",
    "SELECT * REPLACE (round(avg_response_hours, 6) AS avg_response_hours, round(sender_reply_rate, 6) AS sender_reply_rate) FROM f5",
    ("order_mail",), sender_sql("order_mail"),
)
def q6_state(spark, d):
    """F5 from the changes of three batches and a replay, without the mail."""
    return present(_ingested(spark, table(spark, d, "order_mail"), 3).senders.stats())


@query("Q6_ingested_features", "SELECT * FROM feature_rows", ("messages",), feature_rows("messages"), FEATURE_TYPES)
def q6_features(spark, d):
    """F12 of a mailbox that comes as one batch and once more."""
    tables = _ingested(spark, table(spark, d, "messages"), 1)
    return present(tables.read("features", message_features(tables.read("messages", MESSAGE)).schema))


@query(
    "Q7_phase_partition",
    f"SELECT id, CASE WHEN age < 7 THEN 'quick' WHEN age < 30 THEN 'standard' WHEN age < 90 THEN 'deep' END AS phase, CAST(CASE WHEN age < 7 THEN 100 WHEN age < 30 THEN 200 WHEN age < 90 THEN 500 END AS INT) AS batch_size, "
    f"CASE WHEN age < 90 THEN age < 30 END AS run_vectors FROM (SELECT id, ({NOW_S} - date_s) / 86400.0 AS age FROM messages)",
    ("messages",),
)
def q7(spark, d):
    out = ingest.phase_partition(table(spark, d, "messages"), now())
    return out.select("id", "phase", "batch_size", "run_vectors")


@query(
    "Q7_phase_plan",
    f"SELECT CASE WHEN age < 7 THEN 'quick' WHEN age < 30 THEN 'standard' ELSE 'deep' END AS phase, count(*) AS messages, CAST(ceil(count(*) / CASE WHEN any_value(age) < 7 THEN 100 WHEN any_value(age) < 30 THEN 200 ELSE 500 END) AS BIGINT) AS batches "
    f"FROM (SELECT id, ({NOW_S} - date_s) / 86400.0 AS age FROM messages) WHERE age < 90 GROUP BY 1",
    ("messages",),
)
def q7_plan(spark, d):
    return ingest.phase_plan(ingest.phase_partition(table(spark, d, "messages"), now())).select("phase", "messages", "batches")


@query(
    "Q8_phase_progress",
    "SELECT CAST(floor(conv_id / 40) AS INT) AS phase_order, conv_id AS batch_no, CAST(sum(n) OVER w AS BIGINT) AS emails_processed, least(sum(n) OVER w / 500.0, 0.99) AS progress "
    "FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) WINDOW w AS (ORDER BY floor(conv_id / 40), conv_id)",
)
def q8(spark, d):
    batches = driver_table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.floor(F.col("conv_id") / 40).cast("int").alias("phase_order"), F.col("conv_id").alias("batch_no"),
        *[F.col("n").alias(c) for c in ingest.PROGRESS],
    )
    return present(ingest.phase_progress(batches, 500).select("phase_order", "batch_no", "emails_processed", "progress"))


@query(
    "Q8_backfill_progress",
    """
    SELECT phase_order, CAST(row_number() OVER w - 1 AS BIGINT) AS batch_no, CAST(sum(n) OVER w AS BIGINT) AS emails_processed,
      CAST(sum(received) OVER w AS BIGINT) AS features_computed, round(least(sum(n) OVER w / sum(n) OVER (), 0.99), 6) AS progress
    FROM (SELECT phase_order, place // size AS batch, count(*) AS n, count(*) FILTER (NOT is_sent) AS received
      FROM (SELECT *, row_number() OVER (PARTITION BY phase_order ORDER BY date_s DESC, id) - 1 AS place FROM phased) GROUP BY ALL)
    WINDOW w AS (ORDER BY phase_order, batch)
    """,
    ("messages",),
    f"phased AS (SELECT id, date_s, is_sent, CASE WHEN age < 7 THEN 0 WHEN age < 30 THEN 1 ELSE 2 END AS phase_order, CASE WHEN age < 7 THEN 100 WHEN age < 30 THEN 200 ELSE 500 END AS size "
    f"FROM (SELECT *, ({NOW_S} - date_s) / 86400.0 AS age FROM messages) WHERE age < 90)",
)
def q8_backfill(spark, d):
    """The back-fill of the messages, phase by phase, and its progress."""
    m = table(spark, d, "messages")
    mail = m.select(*[F.col(f.name) if f.name in m.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGE])
    out = ingest.backfill(mail, ingest.MailTables(spark, shared_folder(spark, "backfill")), now())
    return present(out.select("phase_order", "batch_no", "emails_processed", "features_computed", "progress"))


SYNC_LOG = (
    "sync_log AS (SELECT user_id, event_id AS moment, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'complete' ELSE 'fail' END AS event, event_id % 50 AS emails_synced, "
    "CAST(event_id AS VARCHAR) AS history_id FROM events WHERE user_id % 5 <> 0 AND event_type IN ('click', 'view', 'error'))"
)


@query(
    "Q9_sync_status",
    "SELECT u.user_id, CASE max_by(event, moment) WHEN 'start' THEN 'syncing' WHEN 'complete' THEN 'idle' WHEN 'fail' THEN 'error' ELSE 'not_synced' END AS status, "
    "coalesce(max_by(emails_synced, moment) FILTER (event = 'complete'), 0) AS emails_synced, max_by(history_id, moment) FILTER (event = 'complete') AS last_history_id "
    "FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN sync_log USING (user_id) GROUP BY u.user_id",
    extra=SYNC_LOG,
)
def q9(spark, d):
    events = driver_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "complete").otherwise("fail")
    log = events.filter("user_id % 5 <> 0 AND event_type IN ('click', 'view', 'error')").select(
        "user_id", F.col("event_id").alias("at"), kind.alias("event"), (F.col("event_id") % 50).alias("emails_synced"),
        F.col("event_id").cast("string").alias("history_id"), F.lit("broken").alias("error_message"),
    )
    out = notifications.sync_status(log, events.select("user_id").distinct())
    return out.select("user_id", "status", "emails_synced", "last_history_id")


@query(
    "Q10_expiring_watches",
    "SELECT event_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-16 00:00:00' + INTERVAL 24 HOUR",
)
def q10(spark, d):
    subs = driver_table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "active").otherwise("error").alias("status"), F.col("ts").cast("timestamp").alias("expiration")
    )
    return notifications.expiring_watches(subs, F.timestamp_seconds(F.lit(NOW_S - 86400))).select("event_id")


@query("Q10_active_watches", "SELECT event_id FROM events WHERE event_type = 'view'")
def q10_active(spark, d):
    subs = driver_table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "active").otherwise("error").alias("status"))
    return notifications.active_watches(subs).select("event_id")


@query("Q11_refresh_after_batch")
def q11(spark, d):
    """Clustering inside, so rows only; sizes are checked in the tests."""
    m = table(spark, d, "messages")
    out = refresh_after_batch(m, table(spark, d, "features"), table(spark, d, "vectors"), shared_folder(spark, "refreshed"), [YOU], restarts=1)
    return out["priority"].select("email_id", "priority_rank")


# ------------------------------------------------------------------ whole run


@query("R1_user_hooks", "SELECT count(*) AS vectors, CAST(sum(length(text)) AS DOUBLE) AS chars FROM documents")
def r1(spark, d):
    from mailgrain.functions.clean import content_hash, token_estimate
    from mailgrain.operators.vectors import embed

    docs = driver_table(spark, d, "documents").select(
        "doc_id", "text", token_estimate("text").alias("token_count"), content_hash("text").alias("content_hash")
    )
    out = embed(docs, lambda texts: [[float(len(t))] for t in texts], key="doc_id")
    return out.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.col("embedding")[0].cast("double")).alias("chars"))


@query(
    "R2_run_counts",
    """
    SELECT 'threads' AS step, count(DISTINCT thread_id) AS records FROM messages UNION ALL SELECT 'messages', count(*) FROM messages
    UNION ALL SELECT s, count(*) FROM messages, (VALUES ('features'), ('classes'), ('priority'), ('contexts'), ('activity_source')) v(s) WHERE NOT is_sent GROUP BY s
    """,
    ("messages",),
)
def r2_counts(spark, d):
    """Rows of the steps that rules alone decide."""
    counts = _whole_run(spark, d)[0].row_counts().filter(F.col("step").isin("threads", "messages", "features", "classes", "priority", "contexts", "clusters"))
    return counts.withColumn("step", F.when(F.col("step") == "clusters", "activity_source").otherwise(F.col("step")))


@query(
    "R2_served_run",
    "SELECT 'u1' AS user_id, true AS tasks_add_up, true AS completed_kept, true AS page_ranked, true AS projects_listed",
)
def r2_served(spark, d):
    """Inbox, task and project queries on the tables of a run, and a completed task after a second run."""
    run, messages = _whole_run(spark, d)
    t = run.results
    first = t["tasks"].agg(F.min("task_id").alias("task_id")).withColumns({"verb": F.lit("complete"), "at": now()})
    changed = serving.apply_task_actions(t["tasks"], first)
    changed.write.mode("overwrite").parquet(f"{run.root}/_changed")
    spark.read.parquet(f"{run.root}/_changed").write.mode("overwrite").parquet(f"{run.root}/tasks")
    spark.catalog.refreshByPath(f"{run.root}/tasks")
    again = MailboxRun(run.root, [YOU], now(), encoder=_letters, scorer=_stub_scorer, restarts=1, user_id="u1").run(messages, start_from="contexts")
    links = again["tasks"].select("email_id", "project_id").filter("project_id IS NOT NULL")
    page, total = serving.priority_inbox(again["messages"], again["priority"], again["contexts"], again["tasks"], again["projects"], links, limit=10)
    listed, task_total = serving.list_tasks(again["tasks"], user_id="u1", limit=5)
    shown, project_total = serving.list_project_rows(again["projects"], user_id="u1", is_active=True, limit=5)
    counts = serving.task_counts(again["tasks"])
    done = again["tasks"].filter("status = 'completed' AND completed_at IS NOT NULL").agg(F.count(F.lit(1))).scalar()
    ranks = page.agg(F.max("priority_rank") == 10).scalar()
    return counts.select(
        "user_id", (F.col("total") == task_total.select("total").scalar()).alias("tasks_add_up"), (done == 1).alias("completed_kept"),
        ranks.alias("page_ranked"),
        (project_total.select("total").scalar() >= shown.agg(F.count(F.lit(1))).scalar()).alias("projects_listed"))


def _whole_run(spark, d):
    messages = table(spark, d, "messages")
    run = MailboxRun(shared_folder(spark, "mailbox"), [YOU], now(), encoder=_letters, scorer=_stub_scorer, restarts=1, user_id="u1")
    run.run(messages)
    return run, messages


@query("R2_mailbox_run")
def r2(spark, d):
    """All steps on the messages; clustering inside, so rows only."""
    run = MailboxRun(
        shared_folder(spark, "mailbox"), [YOU], now(), encoder=_letters, scorer=_stub_scorer, restarts=1
    )
    run.run(table(spark, d, "messages"))
    return run.row_counts()


def _letters(texts):
    return [[float(t.count(c)) for c in "aeinorst"] for t in texts]
