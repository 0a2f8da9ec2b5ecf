"""The driver's tables seen as mail tables.

Each block is one SELECT that reads driver tables or earlier blocks and is
valid in Spark SQL and in DuckDB, so query and oracle start from the same
rows.  Dates are epoch seconds in columns named ``*_s``; :func:`table` turns
them into timestamps for the operators.  Keyword-bearing subjects, addresses,
labels and body endings are drawn by id from literal lists.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.session import spread

NOW_S = 1705449600  # 2024-01-17 00:00 UTC
YOU = "dana@corp.example"

SENDERS = [
    "alice@partner.example", "bob@partner.example", "alerts@shop.example", "newsletter@weekly.example",
    "orders@store.example", "hello@startup.example", "dana.team@corp.example", "Carol@Client.example",
    "billing@utility.example", "x@no_reply.example", "erin@corp.example", "sales@offers.example.com",
    "judy@client.example", "news@mail.example", "ken@lab.example", "support@tool.example",
    "liam@lab.example", "noreply@social.linkedin.example", "mona@studio.example", "nina@studio.example",
]
SUBJECTS = [
    "Order shipped today", "Weekly digest of news", "Accepted: planning session", "Out of office",
    "Invoice overdue, please pay", "Limited time offer just for you", "Security alert: verify your login",
    "Project kickoff notes", "Re: Project kickoff notes", None, "", "LinkedIn news for you",
    "Lunch, Friday?", "Payment receipt and refund", "Delivery status notification", "Quarterly planning",
]
ENDINGS = [
    " Please confirm by Friday.", " Click unsubscribe to opt out.", " Can you approve the budget?", " FYI only.",
    " The meeting is on Zoom.", " See attached file.", " Your order has shipped, tracking 123.",
    " <p>Hello &amp; <b>welcome</b></p><script>unsubscribe()</script>", "", " Let me know what you think?",
    " The deadline is urgent, could you help?", " Just wanted to let you know.", " Would you acknowledge receipt.",
    " Quoted text\n> earlier words\nOn Monday Ann wrote:\n> more", " Bye\n-- \nDana", " Call me asap please.",
    " {{name}} has a {% if x %}deal{% endif %}", "  two  spaces\tand tab ",
]
LABELS = [
    "Inbox,Unread", "Inbox", "Unread", "Starred,Inbox", "Archived", "Has attachment,Inbox", "Work", None,
    "Inbox,Unread,Important",
]


def _quoted(value: str | None) -> str:
    if value is None:
        return "NULL"
    pieces = [f"'{p}'" for p in value.replace("'", "''").split("\n")]
    out = pieces[0]
    for piece in pieces[1:]:
        out = f"concat({out}, chr(10), {piece})"
    return out.replace("\t", "' || chr(9) || '") if "\t" in value else out


def _pick(index: str, values: list[str | None]) -> str:
    """CASE over ``index`` modulo the list length."""
    cases = " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


def _share(factor: int, modulus: int = 101, key: str = "id") -> str:
    """A pseudo-random double in [0, 1] from a key."""
    return f"CAST(({key} * {factor}) % {modulus} AS DOUBLE) / {modulus - 1}"


_DAY, _HOUR, _MINUTE = "1 + id % 28", "lpad(CAST(id % 24 AS {text}), 2, '0')", "lpad(CAST(id % 60 AS {text}), 2, '0')"
_CLOCK = f"concat({_HOUR}, ':', {_MINUTE}, ':05')".replace("{text}", "VARCHAR(20)")
_DD = "lpad(CAST(1 + id % 28 AS VARCHAR(20)), 2, '0')"

# inserted into documents so that the cleaning steps have work to do
SNIPPETS = [
    "", "\n> quoted line\nplain again\n", "\nOn Monday, Ann wrote:\n\n  \nafter blank\n", "\n-- \nJane Doe\n", " {{ user.name }} {% if a %}b{% endif %} ",
    "\nFrom: a@b.example\nSent: today\nTo: me\n", "\n---- Forwarded message ----\n\nbody of it\n", " “smart” quotes – and … dots\u200b ",
    " On Tue Bob wrote: > inline quote ", "\n\n\n   spaced \t out \n\n", " <% erb %> {# note #} ", "\nBest regards,\nBob\n",
]

BLOCKS = {
    "headers": f"""
        SELECT id,
          CASE id % 6 WHEN 0 THEN concat('"', coalesce(from_name, ''), '" <', upper(from_email), '>')
            WHEN 1 THEN concat(coalesce(from_name, 'No Name'), ' <', from_email, '>') WHEN 2 THEN from_email
            WHEN 3 THEN concat('  ', upper(from_email), ' ') WHEN 4 THEN 'undisclosed recipients'
            ELSE concat('<', from_email, '>') END AS raw_from,
          CASE id % 4 WHEN 0 THEN concat('"Doe, Jane" <jane@x.example>, ', from_email)
            WHEN 1 THEN concat(from_email, '; bob@y.example;; junk') WHEN 2 THEN NULL
            ELSE 'A <a@b.example>,B@c.example' END AS raw_to,
          CASE id % 7 WHEN 0 THEN concat('Mon, ', {_DAY}, ' Jan 2024 ', {_CLOCK}, ' +0000')
            WHEN 1 THEN concat({_DAY}, ' Jan 2024 ', {_CLOCK}, ' -0800 (PST)')
            WHEN 2 THEN concat('2024-01-', {_DD}, ' ', {_CLOCK}, '+02:00')
            WHEN 3 THEN concat('2024-01-', {_DD}, 'T', {_CLOCK}, 'Z')
            WHEN 4 THEN concat('2024-01-', {_DD}, '  ', {_CLOCK}) WHEN 5 THEN concat('2024-01-', {_DD}, 'T', {_CLOCK})
            ELSE 'some day' END AS raw_date,
          CASE id % 4 WHEN 0 THEN 'Inbox,"[Big]/AI, Marketing",Unread' WHEN 1 THEN 'sENT, Work' WHEN 2 THEN NULL
            ELSE concat('Long', chr(13), chr(10), ' label , ,x') END AS raw_labels,
          CASE id % 3 WHEN 0 THEN concat('<', message_id, '@x> bare@y.example junk') WHEN 1 THEN NULL
            ELSE concat('<a@b>', chr(10), ' <', message_id, '@x>') END AS raw_refs
        FROM messages""",
    "doc_text": f"""
        SELECT doc_id, concat(substring(text, 1, 200), {_pick("doc_id", SNIPPETS)}, substring(text, 201)) AS text
        FROM documents""",
    "messages": f"""
        SELECT conv_id * 100 + turn AS id, conv_id, concat('m', conv_id, '-', turn) AS message_id,
          concat('t', conv_id) AS thread_id,
          CASE WHEN turn > 0 THEN concat('m', conv_id, '-', turn - 1) END AS in_reply_to,
          1704067200 + conv_id * 10007 + turn * (600 + (conv_id % 5) * 20000) AS date_s,
          CASE WHEN role = 'assistant' THEN '{YOU}' WHEN role = 'system' THEN 'noreply@system.example'
            ELSE {_pick("conv_id", SENDERS)} END AS from_email,
          CASE WHEN role = 'assistant' THEN 'Dana' WHEN conv_id % 3 = 0 THEN NULL
            ELSE concat('Person ', conv_id % 20) END AS from_name,
          CASE WHEN role = 'assistant' THEN split({_pick("conv_id", SENDERS)}, ',')
            WHEN (conv_id + turn) % 11 = 0 THEN NULL
            WHEN (conv_id + turn) % 7 = 0 THEN split('{YOU},erin@corp.example', ',')
            ELSE split('{YOU}', ',') END AS to_emails,
          CASE WHEN conv_id % 6 = 2 THEN split('frank@corp.example', ',')
            WHEN (conv_id + turn) % 13 = 0 THEN split('frank@corp.example,Gina@Corp.example', ',') END AS cc_emails,
          {_pick("conv_id * 3 + turn", SUBJECTS)} AS subject,
          CASE WHEN (conv_id * 100 + turn) % 29 = 0 THEN NULL
            ELSE concat(text, {_pick("conv_id * 5 + turn", ENDINGS)}) END AS body_text,
          split({_pick("conv_id + turn * 2", LABELS)}, ',') AS labels,
          (conv_id + turn) % 5 = 0 AS has_attachments,
          CASE WHEN (conv_id + turn) % 5 = 0 THEN CAST(conv_id % 3 AS INT) END AS attachment_count,
          role = 'assistant' AS is_sent
        FROM conversations""",
    "order_mail": f"""
        SELECT o_orderkey AS id, concat('o', o_orderkey) AS message_id, concat('t', o_custkey) AS thread_id,
          CASE WHEN o_orderkey % 3 = 1 THEN concat('o', o_orderkey - 1) END AS in_reply_to,
          EPOCH_SECONDS(o_orderdate) + o_orderkey % 86400 AS date_s,
          CASE WHEN o_orderkey % 3 = 1 THEN '{YOU}' ELSE concat('c', o_custkey % 997, '@',
            CASE o_custkey % 5 WHEN 0 THEN 'mail.example' WHEN 1 THEN 'shop.example' ELSE 'people.example' END)
            END AS from_email,
          CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('Customer ', o_custkey % 997) END AS from_name,
          CASE WHEN o_orderkey % 3 = 1 THEN split(concat('c', o_custkey % 997, '@people.example'), ',')
            ELSE split('{YOU}', ',') END AS to_emails,
          CASE WHEN o_orderkey % 10 = 7 THEN split('frank@corp.example', ',') END AS cc_emails,
          {_pick("o_orderkey", SUBJECTS)} AS subject,
          concat('Order ', o_orderkey, ' with priority ', o_orderpriority, {_pick("o_orderkey", ENDINGS[:13])}) AS body_text,
          split({_pick("o_orderkey", LABELS)}, ',') AS labels,
          o_orderstatus = 'P' AS has_attachments, CAST(o_orderkey % 2 AS INT) AS attachment_count,
          o_orderkey % 3 = 1 AS is_sent
        FROM orders""",
    "labelled": f"""
        SELECT m.*,
          CASE WHEN is_sent THEN 'COMPOSED' WHEN id % 6 = 0 THEN 'REPLIED' WHEN id % 6 = 1 THEN 'ARCHIVED'
            WHEN id % 6 = 2 THEN 'IGNORED' WHEN id % 6 = 3 THEN 'STARRED' ELSE 'PENDING' END AS action,
          CASE WHEN NOT is_sent AND id % 6 = 0 THEN 'SAME_DAY' WHEN NOT is_sent AND id % 6 IN (1, 2) THEN 'NEVER' END AS timing,
          CASE WHEN (NOT is_sent AND id % 6 = 0) OR (is_sent AND id % 4 = 0)
            THEN CAST((id * 977) % 200000 + 1 AS INT) END AS response_time_seconds
        FROM messages m""",
    "features": f"""
        SELECT id AS email_id, {_share(37)} AS relationship_strength, {_share(53)} AS user_replied_to_sender_rate,
          CAST((id * 11) % 200 AS DOUBLE) / 4 AS avg_response_time_hours, id % 30 + 1 AS emails_from_sender_all,
          {_share(17)} AS sender_replies_to_you_rate, id % 4 = 0 AS is_service_email, {_share(29)} AS service_importance,
          id % 3 = 0 AS has_unsubscribe_link, id % 5 = 0 AS from_common_service_domain,
          {_pick("id", ["transactional", "notification", "newsletter", "marketing", "social", None, None])} AS service_type,
          CAST(id % 24 AS INT) AS hour_of_day, CAST(id % 7 AS INT) AS day_of_week,
          id % 24 >= 9 AND id % 24 < 17 AND id % 7 < 5 AS is_business_hours, id % 7 >= 5 AS is_weekend,
          {_share(61)} AS urgency_score
        FROM labelled WHERE NOT is_sent""",
    "contacts": f"""
        SELECT from_email AS email, max(from_name) AS name, from_email = '{YOU}' AS is_you, count(*) AS emails_from,
          count(*) % 7 AS emails_to,
          CASE count(*) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 END AS reply_rate,
          count(*) % 5 = 0 AS is_important_sender
        FROM messages GROUP BY from_email""",
    "classes": """
        SELECT email_id, CASE email_id % 3 WHEN 0 THEN 'needs_llm' WHEN 1 THEN 'ai_full' ELSE 'human_required' END
            AS predicted_handleability,
          CASE WHEN email_id % 3 = 0 THEN CAST(email_id % 5 + 1 AS INT) END AS llm_priority,
          email_id % 2 = 0 AS has_request, email_id % 5 = 0 AS has_deadline, email_id % 7 = 0 AS has_approval
        FROM features""",
    "model_labels": f"""
        SELECT email_id,
          {_pick("email_id", ["reply", "task", "decision", "approval", "fyi", "none"])} AS action_type,
          {_pick("email_id * 3", ["immediate", "today", "this_week", "whenever", "none", None, "someday"])} AS urgency,
          CASE WHEN email_id % 4 = 0 THEN NULL ELSE concat('Line ', email_id) END AS one_liner
        FROM classes WHERE email_id % 2 = 0""",
    "vectors": """
        SELECT m.id AS email_id, e.embedding, e.label
        FROM labelled m JOIN (SELECT count(*) AS n FROM embeddings) c ON c.n > 0
          JOIN embeddings e ON e.vec_id = (m.id * 7 + 3) % c.n
        WHERE NOT m.is_sent""",
    "assignments": """
        SELECT f.email_id, CAST(f.email_id % 15 AS INT) AS people_cluster_id,
          CASE WHEN f.email_id % 17 = 0 AND v.label IS NOT NULL THEN -1 ELSE v.label END AS content_cluster_id,
          CAST(f.email_id % 8 AS INT) AS behavior_cluster_id, CAST((f.email_id * 3) % 8 AS INT) AS service_cluster_id,
          CAST(f.email_id % 6 AS INT) AS temporal_cluster_id
        FROM features f LEFT JOIN vectors v ON v.email_id = f.email_id""",
    "priority": f"""
        SELECT email_id, {_share(13, key="email_id")} AS sender_novelty,
          CAST((email_id * 71) % 1000 AS DOUBLE) / 1000 AS priority_score,
          (999 - (email_id * 71) % 1000) * 1000000 + email_id AS priority_rank
        FROM features WHERE email_id % 10 <> 3""",
    "contexts": f"""
        SELECT l.id AS email_id, l.from_email AS sender_email, CAST(l.id % 2 AS DOUBLE) AS sender_importance,
          {_share(19, key="l.id")} AS sender_reply_rate, l.id % 9 AS thread_length, l.id % 3 = 0 AS is_business_hours,
          CAST({NOW_S} - l.date_s AS DOUBLE) / 3600 AS age_hours, {_share(23, key="l.id")} AS people_score,
          {_share(31, key="l.id")} AS temporal_score, {_share(43, key="l.id")} AS relationship_score,
          {_share(47, key="l.id")} AS overall_priority
        FROM labelled l WHERE NOT l.is_sent AND l.id % 8 <> 1""",
    "tasks": f"""
        SELECT concat('task_', id) AS task_id, id AS email_id, coalesce(subject, 'Task from email') AS description,
          {_pick("id", ["review", "send", "decision", "other", "follow_up", "unheard"])} AS task_type,
          {_pick("id", ["trivial", "quick", "medium", None, "bogus"])} AS complexity,
          CASE WHEN id % 19 = 0 THEN NULL ELSE {_share(41)} + (CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END) END AS urgency_score,
          {_pick("id", ["pending", "in_progress", "pending", "completed", "pending", "dismissed", "pending"])} AS status,
          from_email AS assigned_by, concat('u', id % 3) AS user_id, id % 5 AS project_id, date_s AS created_s,
          CAST(NULL AS BIGINT) AS completed_s
        FROM labelled WHERE NOT is_sent AND id % 3 <> 0""",
    "projects": """
        SELECT conv_id AS project_id, concat('Project ', conv_id) AS name, min(from_email) AS owner_email,
          CASE WHEN conv_id % 3 = 0 THEN 'real_person_thread' ELSE 'manual' END AS detected_from,
          concat('u', conv_id % 3) AS user_id, conv_id % 4 <> 0 AS is_active, CAST(conv_id % 8 AS INT) AS priority,
          CASE WHEN conv_id % 9 <> 0 THEN max(date_s) END AS activity_s, min(date_s) AS created_s
        FROM messages GROUP BY conv_id""",
    "links": "SELECT id AS email_id, conv_id - id % 2 AS project_id FROM messages WHERE id % 3 <> 1",
    "meta": f"""
        SELECT dimension, cluster_id, count(*) AS size, CAST((cluster_id * 13 + 40) % 101 AS DOUBLE) AS pct_replied,
          CAST((cluster_id + 2) % 5 AS DOUBLE) / 4 AS avg_response_time_hours,
          CASE WHEN cluster_id % 3 = 1 THEN NULL ELSE {_share(7, key="(cluster_id + 3)")} END AS coherence_score,
          CASE WHEN cluster_id % 2 = 0 THEN concat(dimension, ' ', cluster_id) END AS auto_label,
          cluster_id % 3 = 0 AND dimension = 'content' AS is_project,
          CASE WHEN cluster_id % 3 = 0 AND dimension = 'content' THEN CASE cluster_id % 2 WHEN 0 THEN 'active' ELSE 'stale' END
            END AS project_status,
          min(email_id) AS representative_email_id, CAST(NULL AS BIGINT) AS participant_count,
          CASE WHEN cluster_id % 4 <> 1 THEN 1704067200 + cluster_id * 86400 END AS activity_s,
          concat('u', cluster_id % 2) AS user_id
        FROM (
          SELECT 'content' AS dimension, content_cluster_id AS cluster_id, email_id FROM assignments
            WHERE content_cluster_id IS NOT NULL
          UNION ALL SELECT 'people' AS dimension, people_cluster_id AS cluster_id, email_id FROM assignments
          UNION ALL SELECT 'temporal' AS dimension, temporal_cluster_id AS cluster_id, email_id FROM assignments
        ) t GROUP BY dimension, cluster_id""",
    "log": """
        SELECT concat('e', event_id) AS event_id, concat('t', user_id) AS thread_id, event_id + 1 AS seq,
          EPOCH_MILLIS(ts) AS ts, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'system' END AS actor,
          CASE event_type WHEN 'click' THEN 'ui.action' WHEN 'view' THEN 'ui.block' WHEN 'error' THEN 'system.error'
            WHEN 'purchase' THEN 'tool.call' ELSE 'session.start' END AS type,
          props AS payload, concat('c', user_id, '-', event_id % 4) AS correlation_id,
          concat('org', user_id % 2) AS org_id
        FROM events""",
    "agent_log": """
        SELECT concat('c', conv_id, '-', turn) AS correlation_id, 'agent' AS actor, 'turn.agent.open' AS type,
          (conv_id * 1000 + turn * 10) AS ts, '{}' AS payload FROM conversations WHERE role = 'assistant'
        UNION ALL
        SELECT concat('c', conv_id, '-', turn - turn % 2 + 1) AS correlation_id, 'agent' AS actor,
          'assistant.text.delta' AS type, (conv_id * 1000 + turn * 10 + 1) AS ts, '{}' AS payload FROM conversations
        UNION ALL
        SELECT concat('c', conv_id, '-', turn) AS correlation_id, 'agent' AS actor, 'turn.agent.close' AS type,
          (conv_id * 1000 + turn * 10 + 7) AS ts,
          CASE conv_id % 3 WHEN 0 THEN '{"reason":"complete"}' WHEN 1 THEN '{"reason":"cancelled"}'
            ELSE '{"reason":"error"}' END AS payload
        FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 5 <> 3""",
    "turns": """
        SELECT concat('c', conv_id, '-', turn) AS correlation_id, concat('t', conv_id) AS thread_id,
          concat('s', conv_id % 10) AS session_id, concat('u', conv_id % 7) AS user_id, concat('org', conv_id % 2) AS org_id,
          conv_id * 1000 + turn AS ts, CASE WHEN turn % 4 = 2 THEN 'voice' ELSE 'text' END AS input_type, text,
          CAST(turn AS DOUBLE) / 8 AS confidence, CAST(turn * 100 AS INT) AS duration_ms
        FROM conversations WHERE role = 'user'""",
    "sessions": """
        SELECT concat('s', user_id, '-', day) AS session_id, concat('t', user_id) AS thread_id,
          concat('u', user_id % 11) AS user_id, CASE day % 3 WHEN 0 THEN 'active' ELSE 'paused' END AS status,
          CAST(floor(CAST(min(ms) AS DOUBLE) / 1000) AS BIGINT) AS started_s, CAST(NULL AS BIGINT) AS ended_s
        FROM (SELECT user_id, EPOCH_MILLIS(ts) AS ms,
                CAST(floor(CAST(EPOCH_MILLIS(ts) AS DOUBLE) / 86400000) AS BIGINT) AS day FROM events) d
        GROUP BY user_id, day""",
}

DRIVER_TABLES = ["conversations", "embeddings", "events", "orders", "documents", "pages"]
# worked on text by text: worth a task per core even when it is one small file
TEXT_TABLES = ["documents", "pages", "orders"]
TIMESTAMPS = {
    "date_s": "date_parsed", "created_s": "created_at", "completed_s": "completed_at", "started_s": "started_at",
    "ended_s": "ended_at",
}
ACTIVITY_NAME = {"projects": "last_activity", "meta": "last_activity_at"}



def _needed(name: str, seen: list[str]) -> list[str]:
    for other in BLOCKS:
        if other != name and re.search(rf"(FROM|JOIN)\s+{other}\b", BLOCKS[name]):
            _needed(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _translated(sql: str, engine: str) -> str:
    if engine == "spark":
        sql = re.sub(r"EPOCH_SECONDS\((\w+)\)", r"unix_timestamp(CAST(\1 AS TIMESTAMP))", sql)
        return re.sub(r"EPOCH_MILLIS\((\w+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", sql)
    sql = re.sub(r"EPOCH_SECONDS\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)", sql)
    return re.sub(r"EPOCH_MILLIS\((\w+)\)", r"epoch_ms(\1)", sql)


def ctes(*names: str) -> str:
    """``name AS (...)`` list in DuckDB SQL for the blocks and what they read."""
    order: list[str] = []
    for name in names:
        _needed(name, order)
    return ", ".join(f"{n} AS ({_translated(BLOCKS[n], 'duckdb')})" for n in order)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A block as a Spark frame, epoch columns turned into timestamps."""
    order = _needed(name, [])
    text = ", ".join(f"{n} AS ({_translated(BLOCKS[n], 'spark')})" for n in order)
    used = [t for t in DRIVER_TABLES if re.search(rf"(FROM|JOIN)\s+{t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    frames = {t: driver_table(spark, sf_dir, t) for t in used}
    df = spark.sql(f"WITH {text} SELECT * FROM {name}", **frames)
    if "activity_s" in df.columns:
        df = df.withColumnRenamed("activity_s", "_a_s").withColumn(
            ACTIVITY_NAME[name], F.timestamp_seconds("_a_s")
        ).drop("_a_s")
    for old, new in TIMESTAMPS.items():
        if old in df.columns:
            df = df.withColumn(new, F.timestamp_seconds(old)).drop(old)
    if name in ("messages", "order_mail", "labelled"):
        df = df.drop("conv_id")
    if name in ("messages", "order_mail"):
        empty = F.lit(None)
        df = df.withColumn("action", empty.cast("string")).withColumn("timing", empty.cast("string"))
        df = df.withColumn("response_time_seconds", empty.cast("int"))
    if name in ("messages", "order_mail", "labelled"):
        df = df.withColumn("body_preview", F.substring("body_text", 1, 200))
    return df


def now() -> object:
    return F.timestamp_seconds(F.lit(NOW_S))


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Engine-neutral values: epoch seconds, joined arrays, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "timestamp":
            c = F.unix_timestamp(c)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)
