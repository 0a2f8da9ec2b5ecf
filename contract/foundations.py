"""Queries for sources, table upkeep, normalisation and cleaning (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapter import driver_table, present, table
from contract.registry import query
from mailgrain.functions import clean as C
from mailgrain.functions import html as H
from mailgrain.functions import normalize as N
from mailgrain.operators import tables as T
from mailgrain.session import shared_folder
from mailgrain.sources import archive, documents
from mailgrain.streaming.ingest import embedding_inputs

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"


def strip_sql(c: str) -> str:
    return STRIP % c


# ------------------------------------------------------------------ sources


@query(
    "A1_read_mail_archive",
    """
    SELECT concat('<', message_id, '@x>') AS message_id, thread_id, coalesce(in_reply_to, '') AS in_reply_to,
      coalesce(array_to_string(labels, '|'), '') AS labels, from_email AS "from", coalesce(subject, '') AS subject,
      md5(concat(regexp_replace(coalesce(replace(body_text, chr(10), ' '), ''), '^From ', '>From '), chr(10))) AS body_md5, id % 3 = 0 AS has_attachments
    FROM messages
    """,
    ("messages",),
)
def a1(spark, d):
    """Messages written out as mbox text, then read back as an archive."""
    m = table(spark, d, "messages")
    # one-line bodies; a leading ``From `` is escaped as archives do
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body_text", F.lit("")), "\n", " "), "^From ", ">From ")
    head = F.concat_ws(
        "\n",
        F.lit("From sender Mon Jan  1 00:00:00 2024"),
        F.concat(F.lit("Message-ID: <"), "message_id", F.lit("@x>")),
        F.concat(F.lit("X-GM-THRID: "), "thread_id"),
        F.concat(F.lit("In-Reply-To: "), F.coalesce("in_reply_to", F.lit(""))),
        F.concat(F.lit("X-Gmail-Labels: "), F.coalesce(F.array_join("labels", ","), F.lit(""))),
        F.concat(F.lit("From: "), "from_email"),
        F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))),
    )
    simple = F.concat(head, F.lit("\nContent-Type: text/plain; charset=utf-8\n\n"), body, F.lit("\n"))
    mixed = F.concat(
        head,
        F.lit("\nContent-Type: multipart/mixed; boundary=zz\n\n--zz\nContent-Type: text/plain; charset=utf-8\n\n"),
        body,
        F.lit("\n\n--zz\nContent-Type: application/pdf; name=a.pdf\nContent-Disposition: attachment\n\nJVBERg==\n--zz--\n"),
    )
    folder = shared_folder(spark, "archive")
    m.select(F.when(F.col("id") % 3 == 0, mixed).otherwise(simple).alias("value")).write.text(folder)
    rows = archive.read_mail_archive(spark, folder).filter(F.col("error").isNull())
    return rows.select(
        "message_id", "thread_id", "in_reply_to", F.array_join("labels", "|").alias("labels"), "from", "subject",
        F.md5("body").alias("body_md5"), "has_attachments",
    )


@query(
    "A1_archive_offsets",
    "SELECT count(*) AS n, CAST(sum(size + 1) - max(size + 1) AS BIGINT) >= 0 AS ordered, CAST(sum(size) AS BIGINT) AS bytes, 0 AS gaps "
    "FROM (SELECT strlen(concat('Subject: ', id, chr(10), chr(10), regexp_replace(coalesce(replace(body_text, chr(10), ' '), 'x'), '^From ', '>From '), chr(10))) AS size FROM messages)",
    ("messages",),
)
def a1_offsets(spark, d):
    """One archive file read in small splits: positions must not overlap and sizes must add up."""
    m = table(spark, d, "messages")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body_text", F.lit("x")), "\n", " "), "^From ", ">From ")
    folder = shared_folder(spark, "offsets")
    m.select(
        F.concat(F.lit("From a b\nSubject: "), F.col("id"), F.lit("\n\n"), body, F.lit("\n")).alias("value")
    ).write.text(folder)
    rows = archive.read_mail_archive(spark, folder, with_offsets=True).select("mbox_offset", "raw_size_bytes")
    ordered = F.count_if(F.col("mbox_offset") < 0) == 0
    # every message but the first of a file starts where another one ends
    ends = rows.select((F.col("mbox_offset") + F.col("raw_size_bytes") + 1).alias("mbox_offset")).distinct()
    loose = rows.filter("mbox_offset > 0").join(ends, "mbox_offset", "left_anti").agg(F.count(F.lit(1)))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), ordered.alias("ordered"), F.sum("raw_size_bytes").cast("bigint").alias("bytes")
    ).withColumn("gaps", loose.scalar().cast("int"))


def _shapes(spark, d):
    """Archive of HTML only, alternatives, a text attachment, and a named inline image, by id."""
    m = table(spark, d, "messages")
    number = F.col("id").cast("string")

    def mail(kind, *parts):
        head = F.concat(F.lit("From a b\nMessage-ID: "), number, F.lit(f"\nContent-Type: multipart/{kind}; boundary=zz\n"))
        return F.concat(head, *[x for p in parts for x in (F.lit("\n--zz\n"), p)], F.lit("\n--zz--\n"))

    def part(kind, before, after="", more=""):
        return F.concat(F.lit(f"Content-Type: {kind}\n{more}\n{before}"), number, F.lit(after))

    html = F.concat(F.lit("From a b\nMessage-ID: "), number, F.lit("\nContent-Type: text/html\n\n<p>"), number, F.lit("</p>\n"))
    text = (
        F.when(F.col("id") % 4 == 0, html)
        .when(F.col("id") % 4 == 1, mail("alternative", part("text/plain", "plain "), part("text/html", "<b>", "</b>")))
        .when(F.col("id") % 4 == 2, mail("mixed", part("text/plain", "body "), part("text/plain", "secret ", more="Content-Disposition: attachment\n")))
        .otherwise(mail("mixed", part("text/html", "<i>", "</i>"), part("image/png; name=x.png", "iVBOR")))
    )
    folder = shared_folder(spark, "shapes")
    m.select(text.alias("value")).write.text(folder)
    return archive.read_mail_archive(spark, folder)


@query(
    "B13_message_bodies",
    """
    SELECT CAST(id AS VARCHAR) AS message_id,
      CASE id % 4 WHEN 0 THEN concat('<p>', id, '</p>') WHEN 1 THEN concat('plain ', id) WHEN 2 THEN concat('body ', id) ELSE concat('<i>', id, '</i>') END AS body,
      CASE id % 4 WHEN 0 THEN concat('<p>', id, '</p>') WHEN 1 THEN concat('<b>', id, '</b>') WHEN 3 THEN concat('<i>', id, '</i>') END AS body_html
    FROM messages
    """,
    ("messages",),
)
def b13(spark, d):
    trimmed = {c: F.regexp_replace(c, r"\n+$", "") for c in ("body", "body_html")}
    return _shapes(spark, d).withColumns(trimmed).select("message_id", "body", "body_html")


@query("B14_has_attachment", "SELECT CAST(id AS VARCHAR) AS message_id, id % 4 >= 2 AS has_attachments FROM messages", ("messages",))
def b14(spark, d):
    return _shapes(spark, d).select("message_id", "has_attachments")


@query(
    "A2_read_message_jsonl",
    "SELECT message_id, subject, coalesce(len(labels), 0) AS n_labels FROM messages",
    ("messages",),
)
def a2(spark, d):
    folder = shared_folder(spark, "jsonl")
    table(spark, d, "messages").select("message_id", "subject", "labels").write.json(folder)
    rows = documents.read_message_jsonl(spark, folder)
    return rows.select("message_id", "subject", F.coalesce(F.size("labels"), F.lit(0)).cast("bigint").alias("n_labels"))


@query(
    "A3_parse_api_messages",
    f"""
    SELECT concat('<', message_id, '@x>') AS message_id, thread_id, subject, from_email,
      CASE WHEN from_name = '' THEN NULL ELSE from_name END AS from_name, to_emails, date_parsed, body_md5, html_md5,
      has_attachments
    FROM (
      SELECT m.message_id, m.thread_id, coalesce(subject, '') AS subject, lower(from_email) AS from_email,
        coalesce(from_name, 'No Name') AS from_name, concat('jane@x.example|', lower(from_email)) AS to_emails,
        date_s AS date_parsed, md5(coalesce(body_text, '')) AS body_md5,
        md5(concat('<p>', subject, '</p>')) AS html_md5, id % 3 = 0 AS has_attachments
      FROM messages m)
    """,
    ("messages",),
)
def a3(spark, d):
    """Provider documents built from the messages, with parts three levels deep."""
    m = table(spark, d, "messages")

    def b64url(c):
        return F.rtrim(F.translate(F.regexp_replace(F.base64(c.cast("binary")), r"\s", ""), "+/", "-_"), F.lit("="))

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    none = F.lit(None).cast("string")

    def part(mime, data, filename=none):
        return F.struct(
            F.lit(mime).alias("mimeType"), filename.alias("filename"), F.struct(data.alias("data")).alias("body")
        )

    headers = F.array(
        header("Message-ID", F.concat(F.lit("<"), "message_id", F.lit("@x>"))),
        header("SUBJECT", F.coalesce("subject", F.lit(""))),
        header("From", F.concat(F.lit('"'), F.coalesce("from_name", F.lit("No Name")), F.lit('" <'), "from_email", F.lit(">"))),
        header("To", F.concat(F.lit('"Doe, Jane" <jane@x.example>, '), F.col("from_email"))),
        header("Date", F.date_format("date_parsed", "d MMM yyyy HH:mm:ss Z")),
    )
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(
            part("text/plain", b64url(F.coalesce("body_text", F.lit("")))),
            part("text/html", b64url(F.concat(F.lit("<p>"), F.coalesce("subject", F.lit("")), F.lit("</p>")))),
        ).alias("parts"),
    )
    attached = part("application/pdf", none, F.when(F.col("id") % 3 == 0, F.lit("a.pdf")).otherwise(F.lit("")))
    related = F.struct(F.lit("multipart/related").alias("mimeType"), F.array(inner).alias("parts"))
    payload = F.struct(
        F.lit("multipart/mixed").alias("mimeType"), headers.alias("headers"),
        F.array(F.struct(*[F.coalesce(related[f], F.lit(None)).alias(f) if f in ("mimeType", "parts") else F.lit(None).alias(f) for f in ("mimeType", "parts")])).alias("parts"),
    )
    extra = F.to_json(attached)
    doc = F.to_json(F.struct(F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), payload.alias("payload")))
    # the attachment part is put in front of the nested parts
    doc = F.regexp_replace(doc, r'("parts":\[)(\{"mimeType":"multipart/related")', F.concat(F.lit("$1"), F.regexp_replace(extra, r"\$", ""), F.lit(",$2")))
    parsed = documents.parse_api_messages(m.select(doc.alias("json")))
    return present(parsed.select(
        "message_id", "thread_id", "subject", "from_email", "from_name", "to_emails", "date_parsed",
        F.md5("body_text").alias("body_md5"), F.md5("body_html").alias("html_md5"), "has_attachments",
    ))


@query(
    "A3_deep_parts",
    "SELECT id, concat('level ', id % 30 + 1) AS body_text, concat('<p>', id % 30 + 1, '</p>') AS body_html, id % 3 = 0 AS has_attachments FROM messages",
    ("messages",),
)
def a3_deep(spark, d):
    """Plain text, HTML and attachment in the innermost of 1 to 30 nested levels."""
    depth = (F.col("id") % 30 + 1).cast("int")

    def data(text):
        return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")

    def leaf(mime, text, name):
        return F.format_string('{"mimeType":"%s","filename":"%s","body":{"data":"%s"}}', F.lit(mime), name, data(text))

    level = depth.cast("string")
    blank = F.lit("")
    parts = F.concat_ws(
        ",", leaf("text/plain", F.concat(F.lit("level "), level), blank), leaf("text/html", F.concat(F.lit("<p>"), level, F.lit("</p>")), blank),
        leaf("application/pdf", blank, F.when(F.col("id") % 3 == 0, "a.pdf").otherwise("")))
    opened = F.repeat(F.lit('{"mimeType":"multipart/mixed","parts":['), depth)
    doc = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","payload":'), opened, parts, F.repeat(F.lit("]}"), depth), F.lit("}"))
    parsed = documents.parse_api_messages(table(spark, d, "messages").select(doc.alias("json")))
    return parsed.select(F.col("provider_id").cast("long").alias("id"), "body_text", "body_html", "has_attachments")


@query(
    "B15_api_to_messages",
    """
    SELECT concat('<', message_id, '@x>') AS message_id, CASE WHEN id % 5 = 0 THEN '<parent@x>' END AS in_reply_to, lower(from_email) AS from_email,
      concat('a@b.example|', lower(from_email)) AS to_emails, trim(substring(body, 1, 200)) AS body_preview,
      CAST(len(regexp_extract_all(body, '[^ ]+')) AS INT) AS word_count, id % 4 = 0 AS is_sent, id % 4 = 0 AS has_labels
    FROM (SELECT *, concat('Note ', id, ' of thread ', thread_id, repeat(' and more', CAST(id % 40 AS INT))) AS body FROM messages)
    """,
    ("messages",),
)
def b15_api(spark, d):
    """API documents all the way to the message table."""
    m = table(spark, d, "messages")

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    body = F.concat(F.lit("Note "), F.col("id").cast("string"), F.lit(" of thread "), F.col("thread_id"), F.repeat(F.lit(" and more"), (F.col("id") % 40).cast("int")))
    headers = F.array(
        header("Message-ID", F.concat(F.lit("<"), "message_id", F.lit("@x>"))), header("From", F.col("from_email")),
        header("To", F.concat(F.lit("a@b.example, "), F.col("from_email"))),
        header("In-Reply-To", F.when(F.col("id") % 5 == 0, "<parent@x>").otherwise("")),
    )
    payload = F.struct(
        F.lit("text/plain").alias("mimeType"), headers.alias("headers"),
        F.struct(F.regexp_replace(F.base64(body.cast("binary")), r"\s", "").alias("data")).alias("body"))
    labels = F.when(F.col("id") % 4 == 0, F.array(F.lit("SENT"), F.lit("IMPORTANT"))).otherwise(F.array().cast("array<string>"))
    doc = F.to_json(F.struct(F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), labels.alias("labelIds"), payload.alias("payload")))
    out = documents.api_to_messages(documents.parse_api_messages(m.select(doc.alias("json"))))
    return present(out.select(
        "message_id", "in_reply_to", "from_email", "to_emails", F.trim("body_preview").alias("body_preview"), "word_count", "is_sent",
        F.col("labels").isNotNull().alias("has_labels")))


# ------------------------------------------------------------------ tables


@query(
    "A4_insert_new",
    "SELECT message_id, id FROM messages WHERE id % 4 <> 0",
    ("messages",),
)
def a4(spark, d):
    m = table(spark, d, "messages").select("message_id", "id")
    copies = m.unionByName(m.withColumn("id", F.col("id") + 1000000)).unionByName(
        m.limit(0).withColumn("message_id", F.lit(""))
    )
    return T.insert_new(m.filter("id % 4 = 0"), copies, "message_id", [F.asc("id")])


@query(
    "A4_insert_counts",
    "SELECT 2 * count(*) AS total, count(*) FILTER (id % 4 <> 0) AS inserted, 2 * count(*) - count(*) FILTER (id % 4 <> 0) AS skipped FROM messages",
    ("messages",),
)
def a4_counts(spark, d):
    m = table(spark, d, "messages").select("message_id", "id")
    return T.insert_counts(m.filter("id % 4 = 0"), m.unionByName(m), "message_id")


@query(
    "A5_upsert",
    """
    SELECT task_id, CASE WHEN email_id % 2 = 0 THEN 'done' ELSE status END AS status, description FROM tasks
      WHERE email_id % 5 <> 0
    UNION ALL SELECT task_id, 'done', description FROM tasks WHERE email_id % 5 = 0 AND email_id % 2 = 0
    """,
    ("tasks",),
)
def a5(spark, d):
    t = table(spark, d, "tasks")
    change = t.filter("email_id % 2 = 0").select("task_id", F.lit("done").alias("status"), "description")
    return T.upsert(t.filter("email_id % 5 <> 0").select("task_id", "status", "description"), change, ["task_id"], ["status"])


@query("A6_refresh", "SELECT thread_id, count(*) AS n FROM messages GROUP BY thread_id", ("messages",))
def a6(spark, d):
    counts = table(spark, d, "messages").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    folder = shared_folder(spark, "refresh")
    T.refresh(counts, folder)
    return T.refresh(counts, folder)


@query(
    "A7_archive_profile",
    "SELECT count(*) AS total_emails, count(*) FILTER (coalesce(body_text, '') <> '') AS emails_with_body, "
    "count(*) FILTER (has_attachments) AS emails_with_attachments FROM order_mail",
    ("order_mail",),
)
def a7(spark, d):
    return T.archive_profile(table(spark, d, "order_mail"))


@query(
    "A7_label_histogram",
    "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM order_mail) GROUP BY label ORDER BY n DESC, label LIMIT 50",
    ("order_mail",),
)
def a7_labels(spark, d):
    return T.label_histogram(table(spark, d, "order_mail"))


@query(
    "A8_derived_table_status",
    """
    SELECT (SELECT count(*) FROM messages) AS emails, (SELECT count(*) FROM messages WHERE is_sent) AS sent_emails,
      (SELECT count(*) FROM messages WHERE NOT is_sent) AS received_emails, (SELECT count(*) FROM features) AS features,
      (SELECT count(*) FROM vectors) AS embeddings, (SELECT count(*) FROM contacts) AS users,
      (SELECT count(*) FROM classes WHERE predicted_handleability = 'needs_llm') AS needs_llm,
      (SELECT count(*) FROM model_labels) AS llm_classification,
      greatest(0, (SELECT count(*) FROM classes WHERE predicted_handleability = 'needs_llm')
        - (SELECT count(*) FROM model_labels)) AS llm_remaining
    """,
    ("messages", "features", "vectors", "contacts", "classes", "model_labels"),
)
def a8(spark, d):
    t = {name: table(spark, d, name) for name in ("messages", "features", "vectors", "contacts", "classes", "model_labels")}
    derived = {"features": t["features"], "embeddings": t["vectors"], "users": t["contacts"]}
    return T.derived_table_status(spark, derived, t["messages"], t["classes"], t["model_labels"])


@query(
    "A9_pending_rows",
    "SELECT f.email_id FROM features f WHERE f.email_id NOT IN (SELECT email_id FROM vectors) ORDER BY f.email_id LIMIT 1000",
    ("features", "vectors"),
)
def a9(spark, d):
    return T.pending_rows(table(spark, d, "features").select("email_id"), table(spark, d, "vectors"), "email_id", limit=1000)


@query(
    "A10_constraint_report",
    """
    SELECT * FROM (
      SELECT 'urgency_score in [0,1]' AS rule, count(*) FILTER (urgency_score < 0 OR urgency_score > 1) AS violations FROM tasks
      UNION ALL SELECT 'task_type known', count(*) FILTER (task_type = 'unheard') FROM tasks
      UNION ALL SELECT 'status known', 0 FROM tasks WHERE task_id = (SELECT min(task_id) FROM tasks)
      UNION ALL SELECT 'description 1..1000 chars', count(*) FILTER (description = '') FROM tasks
      UNION ALL SELECT 'complexity known', count(*) FILTER (complexity = 'bogus') FROM tasks
      UNION ALL SELECT 'task_id unique', 0 FROM tasks WHERE task_id = (SELECT min(task_id) FROM tasks)
      UNION ALL SELECT 'project_id unique', count(*) FROM (SELECT project_id FROM tasks GROUP BY project_id HAVING count(*) > 1))
    """,
    ("tasks",),
)
def a10(spark, d):
    return T.constraint_report(table(spark, d, "tasks"), T.task_rules(), ["task_id", "project_id"])


@query(
    "A10_project_constraints",
    "SELECT 'name 1..200 chars' AS rule, count(*) FILTER (name = '') AS violations FROM projects "
    "UNION ALL SELECT 'priority in 0..5', count(*) FILTER (priority > 5) FROM projects",
    ("projects",),
)
def a10_projects(spark, d):
    return T.constraint_report(table(spark, d, "projects"), T.project_rules())


@query("A11_tenant_scope", "SELECT task_id FROM tasks WHERE user_id = 'u1'", ("tasks",))
def a11(spark, d):
    return T.tenant_scope(table(spark, d, "tasks"), user_id="u1").select("task_id")


# ------------------------------------------------------------------ normalisation


@query("B1_sanitize_text", "SELECT doc_id, md5(text) AS clean FROM documents")
def b1(spark, d):
    docs = driver_table(spark, d, "documents")
    return docs.select("doc_id", F.md5(N.sanitize_text(F.replace("text", F.lit("\n"), F.lit("\r\n")))).alias("clean"))


@query(
    "B2_address_parts",
    """
    SELECT id, CASE WHEN id % 6 = 4 THEN NULL ELSE lower(from_email) END AS email,
      CASE id % 6 WHEN 0 THEN from_name WHEN 1 THEN coalesce(from_name, 'No Name') END AS name FROM messages
    """,
    ("messages",),
)
def b2(spark, d):
    parts = table(spark, d, "headers").select("id", N.address_parts("raw_from").alias("p"))
    return parts.select("id", "p.email", "p.name")


@query(
    "B3_address_list",
    """
    SELECT id, CASE id % 4 WHEN 0 THEN concat('jane@x.example|', lower(from_email))
      WHEN 1 THEN concat(lower(from_email), '|bob@y.example') WHEN 2 THEN '' ELSE 'a@b.example|b@c.example' END AS mails
    FROM messages
    """,
    ("messages",),
)
def b3(spark, d):
    return present(table(spark, d, "headers").select("id", N.address_list("raw_to").alias("mails")))


@query(
    "B4_address_list_quoted",
    """
    SELECT id, CASE id % 4 WHEN 0 THEN concat('jane@x.example|', lower(from_email))
      WHEN 1 THEN concat(lower(from_email), '; bob@y.example;; junk') WHEN 2 THEN '' ELSE 'a@b.example|b@c.example' END AS mails
    FROM messages
    """,
    ("messages",),
)
def b4(spark, d):
    return present(table(spark, d, "headers").select("id", N.address_list_quoted("raw_to").alias("mails")))


@query(
    "B5_parse_mail_date",
    """
    SELECT id, CASE WHEN id % 7 <> 6 THEN 1704067200 + (id % 28) * 86400 + (id % 24) * 3600 + (id % 60) * 60 + 5
      + CASE id % 7 WHEN 1 THEN 28800 WHEN 2 THEN -7200 ELSE 0 END END AS date FROM messages
    """,
    ("messages",),
)
def b5(spark, d):
    return present(table(spark, d, "headers").select("id", N.parse_mail_date("raw_date").alias("date")))


@query(
    "B6_preview",
    f"""
    SELECT doc_id, CASE WHEN length(flat) > 200 THEN substring(flat, 1, 200) || '...' ELSE flat END AS preview
    FROM (SELECT doc_id, {strip_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS flat FROM documents)
    """,
)
def b6(spark, d):
    return driver_table(spark, d, "documents").select("doc_id", N.preview("text").alias("preview"))


@query("B7_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS words FROM documents")
def b7(spark, d):
    return driver_table(spark, d, "documents").select("doc_id", N.word_count("text").alias("words"))


@query("B8_is_sent_label", "SELECT id, id % 4 = 1 AS is_sent FROM messages", ("messages",))
def b8(spark, d):
    return table(spark, d, "headers").select("id", N.is_sent_label(N.label_list("raw_labels")).alias("is_sent"))


@query(
    "B9_label_list",
    "SELECT id, CASE id % 4 WHEN 0 THEN 'Inbox|[Big]/AI, Marketing|Unread' WHEN 1 THEN 'sENT|Work' WHEN 2 THEN '' "
    "ELSE 'Long label|x' END AS labels FROM messages",
    ("messages",),
)
def b9(spark, d):
    return present(table(spark, d, "headers").select("id", N.label_list("raw_labels").alias("labels")))


@query(
    "B10_label_flags",
    "SELECT id, coalesce(list_contains(labels, 'Inbox'), false) AS is_inbox, coalesce(list_contains(labels, 'Unread'), false) "
    "AS is_unread, coalesce(list_contains(labels, 'Starred'), false) AS is_starred, false AS is_sent FROM messages",
    ("messages",),
)
def b10(spark, d):
    flags = N.label_flags(F.transform("labels", lambda label: F.upper(label)))
    rows = table(spark, d, "messages").select("id", flags.alias("f"))
    return rows.select("id", "f.is_inbox", "f.is_unread", "f.is_starred", "f.is_sent")


@query(
    "B11_reference_ids",
    "SELECT id, CASE id % 3 WHEN 0 THEN concat('<', message_id, '@x>|<bare@y.example>') WHEN 1 THEN '' "
    "ELSE concat('<a@b>|<', message_id, '@x>') END AS refs FROM messages",
    ("messages",),
)
def b11(spark, d):
    return present(table(spark, d, "headers").select("id", N.reference_ids("raw_refs").alias("refs")))


@query(
    "B12_decode_headers",
    "SELECT doc_id, replace(text, chr(10), ' ') AS subject FROM documents",
)
def b12(spark, d):
    text = F.regexp_replace("text", "\n", " ")
    word = F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(text.cast("binary")), r"\s", ""), F.lit("?="))
    return driver_table(spark, d, "documents").select("doc_id", archive.decode_headers(word).alias("subject"))


@query(
    "B15_build_messages",
    f"""
    SELECT m.message_id, m.thread_id, m.in_reply_to,
      CASE WHEN m.id % 7 <> 6 THEN 1704067200 + (m.id % 28) * 86400 + (m.id % 24) * 3600 + (m.id % 60) * 60 + 5
        + CASE m.id % 7 WHEN 1 THEN 28800 WHEN 2 THEN -7200 ELSE 0 END END AS date_parsed,
      CASE WHEN m.id % 6 = 4 THEN NULL ELSE lower(m.from_email) END AS from_email,
      CASE m.id % 4 WHEN 0 THEN concat('jane@x.example|', lower(from_email)) WHEN 1 THEN concat(lower(from_email), '|bob@y.example')
        WHEN 2 THEN NULL ELSE 'a@b.example|b@c.example' END AS to_emails,
      m.subject, md5(m.body_text) AS body_md5,
      CAST(coalesce(len(regexp_extract_all(m.body_text, '\\S+')), 0) AS INT) AS word_count,
      array_to_string(m.labels, '|') AS labels, false AS is_sent
    FROM messages m
    """,
    ("messages",),
)
def b15(spark, d):
    m, h = table(spark, d, "messages"), table(spark, d, "headers")
    raw = m.join(h, "id").select(
        "message_id", "thread_id", F.coalesce("in_reply_to", F.lit("")).alias("in_reply_to"), F.col("raw_date").alias("date"),
        F.col("raw_from").alias("from"), F.col("raw_to").alias("to"), F.lit(None).cast("string").alias("cc"), "subject",
        F.replace("body_text", F.lit("\n"), F.lit("\r")).alias("body"), "labels", "has_attachments",
    )
    return present(documents.build_messages(raw).select(
        "message_id", "thread_id", "in_reply_to", "date_parsed", "from_email", "to_emails", "subject",
        F.md5("body_text").alias("body_md5"), "word_count", "labels", "is_sent",
    ))


# ------------------------------------------------------------------ cleaning

UNESCAPE = (
    "replace(replace(replace(replace(replace(replace(%s, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), "
    "'&quot;', '\"'), '&amp;', '&')"
)


def html_sql(c: str, elements: list[str]) -> str:
    out = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    for e in elements:
        out = f"regexp_replace({out}, '(?is)<{e}\\b[^>]*>.*?</{e}\\s*>', ' ', 'g')"
    out = UNESCAPE % f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    return strip_sql(f"regexp_replace({out}, '{WS}+', ' ', 'g')")


@query("C1_strip_html", f"SELECT page_id, md5({html_sql('html', ['script', 'style', 'head', 'noscript'])}) AS text_md5 FROM pages")
def c1(spark, d):
    return driver_table(spark, d, "pages").select("page_id", F.md5(H.strip_html("html")).alias("text_md5"))


@query("C2_strip_html_basic", f"SELECT page_id, md5({html_sql('html', ['script', 'style', 'head'])}) AS text_md5 FROM pages")
def c2(spark, d):
    return driver_table(spark, d, "pages").select("page_id", F.md5(H.strip_html_basic("html")).alias("text_md5"))


@query("C2_strip_html_regex", f"SELECT page_id, md5({html_sql('html', ['script', 'style', 'head'])}) AS text_md5 FROM pages")
def c2_regex(spark, d):
    return driver_table(spark, d, "pages").select("page_id", F.md5(H.strip_html_regex("html")).alias("text_md5"))


def templates_sql(c: str) -> str:
    for tag in (r"\{%.*?%\}", r"\{\{.*?\}\}", r"\{#.*?#\}", r"<%.*?%>"):
        c = f"regexp_replace({c}, '(?s){tag}', '', 'g')"
    return strip_sql(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


@query("C3_strip_templates", f"SELECT doc_id, md5({templates_sql('text')}) AS text_md5 FROM doc_text", ("doc_text",))
def c3(spark, d):
    return table(spark, d, "doc_text").select("doc_id", F.md5(C.strip_templates("text")).alias("text_md5"))


INLINE = r"(?i)On [^>]+wrote:\s*>[^\n]*"


@query(
    "C4_strip_quotes",
    f"""
    SELECT doc_id, md5({strip_sql(r"regexp_replace(kept, '\s*>\s+\S[^\n]*', '', 'g')")}) AS text_md5 FROM (
      SELECT d.doc_id, {strip_sql("coalesce(k.kept, '')")} AS kept FROM doc_text d LEFT JOIN (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (kind = 'plain' OR (kind = 'blank' AND state IS DISTINCT FROM 'open')) AS kept
        FROM (SELECT *, last_value(CASE WHEN kind IN ('open', 'plain') THEN kind END IGNORE NULLS)
                OVER (PARTITION BY doc_id ORDER BY i) AS state FROM kinds) GROUP BY doc_id) k ON k.doc_id = d.doc_id)
    """,
    ("doc_text",),
    rf"""
    lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{INLINE}', '', 'g'), chr(10))) AS line,
      unnest(range(len(string_split(regexp_replace(text, '{INLINE}', '', 'g'), chr(10))))) AS i FROM doc_text),
    kinds AS (SELECT doc_id, i, line, CASE WHEN s LIKE '>%' OR regexp_full_match(s, '(?i)On .+ wrote:')
        OR regexp_full_match(s, '(?i)-+\s*(Forwarded message|Original Message)\s*-+') THEN 'open'
        WHEN regexp_full_match(s, '(From|Sent|To|Subject|Date|Cc|Bcc):\s*.+') THEN 'header' WHEN s = '' THEN 'blank' ELSE 'plain' END AS kind
      FROM (SELECT doc_id, i, line, {strip_sql("line")} AS s FROM lines))
    """,
)
def c4(spark, d):
    return table(spark, d, "doc_text").select("doc_id", F.md5(C.strip_quotes("text")).alias("text_md5"))


MARKS = "(?:--|—|Sent from my iPhone|Best regards,|Best,|Thanks,|Regards,|Cheers,|Sincerely,|Sent via |Sent from |Get Outlook for )"


@query(
    "C5_strip_signature",
    f"""
    SELECT doc_id, cut IS NOT NULL AS removed, md5(CASE WHEN cut IS NULL THEN text ELSE
      {strip_sql("coalesce(array_to_string(lines[1:cut - 1], chr(10)), '')")} END) AS text_md5
    FROM (SELECT doc_id, text, lines, list_min(list_filter(range(1, len(lines) + 1),
        lambda i: regexp_matches(lines[i], '^\\s*{MARKS}'))) AS cut
      FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM doc_text))
    """,
    ("doc_text",),
)
def c5(spark, d):
    rows = table(spark, d, "doc_text")
    return rows.select("doc_id", C.has_signature("text").alias("removed"), F.md5(C.strip_signature("text")).alias("text_md5"))


CHARS = (
    "replace(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(%s), '“', '\"'), '”', '\"'), '‘', ''''), "
    "'’', ''''), '—', '-'), '–', '-'), '…', '...'), chr(8203), '')"
)


@query("C6_normalize_chars", f"SELECT doc_id, md5({CHARS % 'text'}) AS text_md5 FROM doc_text", ("doc_text",))
def c6(spark, d):
    return table(spark, d, "doc_text").select("doc_id", F.md5(C.normalize_chars("text")).alias("text_md5"))


def collapse_sql(c: str) -> str:
    c = rf"regexp_replace({c}, '\n{WS}*\n', chr(10) || chr(10), 'g')"
    c = rf"regexp_replace({c}, '[\t\r\f\x0b \x85\p{{Z}}]+', ' ', 'g')"
    return strip_sql(f"replace(replace({c}, ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10))")


@query("C7_collapse_whitespace", f"SELECT doc_id, md5({collapse_sql('text')}) AS text_md5 FROM doc_text", ("doc_text",))
def c7(spark, d):
    return table(spark, d, "doc_text").select("doc_id", F.md5(C.collapse_whitespace("text")).alias("text_md5"))


def sanitized_ctes(source: str, key: str, content: str) -> str:
    """C8 in SQL: after C3 the text is one line, which decides what C4 and C5 do."""
    markup = " OR ".join(f"lower(t) LIKE '%{tag}%'" for tag in ("<html", "<body", "<p", "<div", "<script", "<style", "<table", "<span"))
    quote_line = r"(?:>.*|(?i:On .+ wrote:)|(?i:-+\s*(?:Forwarded message|Original Message)\s*-+)|(?:From|Sent|To|Subject|Date|Cc|Bcc):\s*.+)"
    return rf"""
    s0 AS (SELECT {key}, coalesce({content}, '') AS t FROM {source}),
    s1 AS (SELECT {key}, t AS raw, ({markup}) AS html_stripped,
      {templates_sql(f"CASE WHEN {markup} THEN {html_sql('t', ['script', 'style', 'head'])} ELSE t END")} AS t FROM s0),
    s2 AS (SELECT *, CASE WHEN regexp_full_match(q, '{quote_line}') THEN '' ELSE
      {strip_sql(r"regexp_replace(q, '\s*>\s+\S.*', '', 'g')")} END AS u
      FROM (SELECT *, {strip_sql(f"regexp_replace(t, '{INLINE}', '', 'g')")} AS q FROM s1)),
    s3 AS (SELECT *, regexp_matches(u, '^{MARKS}') AS signature_removed, length(u) < length(t) AS quotes_removed FROM s2),
    clean AS (SELECT {key}, raw, html_stripped, quotes_removed, signature_removed,
      {collapse_sql(f"CASE WHEN signature_removed THEN '' ELSE {CHARS % 'u'} END")} AS clean_text FROM s3)
    """


@query(
    "C8_sanitize_messages",
    """
    SELECT doc_id, md5(clean_text) AS text_md5, html_stripped, quotes_removed, signature_removed,
      CAST(length(raw) AS INT) AS original_length, CAST(length(clean_text) AS INT) AS sanitized_length,
      CASE WHEN length(raw) = 0 THEN 0.0 ELSE round(1.0 - length(clean_text) / length(raw), 6) END AS reduction_ratio
    FROM clean
    """,
    ("doc_text",),
    sanitized_ctes("doc_text", "doc_id", "text"),
)
def c8(spark, d):
    out = C.sanitize_messages(table(spark, d, "doc_text"), "text")
    return present(out.withColumn("text_md5", F.md5("clean_text")).drop("clean_text", "text"))


@query(
    "C9_token_estimate",
    "SELECT doc_id, CAST(length(text) // 2 AS INT) AS tokens, md5(CASE WHEN length(text) > 600 THEN substring(text, 1, 600) || '...' ELSE text END) AS cut_md5 FROM documents",
)
def c9(spark, d):
    docs = driver_table(spark, d, "documents")
    return docs.select(
        "doc_id", C.token_estimate("text").alias("tokens"), F.md5(C.truncate_tokens("text", 300)).alias("cut_md5")
    )


EMBED_TEXT = f"""
    inputs AS (SELECT l.id AS email_id, l.subject, l.body_text, f.is_service_email AS is_service, f.service_importance, f.relationship_strength
      FROM labelled l JOIN features f ON f.email_id = l.id WHERE NOT l.is_sent),
    {sanitized_ctes("inputs", "email_id", "body_text").strip()},
    texts AS (SELECT i.email_id, concat_ws(chr(10), concat('[TYPE: ', CASE WHEN is_service THEN 'SERVICE' ELSE 'PERSON' END, '] [PRIORITY: ',
      CASE WHEN is_service THEN CASE WHEN service_importance >= 0.7 THEN 'HIGH' WHEN service_importance >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END
        ELSE CASE WHEN relationship_strength > 0.5 THEN 'HIGH' WHEN relationship_strength > 0.2 THEN 'MEDIUM' ELSE 'LOW' END END, ']'),
      CASE WHEN subject <> '' THEN '[SUBJECT] ' || trim(subject) END, CASE WHEN clean_text <> '' THEN '[BODY] ' || clean_text END) AS text
      FROM inputs i JOIN clean c ON c.email_id = i.email_id)
"""


@query("C10_embedding_text", "SELECT email_id, md5(text) AS text_md5 FROM texts", ("labelled", "features"), EMBED_TEXT)
def c10(spark, d):
    inputs = embedding_inputs(table(spark, d, "labelled"), table(spark, d, "features"))
    return C.embedding_text(inputs).select("email_id", F.md5("text").alias("text_md5"))


@query("C11_content_hash", "SELECT doc_id, substring(sha256(text), 1, 16) AS content_hash FROM documents")
def c11(spark, d):
    return driver_table(spark, d, "documents").select("doc_id", C.content_hash("text").alias("content_hash"))


@query(
    "C12_prepare_for_embedding",
    "SELECT email_id, CAST(length(text) // 2 AS INT) AS token_count, substring(sha256(text), 1, 16) AS content_hash FROM texts WHERE length(text) >= 10",
    ("labelled", "features"),
    EMBED_TEXT,
)
def c12(spark, d):
    inputs = embedding_inputs(table(spark, d, "labelled"), table(spark, d, "features"))
    return C.prepare_for_embedding(inputs).drop("text")
