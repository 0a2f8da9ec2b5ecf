"""Queries for threads, actions, features, contacts, rules, vectors, clusters, priority, projects (D-K, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapter import NOW_S, YOU, driver_table, now, present, table
from contract.registry import query
from mailgrain import constants as K
from mailgrain.functions import scoring as S
from mailgrain.functions import vectors as V
from mailgrain.functions.normalize import lowered
from mailgrain.operators import actions, clusters, contacts, density, features, priority, projects, rules, threads
from mailgrain.operators import vectors as vec

OWN = [YOU, "erin@corp.example"]

# ------------------------------------------------------------------ threads

THREAD_AGG = """
    rolled AS (SELECT thread_id, min(subject) AS subject,
      coalesce(array_to_string(list_sort(list(DISTINCT from_email) FILTER (from_email IS NOT NULL)), '|'), '') AS participants,
      count(*) AS email_count, count(*) FILTER (is_sent) AS your_email_count,
      count(*) FILTER (is_sent AND in_reply_to IS NOT NULL) AS your_reply_count, min(date_s) AS started_at,
      max(date_s) AS last_activity, CAST(max(date_s) - min(date_s) AS DOUBLE) AS thread_duration_seconds,
      bool_or(has_attachments) AS has_attachments, CAST(coalesce(sum(attachment_count), 0) AS BIGINT) AS total_attachment_count
      FROM {source} GROUP BY thread_id),
    gaps AS (SELECT thread_id, round(avg(date_s - before), 6) AS avg_response_time_seconds FROM (
      SELECT thread_id, date_s, lag(date_s) OVER (PARTITION BY thread_id ORDER BY date_s) AS before FROM {source})
      WHERE before IS NOT NULL GROUP BY thread_id)
"""


@query("D1_thread_rollup", "SELECT * FROM rolled", ("messages",), THREAD_AGG.format(source="messages"))
def d1(spark, d):
    return present(threads.thread_rollup(table(spark, d, "messages")))


@query("D2_thread_response_gap", "SELECT * FROM gaps", ("messages",), THREAD_AGG.format(source="messages"))
def d2(spark, d):
    return present(threads.thread_response_gap(table(spark, d, "messages")))


@query(
    "D3_build_threads", "SELECT rolled.*, avg_response_time_seconds FROM rolled LEFT JOIN gaps USING (thread_id)",
    ("order_mail",), THREAD_AGG.format(source="order_mail"),
)
def d3(spark, d):
    return present(threads.build_threads(table(spark, d, "order_mail")))


# ------------------------------------------------------------------ actions


def bucket_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} < 3600 THEN 'IMMEDIATE' WHEN {c} < 86400 THEN 'SAME_DAY' WHEN {c} < 172800 THEN 'NEXT_DAY' "
        f"WHEN {c} IS NOT NULL THEN 'LATER' END"
    )


ROBOT = (
    " OR ".join(f"lower(from_email) LIKE '%{w}%'" for w in K.AUTOMATED_REPLY_SENDERS) + " OR "
    + " OR ".join(f"lower(subject) LIKE '%{w}%'" for w in K.AUTOMATED_REPLY_SUBJECTS)
)


def answers_sql(source: str) -> str:
    return f"""
    marked AS (SELECT * REPLACE (is_sent OR lower(from_email) IN ({", ".join(f"'{a}'" for a in OWN)}) AS is_sent) FROM {source}),
    answered AS (SELECT a.id, min(b.date_s) - a.date_s AS seconds, any_value(a.is_sent) AS own FROM marked a
      JOIN marked b ON b.in_reply_to = a.message_id AND b.date_s > a.date_s AND a.is_sent <> b.is_sent
      WHERE b.is_sent OR NOT ({ROBOT.replace("from_email", "b.from_email").replace("subject", "b.subject")})
      GROUP BY a.id, a.date_s)"""


@query(
    "E1_response_bucket", f"SELECT o_orderkey, {bucket_sql('o_totalprice')} AS bucket FROM orders"
)
def e1(spark, d):
    return driver_table(spark, d, "orders").select("o_orderkey", actions.response_bucket(F.col("o_totalprice")).alias("bucket"))


@query("E2_mark_sent", "SELECT id, is_sent FROM marked", ("messages",), answers_sql("messages"))
def e2(spark, d):
    return actions.mark_sent(table(spark, d, "messages"), OWN).select("id", "is_sent")


@query(
    "E3_replied",
    f"SELECT id, CAST(seconds AS INT) AS response_time_seconds, {bucket_sql('seconds')} AS timing FROM answered WHERE NOT own",
    ("order_mail",), answers_sql("order_mail"),
)
def e3(spark, d):
    return actions.replied(actions.mark_sent(table(spark, d, "order_mail"), OWN))


@query(
    "E8_reverse_tracking",
    f"SELECT id, CAST(seconds AS INT) AS response_time_seconds, {bucket_sql('seconds')} AS timing FROM answered WHERE own",
    ("messages",), answers_sql("messages"),
)
def e8(spark, d):
    return actions.reverse_tracking(actions.mark_sent(table(spark, d, "messages"), OWN))


HAS = "coalesce(list_contains(labels, '%s'), false)"
CASCADE = f"""
    frequent AS (SELECT lower(from_email) AS who FROM {{source}} GROUP BY lower(from_email) HAVING count(*) > 20),
    facts AS (SELECT m.*, seconds, own, lower(from_email) IN (SELECT who FROM frequent) AS often,
      date_s < (SELECT max(date_s) FROM {{source}}) - 7 * 86400 AS old FROM marked m LEFT JOIN answered a ON a.id = m.id),
    judged AS (SELECT *, CASE WHEN is_sent THEN 'COMPOSED' WHEN seconds IS NOT NULL THEN 'REPLIED' WHEN {HAS % "Starred"} THEN 'STARRED'
      WHEN old AND ({HAS % "Archived"} OR (labels IS NOT NULL AND NOT {HAS % "Unread"} AND NOT {HAS % "Inbox"})
        OR len(cc_emails) >= 1 OR coalesce(len(to_emails), 0) > 1 OR often) THEN 'ARCHIVED'
      WHEN old AND {HAS % "Unread"} AND cc_emails IS NULL AND coalesce(len(to_emails), 1) = 1 AND NOT often THEN 'IGNORED'
      ELSE 'PENDING' END AS act FROM facts)
"""


def cascade(source: str) -> str:
    return answers_sql(source) + "," + CASCADE.format(source=source)


def _profiles(m):
    """Message counts per address: what the frequent-sender rule needs."""
    return m.groupBy(F.col("from_email").alias("email")).agg(F.count(F.lit(1)).alias("emails_from"))


@query("E4_starred", f"SELECT id FROM messages WHERE NOT is_sent AND {HAS % 'Starred'}", ("messages",))
def e4(spark, d):
    return actions.starred(table(spark, d, "messages")).select("id")


@query(
    "E5_archived",
    f"SELECT id FROM facts WHERE NOT is_sent AND old AND ({HAS % 'Archived'} OR (labels IS NOT NULL AND NOT {HAS % 'Unread'} "
    f"AND NOT {HAS % 'Inbox'}) OR len(cc_emails) >= 1 OR coalesce(len(to_emails), 0) > 1 OR often)",
    ("messages",), cascade("messages"),
)
def e5(spark, d):
    m = actions.mark_sent(table(spark, d, "messages"), OWN)
    return actions.archived(m, _profiles(m)).select("id")


@query(
    "E6_ignored",
    f"SELECT id FROM facts WHERE NOT is_sent AND old AND {HAS % 'Unread'} AND cc_emails IS NULL AND coalesce(len(to_emails), 1) = 1 AND NOT often",
    ("messages",), cascade("messages"),
)
def e6(spark, d):
    m = actions.mark_sent(table(spark, d, "messages"), OWN)
    return actions.ignored(m, _profiles(m)).select("id")


@query(
    "E7_pending_composed",
    "SELECT id, CASE WHEN is_sent THEN 'COMPOSED' ELSE 'PENDING' END AS action FROM messages", ("messages",),
)
def e7(spark, d):
    return actions.pending_composed(table(spark, d, "messages")).select("id", "action")


LABELLED = f"""
    SELECT id, act AS action, CASE WHEN act IN ('ARCHIVED', 'IGNORED') THEN 'NEVER' WHEN act = 'REPLIED' OR is_sent THEN {bucket_sql('seconds')}
      END AS timing, CASE WHEN act = 'REPLIED' OR is_sent THEN CAST(seconds AS INT) END AS response_time_seconds FROM judged
"""


@query("E9_label_actions", LABELLED, ("messages",), cascade("messages"))
def e9(spark, d):
    m = table(spark, d, "messages")
    out = actions.label_actions(m, _profiles(m), OWN)
    return out.select("id", "action", "timing", "response_time_seconds")


@query("E9_label_actions_orders", LABELLED, ("order_mail",), cascade("order_mail"))
def e9_orders(spark, d):
    m = table(spark, d, "order_mail")
    out = actions.label_actions(m, _profiles(m), OWN)
    return out.select("id", "action", "timing", "response_time_seconds")


@query(
    "E9_action_counts", "SELECT act AS action, count(*) AS n FROM judged GROUP BY act", ("order_mail",), cascade("order_mail")
)
def e9_counts(spark, d):
    m = table(spark, d, "order_mail")
    return actions.action_counts(actions.label_actions(m, _profiles(m), OWN))


# ------------------------------------------------------------------ features


def sender_sql(source: str) -> str:
    ref = f"(SELECT max(date_s) FROM {source})"
    trailing = ", ".join(f"count(*) FILTER (date_s >= {ref} - {n} * 86400) AS emails_{n}d" for n in (7, 30, 90))
    return f"""
    f1 AS (SELECT lower(from_email) AS sender, count(*) AS emails_all, {trailing}, max(date_s) AS last_received
      FROM {source} WHERE NOT is_sent GROUP BY 1),
    f2 AS (SELECT lower(r.from_email) AS sender, count(DISTINCT r.id) AS replied_count,
      avg((s.date_s - r.date_s) / 3600.0) AS avg_response_hours
      FROM {source} r JOIN {source} s ON s.in_reply_to = r.message_id WHERE NOT r.is_sent AND s.is_sent GROUP BY 1),
    f3 AS (SELECT lower(who) AS recipient, count(*) AS initiated_count FROM (SELECT unnest(to_emails) AS who FROM {source} WHERE is_sent) GROUP BY 1),
    f4 AS (SELECT lower(from_email) AS sender, avg(CASE WHEN message_id IN (SELECT in_reply_to FROM {source} WHERE NOT is_sent AND in_reply_to IS NOT NULL)
      THEN 1.0 ELSE 0.0 END) AS reply_rate FROM {source} WHERE is_sent GROUP BY 1),
    f5 AS (SELECT f1.*, coalesce(replied_count, 0) AS user_replied_count, coalesce(avg_response_hours, 0.0) AS avg_response_hours,
      coalesce(initiated_count, 0) AS user_initiated_count, coalesce(reply_rate, 0.0) AS sender_reply_rate
      FROM f1 LEFT JOIN f2 USING (sender) LEFT JOIN f3 ON f3.recipient = f1.sender LEFT JOIN f4 USING (sender))
    """


@query("F1_sender_counts", "SELECT * FROM f1", ("order_mail",), sender_sql("order_mail"))
def f1(spark, d):
    return present(features.sender_counts(table(spark, d, "order_mail")))


@query(
    "F2_user_replies", "SELECT sender, replied_count, round(avg_response_hours, 6) AS avg_response_hours FROM f2",
    ("order_mail",), sender_sql("order_mail"),
)
def f2(spark, d):
    return present(features.user_replies(table(spark, d, "order_mail")))


@query("F3_user_initiated", "SELECT * FROM f3", ("order_mail",), sender_sql("order_mail"))
def f3(spark, d):
    return features.user_initiated(table(spark, d, "order_mail"))


@query("F4_sender_reply_rate", "SELECT sender, round(reply_rate, 6) AS reply_rate FROM f4", ("messages",), sender_sql("messages"))
def f4(spark, d):
    return present(features.sender_reply_rate(table(spark, d, "messages")))


@query(
    "F5_sender_stats",
    "SELECT * REPLACE (round(avg_response_hours, 6) AS avg_response_hours, round(sender_reply_rate, 6) AS sender_reply_rate) FROM f5",
    ("order_mail",), sender_sql("order_mail"),
)
def f5(spark, d):
    return present(features.sender_stats(table(spark, d, "order_mail")))


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def hits_sql(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in words) + ")"


def service_sql(source: str) -> str:
    kinds = " ".join(
        f"WHEN {any_sql('sub', words)} OR {any_sql('frm', words)} THEN '{name}'" for name, words in K.SERVICE_TYPE_WORDS.items()
    )
    return f"""
    lowered AS (SELECT id AS email_id, lower(coalesce(from_email, '')) AS frm, lower(coalesce(subject, '')) AS sub,
      lower(coalesce(body_text, '')) AS bod FROM {source} WHERE NOT is_sent),
    typed AS (SELECT *, CASE {kinds} END AS service_type, {any_sql('frm', K.SERVICE_ADDRESS_WORDS)} AS addressed,
      {hits_sql('sub', K.IMPORTANT_SUBJECT_WORDS)} AS good, {hits_sql('sub', K.UNIMPORTANT_SUBJECT_WORDS)} AS poor,
      {hits_sql('frm', K.IMPORTANT_SENDER_WORDS)} AS who FROM lowered),
    service AS (SELECT *, confidence >= 0.29 AS is_service, CASE WHEN confidence < 0.29 THEN 0.0 ELSE
        0.5 * (CASE WHEN good > 0 AND poor = 0 THEN least(1.0, 0.5 + good * 0.2) WHEN poor > 0 AND good = 0 THEN greatest(0.0, 0.3 - poor * 0.1)
          WHEN good > poor THEN 0.6 WHEN poor > good THEN 0.2 ELSE 0.4 END)
        + 0.5 * (CASE WHEN who > 0 THEN least(1.0, 0.5 + who * 0.25) ELSE 0.3 END) END AS importance
      FROM (SELECT *, CASE WHEN addressed THEN 0.3 ELSE 0 END + CASE WHEN contains(bod, 'unsubscribe') THEN 0.3 ELSE 0 END
        + CASE WHEN service_type IS NOT NULL THEN 0.2 ELSE 0 END AS confidence FROM typed))
    """


@query(
    "F6_service_detection",
    "SELECT email_id, is_service, round(CAST(confidence AS DOUBLE), 6) AS confidence, service_type FROM service",
    ("messages",), service_sql("messages"),
)
def f6(spark, d):
    m = lowered(table(spark, d, "messages").filter(~F.col("is_sent")), frm="from_email", sub="subject", bod="body_text")
    rows = m.select(F.col("id").alias("email_id"), S.service_detection("frm", "sub", "bod").alias("s"))
    return present(rows.select("email_id", "s.is_service", "s.confidence", "s.service_type"))


@query(
    "F7_service_importance", "SELECT email_id, round(CAST(importance AS DOUBLE), 6) AS importance FROM service",
    ("order_mail",), service_sql("order_mail"),
)
def f7(spark, d):
    m = lowered(table(spark, d, "order_mail").filter(~F.col("is_sent")), frm="from_email", sub="subject", bod="body_text")
    m = m.withColumn("s", S.service_detection("frm", "sub", "bod"))
    return present(m.select(
        F.col("id").alias("email_id"), S.service_importance("frm", "sub", F.col("s.is_service")).alias("importance")
    ))


CLOCK = "SELECT *, (date_s // 3600) % 24 AS h, (date_s // 86400 + 3) % 7 AS wd FROM order_mail"


@query(
    "F8_time_bucket",
    "SELECT id, CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 "
    f"THEN 'evening' ELSE 'night' END AS bucket FROM ({CLOCK})",
    ("order_mail",),
)
def f8(spark, d):
    return table(spark, d, "order_mail").select("id", S.time_bucket(F.hour("date_parsed")).alias("bucket"))


@query("F9_business_hours", f"SELECT id, wd < 5 AND h >= 9 AND h < 17 AS in_hours FROM ({CLOCK})", ("order_mail",))
def f9(spark, d):
    return table(spark, d, "order_mail").select(
        "id", S.business_hours(F.hour("date_parsed"), F.weekday("date_parsed")).alias("in_hours")
    )


@query(
    "F10_relationship_strength",
    "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 0.35 * least(l_quantity / 10.0, 1.0) + 0.45 * l_discount + 0.10 * l_tax "
    "+ 0.05 * (1.0 - least((l_partkey % 200) / 90.0, 1.0)) + 0.05 * l_tax)), 6) AS strength FROM lineitem",
)
def f10(spark, d):
    rows = driver_table(spark, d, "lineitem")
    strength = S.relationship_strength(
        F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_partkey") % 200, F.col("l_tax")
    )
    return present(rows.select("l_orderkey", "l_linenumber", strength.alias("strength")))


@query(
    "F11_urgency_score",
    "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 0.4 * l_discount * 10 + 0.3 * greatest(0.0, 1.0 - (l_partkey % 20) / 7.0) "
    "+ CASE WHEN l_returnflag = 'N' THEN 0.2 ELSE 0.1 END + CASE WHEN l_linestatus = 'O' THEN 0.1 ELSE 0.0 END)), 6) AS urgency FROM lineitem",
)
def f11(spark, d):
    rows = driver_table(spark, d, "lineitem")
    urgency = S.urgency_score(
        F.col("l_discount") * 10, F.col("l_partkey") % 20, F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
    )
    return present(rows.select("l_orderkey", "l_linenumber", urgency.alias("urgency")))


SPACE_RE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def feature_rows(source: str) -> str:
    plain = (
        "replace(regexp_replace(regexp_replace(coalesce(body_text, ''), '(?is)<script>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&')"
    )
    return f"""{sender_sql(source)}, {service_sql(source)},
    base AS (SELECT m.*, v.*, coalesce(s.emails_all, 0) AS ea, coalesce(s.emails_7d, 0) AS e7, coalesce(s.emails_30d, 0) AS e30,
      coalesce(s.emails_90d, 0) AS e90, coalesce(s.user_replied_count, 0) AS rc, coalesce(s.avg_response_hours, 0) AS rh,
      coalesce(s.user_initiated_count, 0) AS ic, coalesce(s.sender_reply_rate, 0) AS sr,
      ((SELECT max(date_s) FROM {source}) - s.last_received) // 86400 AS ds,
      ((SELECT max(date_s) FROM {source}) - m.date_s) // 86400 AS dr, (m.date_s // 3600) % 24 AS h, (m.date_s // 86400 + 3) % 7 AS wd,
      {plain} AS plain, coalesce(list_contains(m.labels, 'Has attachment'), false) AS att
      FROM {source} m JOIN service v ON v.email_id = m.id LEFT JOIN f5 s ON s.sender = v.frm),
    scored AS (SELECT *, rc / ea AS rr, ic / (ea + ic) AS ir FROM base),
    related AS (SELECT *, least(1.0, greatest(0.0, 0.35 * least(e30 / 10.0, 1.0) + 0.45 * rr + 0.1 * sr
      + 0.05 * (1.0 - least(ds / 90.0, 1.0)) + 0.05 * ir)) AS rel, wd < 5 AND h >= 9 AND h < 17 AS biz FROM scored),
    feature_rows AS (SELECT email_id, e7 AS emails_from_sender_7d, e30 AS emails_from_sender_30d, e90 AS emails_from_sender_90d,
      ea AS emails_from_sender_all, rc AS user_replied_to_sender_count, round(rr, 6) AS user_replied_to_sender_rate,
      round(rh, 6) AS avg_response_time_hours, round(ir, 6) AS user_initiated_ratio, ds AS days_since_last_interaction,
      round(sr, 6) AS sender_replies_to_you_rate, round(rel, 6) AS relationship_strength, is_service AS is_service_email,
      round(CAST(confidence AS DOUBLE), 6) AS service_confidence, service_type, round(CAST(importance AS DOUBLE), 6) AS service_importance,
      contains(lower(plain), 'unsubscribe') AS has_unsubscribe_link, false AS has_list_unsubscribe_header,
      addressed AS from_common_service_domain, h AS hour_of_day, wd AS day_of_week, wd >= 5 AS is_weekend, biz AS is_business_hours,
      dr AS days_since_received, dr < 7 AS is_recent, CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon'
        WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_bucket,
      round(least(1.0, 0.4 * rel + 0.3 * greatest(0.0, 1.0 - dr / 7.0) + CASE WHEN biz THEN 0.2 ELSE 0.1 END + CASE WHEN att THEN 0.1 ELSE 0 END), 6)
        AS urgency_score,
      len(regexp_extract_all(coalesce(subject, ''), '\\S+')) AS subject_word_count, len(regexp_extract_all(plain, '\\S+')) AS body_word_count,
      att AS has_attachments, CAST(att AS INT) AS attachment_count,
      coalesce(len(to_emails), 0) + coalesce(len(cc_emails), 0) AS recipient_count FROM related)
    """


FEATURE_TYPES = (
    "days_since_last_interaction INT, hour_of_day INT, day_of_week INT, days_since_received INT, subject_word_count INT, "
    "body_word_count INT, recipient_count INT"
)


@query("F12_message_features", "SELECT * FROM feature_rows", ("messages",), feature_rows("messages"), FEATURE_TYPES)
def f12(spark, d):
    return present(features.message_features(table(spark, d, "messages")))


@query("F12_message_features_orders", "SELECT * FROM feature_rows", ("order_mail",), feature_rows("order_mail"), FEATURE_TYPES)
def f12_orders(spark, d):
    return present(features.message_features(table(spark, d, "order_mail")))


# ------------------------------------------------------------------ contacts


def roles_sql(source: str) -> str:
    return f"""
    roles AS (SELECT lower(trim(from_email)) AS email, 'from' AS role, from_name AS name, thread_id, in_reply_to, response_time_seconds, date_s FROM {source}
      UNION ALL SELECT lower(trim(unnest(to_emails))), 'to', NULL, thread_id, in_reply_to, response_time_seconds, date_s FROM {source}
      UNION ALL SELECT lower(trim(unnest(cc_emails))), 'cc', NULL, thread_id, in_reply_to, response_time_seconds, date_s FROM {source}),
    profile AS (SELECT email, max(name) AS name, count(*) FILTER (role = 'from') AS emails_from, count(*) FILTER (role <> 'from') AS emails_to,
      count(DISTINCT thread_id) AS threads_with, count(*) FILTER (role = 'from' AND in_reply_to <> '') AS reply_count,
      CAST(round(avg(response_time_seconds) FILTER (role = 'from' AND response_time_seconds > 0)) AS INT) AS avg_response_time_seconds,
      min(date_s) AS first_contact, max(date_s) AS last_contact FROM roles WHERE email LIKE '%@%' GROUP BY email),
    rated AS (SELECT *, email = '{YOU}' OR (email LIKE '%@corp.example' AND email LIKE '%dana%') AS is_you,
      CASE WHEN emails_to > 0 THEN round(least(1.0, reply_count / emails_to), 6) WHEN reply_count > 0 THEN 0.0 END AS reply_rate FROM profile),
    people AS (SELECT *, coalesce(NOT is_you AND emails_from > 0 AND ((reply_rate >= 0.5 AND emails_to >= 2)
      OR (emails_from >= 3 AND emails_to >= 3) OR reply_rate >= 0.8), false) AS is_important_sender FROM rated)
    """


CONTACT = {"blocks": ("labelled",), "extra": roles_sql("labelled")}


@query("G1_address_universe", "SELECT email, name FROM profile", **CONTACT)
def g1(spark, d):
    return contacts.address_universe(table(spark, d, "labelled"))


@query("G2_is_you", "SELECT email, is_you FROM rated", **CONTACT)
def g2(spark, d):
    return contacts.address_universe(table(spark, d, "labelled")).select("email", contacts.is_you(F.col("email"), YOU).alias("is_you"))


@query("G3_emails_from", "SELECT email, emails_from FROM profile WHERE emails_from > 0", **CONTACT)
def g3(spark, d):
    return contacts.emails_from(table(spark, d, "labelled"))


@query("G4_emails_to", "SELECT email, emails_to FROM profile WHERE emails_to > 0", **CONTACT)
def g4(spark, d):
    return contacts.emails_to(table(spark, d, "labelled"))


@query("G5_threads_with", "SELECT email, threads_with FROM profile", **CONTACT)
def g5(spark, d):
    return contacts.threads_with(table(spark, d, "labelled"))


@query("G6_reply_count", "SELECT email, reply_count FROM profile WHERE reply_count > 0", **CONTACT)
def g6(spark, d):
    return contacts.reply_count(table(spark, d, "labelled"))


@query(
    "G7_avg_response", "SELECT email, avg_response_time_seconds FROM profile WHERE avg_response_time_seconds IS NOT NULL", **CONTACT
)
def g7(spark, d):
    return contacts.avg_response(table(spark, d, "labelled"))


@query("G8_reply_rate", "SELECT email, reply_rate FROM rated", **CONTACT)
def g8(spark, d):
    m = table(spark, d, "labelled")
    counts = contacts.contact_roles(m).groupBy("email").agg(
        contacts._received_count().alias("emails_to"), contacts._reply_count().alias("reply_count")
    )
    return present(contacts.reply_rate(counts).select("email", "reply_rate"))


@query("G9_important_sender", "SELECT email, is_important_sender FROM people", **CONTACT)
def g9(spark, d):
    return contacts.build_contacts(table(spark, d, "labelled"), YOU).select("email", "is_important_sender")


@query("G10_contact_span", "SELECT email, first_contact, last_contact FROM profile", **CONTACT)
def g10(spark, d):
    return present(contacts.contact_span(table(spark, d, "labelled")))


@query("G11_build_contacts", "SELECT * FROM people", **CONTACT)
def g11(spark, d):
    return present(contacts.build_contacts(table(spark, d, "labelled"), YOU))


ORDER_ROLES = roles_sql("(SELECT *, CAST(NULL AS INT) AS response_time_seconds FROM order_mail)")


@query("G11_build_contacts_orders", "SELECT * FROM people", ("order_mail",), ORDER_ROLES)
def g11_orders(spark, d):
    return present(contacts.build_contacts(table(spark, d, "order_mail"), YOU))


@query(
    "G11_contact_totals",
    "SELECT count(*) AS unique_emails, count(*) FILTER (is_you) AS is_you_count, count(*) FILTER (is_important_sender) AS important_sender_count FROM people",
    **CONTACT,
)
def g11_totals(spark, d):
    return contacts.contact_totals(contacts.build_contacts(table(spark, d, "labelled"), YOU))


# ------------------------------------------------------------------ rules

PATTERN_COLS = ", ".join(
    f"{any_sql('bod' if where == 'body' else 'sub', words)} AS {name}" for name, (where, words) in K.CONTENT_PATTERNS.items()
)


def pattern_rows(source: str) -> str:
    return f"""
    texts AS (SELECT id AS email_id, lower(coalesce(body_text, '')) AS bod, lower(coalesce(subject, '')) AS sub FROM {source} WHERE NOT is_sent),
    patterns AS (SELECT *, contains(bod, '?') OR contains(sub, '?') AS has_question, {PATTERN_COLS} FROM texts)"""


def outcome_rows(source: str, feature_source: str) -> str:
    bulk = "is_service_email AND service_type IN ('marketing', 'newsletter', 'notification')"
    shipped = any_sql("bod", K.ORDER_BODY_WORDS)
    rules_sql = [
        (bulk, "ai_full", "'service_' || service_type", "FILE_TO_FOLDER"),
        ("is_calendar_response", "ai_full", "'calendar_response'", "FILE_TO_FOLDER"),
        ("is_auto_reply", "ai_full", "'auto_reply'", "FILE_TO_FOLDER"),
        ("is_newsletter AND rel < 0.2", "ai_full", "'newsletter_pattern'", "FILE_TO_FOLDER"),
        (f"is_service_email AND service_type = 'transactional' AND {shipped}", "ai_full", "'transactional'", "FILE_TO_FOLDER"),
        ("has_approval", "human_required", "'approval_request'", "PREPARE_DECISION_CONTEXT"),
        ("rel > 0.6 AND NOT is_service_email", "human_required", "'important_relationship'", "PREPARE_DECISION_CONTEXT"),
        ("NOT is_service_email AND has_confirm AND rel > 0.2", "human_required", "'explicit_reply_request'", "DRAFT_REPLY"),
        ("has_deadline AND has_request AND NOT is_service_email", "human_required", "'deadline_request'", "PREPARE_DECISION_CONTEXT"),
        ("has_scheduling AND NOT is_service_email AND rel < 0.5", "ai_partial", "'scheduling_request'", "SCHEDULE_MEETING"),
        ("is_fyi AND rel > 0.1 AND NOT is_service_email", "ai_partial", "'fyi_from_contact'", "DRAFT_REPLY"),
        ("has_confirm AND rel < 0.3", "ai_partial", "'confirm_request'", "DRAFT_REPLY"),
        ("has_attachment_ref", "ai_partial", "'has_attachment'", "SUMMARIZE_ATTACHMENT"),
    ]
    first = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, *_) in enumerate(rules_sql)) + f" ELSE {len(rules_sql)} END"
    names = " ".join(f"WHEN {i} THEN '{r[1]}'" for i, r in enumerate(rules_sql))
    reasons = " ".join(f"WHEN {i} THEN {r[2]}" for i, r in enumerate(rules_sql))
    acts = " ".join(f"WHEN {i} THEN '{r[3]}'" for i, r in enumerate(rules_sql))
    return f"""{pattern_rows(source)},
    ruled AS (SELECT *, {first} AS rule FROM (SELECT p.*, f.relationship_strength AS rel, f.is_service_email, f.service_type
      FROM patterns p JOIN {feature_source} f ON f.email_id = p.email_id)),
    outcomes AS (SELECT *, CASE rule {names} ELSE 'needs_llm' END AS class, CASE rule {reasons} ELSE 'ambiguous' END AS reason,
      CASE rule {acts} END AS act, CASE WHEN rule = 13 THEN CASE WHEN rel > 0.4 THEN 1 WHEN has_request THEN 2 WHEN is_service_email THEN 4
        WHEN rel < 0.1 THEN 5 ELSE 3 END END AS llm_priority FROM ruled)"""


@query(
    "H1_content_patterns",
    f"SELECT email_id, has_question, {', '.join(K.CONTENT_PATTERNS)} FROM patterns", ("order_mail",), pattern_rows("order_mail"),
)
def h1(spark, d):
    m = lowered(table(spark, d, "order_mail").filter(~F.col("is_sent")), sub="subject", bod="body_text")
    rows = m.select(F.col("id").alias("email_id"), S.content_patterns("bod", "sub").alias("p"))
    return rows.select("email_id", "p.*")


@query(
    "H2_handleability", "SELECT email_id, class, reason, act AS action FROM outcomes", ("messages", "features"),
    outcome_rows("messages", "features"),
)
def h2(spark, d):
    m = table(spark, d, "messages").withColumnRenamed("id", "email_id").join(table(spark, d, "features"), "email_id")
    rows = lowered(m, sub="subject", bod="body_text").withColumn("p", S.content_patterns("bod", "sub"))
    rows = rows.withColumn(
        "o", S.handleability(F.col("p"), S.order_mentions("bod"), F.col("relationship_strength"), F.col("is_service_email"), F.col("service_type"))
    )
    return rows.select("email_id", "o.class", "o.reason", "o.metadata.action")


@query(
    "H3_llm_priority", "SELECT email_id, CASE WHEN rel > 0.4 THEN 1 WHEN has_request THEN 2 WHEN is_service_email THEN 4 "
    "WHEN rel < 0.1 THEN 5 ELSE 3 END AS llm_priority FROM ruled", ("messages", "features"), outcome_rows("messages", "features"),
)
def h3(spark, d):
    m = table(spark, d, "messages").withColumnRenamed("id", "email_id").join(table(spark, d, "features"), "email_id")
    m = lowered(m, sub="subject", bod="body_text")
    patterns = S.content_patterns("bod", "sub")
    return m.select(
        "email_id", S.model_priority(patterns, F.col("relationship_strength"), F.col("is_service_email")).alias("llm_priority")
    )


CLASS_SELECT = (
    "SELECT email_id, class AS predicted_handleability, reason AS classification_reason, "
    + ", ".join(rules.STORED_FLAGS) + ", class = 'needs_llm' AS needs_llm_classification, llm_priority FROM outcomes"
)


@query("H4_classify_messages", CLASS_SELECT, ("messages", "features"), outcome_rows("messages", "features"))
def h4(spark, d):
    out = rules.classify_messages(table(spark, d, "messages"), table(spark, d, "features"))
    return out.drop("classification_metadata")


@query(
    "H4_classify_orders", CLASS_SELECT.replace("FROM outcomes", "FROM outcomes"), ("order_mail",),
    feature_rows("order_mail") + ", " + outcome_rows("order_mail", "related_features").strip().replace(
        "texts AS", "related_features AS (SELECT email_id, rel AS relationship_strength, is_service AS is_service_email, service_type FROM related), texts AS", 1
    ),
)
def h4_orders(spark, d):
    m = table(spark, d, "order_mail")
    return rules.classify_messages(m, features.message_features(m)).drop("classification_metadata")


@query(
    "H4_class_counts", "SELECT class AS predicted_handleability, count(*) AS n FROM outcomes GROUP BY class",
    ("messages", "features"), outcome_rows("messages", "features"),
)
def h4_counts(spark, d):
    return rules.class_counts(rules.classify_messages(table(spark, d, "messages"), table(spark, d, "features")))


# ------------------------------------------------------------------ vectors


def centroid_sql(name: str, source: str, by: str, column: str = "embedding") -> str:
    return f"""
    {name}_flat AS (SELECT {by} AS g, generate_subscripts({column}, 1) AS pos, CAST(unnest({column}) AS DOUBLE) AS x FROM {source}),
    {name} AS (SELECT g, list(x ORDER BY pos) AS centroid FROM (SELECT g, pos, avg(x) AS x FROM {name}_flat GROUP BY g, pos) GROUP BY g)"""


def distance_sql(a: str, b: str) -> str:
    return f"(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


def _stub_encoder(texts):
    """Deterministic stand-in for a model: three simple counts; short texts fail."""
    return [None if len(t) % 13 == 0 else [float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query(
    "I1_embed",
    "SELECT doc_id, CAST(length(text) // 2 AS INT) AS token_count, CAST(length(text) AS DOUBLE) AS v0, "
    "CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS v1, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2 "
    "FROM documents WHERE length(text) % 13 <> 0",
)
def i1(spark, d):
    from mailgrain.functions.clean import content_hash, token_estimate

    docs = driver_table(spark, d, "documents").select(
        "doc_id", "text", token_estimate("text").alias("token_count"), content_hash("text").alias("content_hash")
    )
    out = vec.embed(docs, _stub_encoder, key="doc_id")
    return out.select("doc_id", "token_count", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])


@query(
    "I1_embed_counts",
    "SELECT count(*) FILTER (NOT is_sent) AS total_eligible, (SELECT count(*) FROM vectors) AS already_embedded FROM messages",
    ("messages", "vectors"),
)
def i1_counts(spark, d):
    return vec.embed_counts(table(spark, d, "messages"), table(spark, d, "vectors"))


@query(
    "I2_centroid", "SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, CAST(generate_subscripts(embedding, 1) AS INT) AS pos, "
    "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos",
)
def i2(spark, d):
    out = vec.centroid(driver_table(spark, d, "embeddings"), ["label"])
    out = out.select("label", F.posexplode("centroid").alias("pos", "x"))
    return present(out.withColumn("pos", F.col("pos") + 1))


@query(
    "I3_cosine_distance",
    f"SELECT vec_id, round({distance_sql('embedding', 'centroid')}, 6) AS distance FROM embeddings JOIN c ON c.g = label",
    extra=centroid_sql("c", "embeddings", "label"),
)
def i3(spark, d):
    e = driver_table(spark, d, "embeddings")
    joined = e.join(vec.centroid(e, ["label"]), "label")
    return present(joined.select("vec_id", V.cosine_distance("embedding", "centroid").alias("distance")))


@query(
    "I4_minmax",
    "SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders",
)
def i4(spark, d):
    return present(vec.minmax(driver_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"))


@query(
    "I5_load_vector",
    "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, CAST(len(embedding) AS INT) AS n FROM embeddings",
)
def i5(spark, d):
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
    loaded = driver_table(spark, d, "embeddings").select("vec_id", V.load_vector(text).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return loaded.select("vec_id", F.round(total, 4).alias("total"), F.size("v").alias("n"))


# ------------------------------------------------------------------ clusters


@query(
    "J1_people_matrix",
    "SELECT email_id, round(relationship_strength, 6) AS relationship_strength, round(user_replied_to_sender_rate, 6) AS reply_rate, "
    "avg_response_time_hours AS avg_response_hours, CAST(emails_from_sender_all AS DOUBLE) AS emails_from_sender, "
    "round(sender_replies_to_you_rate, 6) AS sender_reply_rate, CAST(CAST(is_service_email AS INT) AS DOUBLE) AS is_service FROM features",
    ("features",),
)
def j1(spark, d):
    return present(clusters.people_matrix(table(spark, d, "features"), table(spark, d, "labelled")))


@query(
    "J2_behavior_matrix",
    "SELECT id AS email_id, CASE action WHEN 'REPLIED' THEN 1.0 WHEN 'ARCHIVED' THEN 2.0 WHEN 'IGNORED' THEN 3.0 WHEN 'PENDING' THEN 4.0 ELSE 5.0 END AS action_code, "
    "round(coalesce(response_time_seconds / 3600.0, 168), 6) AS response_hours, 5.0 AS timing_code FROM labelled WHERE NOT is_sent",
    ("labelled",),
    casts="action_code DOUBLE, timing_code DOUBLE",
)
def j2(spark, d):
    return present(clusters.behavior_matrix(table(spark, d, "labelled")))


@query(
    "J3_service_matrix",
    "SELECT email_id, CAST(is_service_email AS INT) AS is_service, round(service_importance, 6) AS service_importance, CAST(has_unsubscribe_link AS INT) AS has_unsub, "
    "CAST(from_common_service_domain AS INT) AS common_domain, CASE service_type WHEN 'transactional' THEN 1 WHEN 'notification' THEN 2 WHEN 'newsletter' THEN 3 "
    "WHEN 'marketing' THEN 4 WHEN 'social' THEN 5 ELSE 0 END AS service_type_code FROM features",
    ("features",),
    casts="is_service DOUBLE, has_unsub DOUBLE, common_domain DOUBLE, service_type_code DOUBLE",
)
def j3(spark, d):
    return present(clusters.service_matrix(table(spark, d, "features"), table(spark, d, "labelled")))


@query(
    "J4_temporal_matrix",
    "SELECT email_id, hour_of_day, day_of_week, CAST(is_business_hours AS INT) AS is_business, CAST(is_weekend AS INT) AS is_weekend FROM features",
    ("features",),
    casts="hour_of_day DOUBLE, day_of_week DOUBLE, is_business DOUBLE, is_weekend DOUBLE",
)
def j4(spark, d):
    return present(clusters.temporal_matrix(table(spark, d, "features"), table(spark, d, "labelled")))


@query("J5_cluster")
def j5(spark, d):
    """Iterative: checked by invariants in the tests."""
    matrix = clusters.people_matrix(table(spark, d, "features"), table(spark, d, "labelled"))
    return present(clusters.cluster(matrix, "people", restarts=2))


@query(
    "J6_membership",
    "SELECT email_id, cluster, round(distance, 6) AS distance, round(1 - distance / (SELECT max(distance) FROM placed), 6) AS prob FROM placed",
    ("vectors",),
    f"{centroid_sql('c', 'vectors', 'label').strip()}, placed AS (SELECT email_id, label AS cluster, {distance_sql('embedding', 'centroid')} AS distance FROM vectors JOIN c ON c.g = label)",
)
def j6(spark, d):
    v = table(spark, d, "vectors")
    placed = v.join(vec.centroid(v, ["label"]), "label").select(
        "email_id", F.col("label").alias("cluster"), V.cosine_distance("embedding", "centroid").alias("distance")
    )
    return present(clusters.membership(placed))


@query("J7_cluster_content")
def j7(spark, d):
    """Iterative: checked by invariants in the tests."""
    rows = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    return present(clusters.cluster_content(rows, restarts=1))


def _cluster_checks(points, assigned, tolerance):
    """Per point: its reported distance is that to its members' mean, and no other mean is clearly nearer."""
    rows = points.join(assigned, "email_id")
    means = vec.centroid(rows, ["cluster"], "point").select("cluster", F.col("centroid").alias("mean"))
    # at most 100 means: one row of all of them beside each point
    every = means.agg(F.collect_list("mean").alias("means"))
    rows = rows.join(F.broadcast(means), "cluster").withColumn("means", every.scalar())

    def apart(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))

    point = F.col("point").cast("array<double>")
    own = apart(point, F.col("mean"))
    least = F.array_min(F.transform("means", lambda m: apart(point, m)))
    return rows.select(
        "email_id", (F.abs(F.col("distance") - own) <= tolerance).alias("distance_to_mean"), (own <= least + tolerance).alias("nearest_mean"))


@query("J7_cluster_invariants", "SELECT vec_id AS email_id, true AS distance_to_mean, true AS nearest_mean FROM embeddings")
def j7_invariants(spark, d):
    rows = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    assigned = clusters.cluster_content(rows, restarts=1)
    return _cluster_checks(rows.select("email_id", F.col("embedding").alias("point")), assigned, 0.01)


@query("J5_cluster_invariants", "SELECT id AS email_id, true AS distance_to_mean, true AS nearest_mean FROM messages WHERE NOT is_sent", ("messages",))
def j5_invariants(spark, d):
    """On the temporal columns, standardised again here."""
    matrix = clusters.temporal_matrix(table(spark, d, "features"), table(spark, d, "labelled"))
    columns = [c for c in matrix.columns if c != "email_id"]
    stats = matrix.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev(c).alias("s")).alias(c) for c in columns]).alias("stats"))
    scaled = matrix.withColumn("_s", stats.scalar()).select("email_id", F.array(*[
        F.when(F.col(f"_s.{c}.s") > 0, (F.col(c) - F.col(f"_s.{c}.m")) / F.col(f"_s.{c}.s")).otherwise(0.0) for c in columns]).alias("point"))
    return _cluster_checks(scaled, clusters.cluster(matrix, "temporal", restarts=2), 0.05)


@query("J7_density_clusters")
def j7_density(spark, d):
    """Density clusters with noise; compared with the definition on planted groups in the tests."""
    rows = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    return present(density.density_clusters(rows, min_cluster_size=20, min_samples=5))


@query(
    "J7_density_invariants",
    "SELECT vec_id AS email_id, true AS large_enough, true AS in_range, true AS noise_is_zero FROM embeddings",
)
def j7_density_invariants(spark, d):
    """Every cluster has the least size, noise has no degree and members have one above 0."""
    rows = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    found = density.density_clusters(rows, min_cluster_size=20, min_samples=5)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "cluster").select(
        "email_id", ((F.col("cluster") == -1) | (F.col("n") >= 20)).alias("large_enough"), F.col("prob").between(0, 1).alias("in_range"),
        ((F.col("cluster") == -1) == (F.col("prob") == 0)).alias("noise_is_zero"))


@query("J7_cluster_count", "SELECT count(DISTINCT content_cluster_id) AS n_clusters FROM assignments WHERE content_cluster_id <> -1", ("assignments",))
def j7_count(spark, d):
    a = table(spark, d, "assignments").filter("content_cluster_id IS NOT NULL")
    return clusters.cluster_count(a.withColumnRenamed("content_cluster_id", "cluster"))


@query(
    "J8_cluster_assignments",
    "SELECT a.email_id, people_cluster_id, CASE WHEN content_cluster_id IS NOT NULL THEN content_cluster_id END AS content_cluster_id, behavior_cluster_id, "
    "service_cluster_id, temporal_cluster_id, 1.0 AS people_cluster_prob, CASE WHEN content_cluster_id IS NOT NULL THEN 0.5 END AS content_cluster_prob FROM assignments a",
    ("assignments",),
    casts="people_cluster_prob DOUBLE, content_cluster_prob DOUBLE",
)
def j8(spark, d):
    a = table(spark, d, "assignments")

    def part(name, prob=None):
        rows = a.select("email_id", F.col(f"{name}_cluster_id").alias("cluster")).filter(F.col("cluster").isNotNull())
        return rows if prob is None else rows.withColumn("prob", F.lit(prob))

    return clusters.cluster_assignments(part("people", 1.0), part("content", 0.5), part("behavior"), part("service"), part("temporal"))


UNPIVOT = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {dim}_cluster_id AS cluster_id, email_id FROM assignments WHERE {dim}_cluster_id IS NOT NULL"
    for dim in K.DIMENSIONS
)


@query(
    "J9_cluster_rollup",
    """
    SELECT dimension, cluster_id, count(*) AS size, round(avg(CASE WHEN l.action = 'REPLIED' THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct_replied,
      round(avg(coalesce(l.response_time_seconds / 3600.0, 0)), 1) AS avg_response_time_hours,
      CAST(round(CAST(avg(coalesce(f.relationship_strength, 0)) AS DECIMAL(20, 10)), 3) AS DOUBLE) AS avg_relationship_strength, min(u.email_id) AS representative_email_id
    FROM u JOIN labelled l ON l.id = u.email_id LEFT JOIN features f ON f.email_id = u.email_id GROUP BY dimension, cluster_id
    """,
    ("labelled", "features", "assignments"),
    f"u AS ({UNPIVOT})",
)
def j9(spark, d):
    return clusters.cluster_rollup(table(spark, d, "assignments"), table(spark, d, "labelled"), table(spark, d, "features"))


# ------------------------------------------------------------------ priority

COMPONENTS = f"""
    fscore AS (SELECT email_id, least(1.0, greatest(0.0, CASE WHEN is_service_email THEN service_importance * 0.5 + urgency_score * 0.5
      ELSE relationship_strength * 0.6 + urgency_score * 0.4 END)) AS feature_score FROM features),
    replied_vectors AS (SELECT v.* FROM vectors v JOIN labelled l ON l.id = v.email_id WHERE l.action = 'REPLIED'),
    {centroid_sql("rc", "replied_vectors", "0").strip()},
    k2 AS (SELECT email_id, 1 - {distance_sql("embedding", "centroid")} AS x FROM vectors, rc),
    clustered AS (SELECT v.email_id, v.embedding, a.content_cluster_id AS cid FROM vectors v JOIN assignments a USING (email_id)),
    placed AS (SELECT * FROM clustered WHERE cid <> -1),
    {centroid_sql("cc", "placed", "cid").strip()},
    k3 AS (SELECT email_id, CASE WHEN cid = -1 THEN 1.0 WHEN centroid IS NULL THEN 0.5 ELSE {distance_sql("embedding", "centroid")} END AS x
      FROM clustered LEFT JOIN cc ON cc.g = cid),
    sent_by AS (SELECT v.email_id, v.embedding, l.from_email FROM vectors v JOIN labelled l ON l.id = v.email_id WHERE NOT l.is_sent),
    busy AS (SELECT * FROM sent_by WHERE from_email IN (SELECT from_email FROM sent_by GROUP BY 1 HAVING count(*) >= 3)),
    {centroid_sql("sc", "busy", "from_email").strip()},
    k4 AS (SELECT email_id, CASE WHEN centroid IS NULL THEN 0.5 ELSE {distance_sql("embedding", "centroid")} END AS x
      FROM sent_by LEFT JOIN sc ON sc.g = from_email),
    n2 AS (SELECT email_id, (x - (SELECT min(x) FROM k2)) / (SELECT max(x) - min(x) FROM k2) AS x FROM k2),
    n3 AS (SELECT email_id, (x - (SELECT min(x) FROM k3)) / (SELECT max(x) - min(x) FROM k3) AS x FROM k3),
    n4 AS (SELECT email_id, (x - (SELECT min(x) FROM k4)) / (SELECT max(x) - min(x) FROM k4) AS x FROM k4),
    blended AS (SELECT email_id, feature_score, coalesce(n2.x, 0.5) AS replied_similarity, coalesce(n3.x, 0.5) AS cluster_novelty,
      coalesce(n4.x, 0.5) AS sender_novelty, feature_score * 0.35 + coalesce(n2.x, 0.5) * 0.3 + coalesce(n3.x, 0.5) * 0.2 + coalesce(n4.x, 0.5) * 0.15
        AS priority_score FROM fscore LEFT JOIN n2 USING (email_id) LEFT JOIN n3 USING (email_id) LEFT JOIN n4 USING (email_id)),
    flagged AS (SELECT b.*, CASE WHEN priority_score >= 0.7 THEN 'high_priority' WHEN l.action = 'REPLIED' THEN 'replied_training'
      WHEN priority_score >= 0.5 AND l.action = 'IGNORED' THEN 'high_priority_ignored' WHEN a.content_cluster_id = -1 AND priority_score >= 0.4 THEN 'novel_content' END AS llm_reason
      FROM blended b JOIN labelled l ON l.id = b.email_id LEFT JOIN assignments a ON a.email_id = b.email_id)
"""
PRIORITY = {"blocks": ("labelled", "features", "vectors", "assignments"), "extra": COMPONENTS}
SIX = "SELECT email_id, round(x, 6) AS %s FROM %s"


@query("K1_feature_score", "SELECT email_id, round(feature_score, 6) AS feature_score FROM fscore", **PRIORITY)
def k1(spark, d):
    return present(priority.feature_score(table(spark, d, "labelled"), table(spark, d, "features")))


@query("K2_replied_similarity", SIX % ("replied_similarity", "n2"), **PRIORITY)
def k2(spark, d):
    return present(priority.replied_similarity(table(spark, d, "vectors"), table(spark, d, "labelled")))


@query("K3_cluster_novelty", SIX % ("cluster_novelty", "n3"), **PRIORITY)
def k3(spark, d):
    return present(priority.cluster_novelty(table(spark, d, "vectors"), table(spark, d, "assignments")))


@query("K4_sender_novelty", SIX % ("sender_novelty", "n4"), **PRIORITY)
def k4(spark, d):
    return present(priority.sender_novelty(table(spark, d, "vectors"), table(spark, d, "labelled")))


BLEND_COLUMNS = "email_id, round(feature_score, 6) AS feature_score, round(replied_similarity, 6) AS replied_similarity, " \
    "round(cluster_novelty, 6) AS cluster_novelty, round(sender_novelty, 6) AS sender_novelty, round(priority_score, 6) AS priority_score"


@query("K5_combine_priority", f"SELECT {BLEND_COLUMNS} FROM blended", **PRIORITY)
def k5(spark, d):
    m, v = table(spark, d, "labelled"), table(spark, d, "vectors")
    return present(priority.combine_priority(
        priority.feature_score(m, table(spark, d, "features")), priority.replied_similarity(v, m),
        priority.cluster_novelty(v, table(spark, d, "assignments")), priority.sender_novelty(v, m),
    ))


@query(
    "K6_llm_flags",
    "SELECT p.email_id, CASE WHEN priority_score >= 0.7 THEN 'high_priority' WHEN l.action = 'REPLIED' THEN 'replied_training' "
    "WHEN priority_score >= 0.5 AND l.action = 'IGNORED' THEN 'high_priority_ignored' WHEN a.content_cluster_id = -1 AND priority_score >= 0.4 "
    "THEN 'novel_content' END AS llm_reason, llm_reason IS NOT NULL AS needs_llm_analysis FROM priority p JOIN labelled l ON l.id = p.email_id "
    "LEFT JOIN assignments a ON a.email_id = p.email_id",
    ("priority", "labelled", "assignments"),
)
def k6(spark, d):
    out = priority.llm_flags(table(spark, d, "priority"), table(spark, d, "labelled"), table(spark, d, "assignments"))
    return out.select("email_id", "llm_reason", "needs_llm_analysis")


@query(
    "K7_priority_rank",
    "SELECT l_orderkey * 10 + l_linenumber AS email_id, row_number() OVER (ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) AS priority_rank FROM lineitem",
)
def k7(spark, d):
    """Eleven distinct scores over all line items: heavy ties in the ranking key."""
    rows = driver_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("email_id"), F.col("l_discount").alias("priority_score")
    )
    return priority.priority_rank(rows).select("email_id", "priority_rank")


@query(
    "K8_rank_messages",
    f"SELECT {BLEND_COLUMNS}, llm_reason, llm_reason IS NOT NULL AS needs_llm_analysis, "
    "row_number() OVER (ORDER BY flagged.priority_score DESC, email_id) AS priority_rank FROM flagged",
    **PRIORITY,
)
def k8(spark, d):
    return present(priority.rank_messages(
        table(spark, d, "labelled"), table(spark, d, "features"), table(spark, d, "vectors"), table(spark, d, "assignments")
    ))


# ------------------------------------------------------------------ cluster activity and projects

ACTIVITY = f"""
    members AS (SELECT content_cluster_id AS cluster_id, m.id, m.from_email, m.date_s FROM assignments a JOIN messages m ON m.id = a.email_id
      WHERE content_cluster_id IS NOT NULL),
    activity AS (SELECT cluster_id, max(date_s) AS last_activity, count(DISTINCT id) AS email_count, count(DISTINCT from_email) AS participant_count
      FROM members GROUP BY cluster_id),
    tail_counts AS (SELECT cluster_id, min(date_s) AS first_activity, max(date_s) AS last_activity, count(*) AS total_count,
      count(*) FILTER (date_s > {NOW_S} - 7 * 86400) AS emails_7d, count(*) FILTER (date_s > {NOW_S} - 30 * 86400) AS emails_30d,
      count(*) FILTER (date_s > {NOW_S} - 14 * 86400 AND date_s <= {NOW_S} - 7 * 86400) AS emails_prev_7d FROM members GROUP BY cluster_id),
    content AS (SELECT m.*, a.last_activity, coalesce(a.participant_count, 0) AS people, floor(({NOW_S} - a.last_activity) / 86400.0) AS days
      FROM meta m LEFT JOIN activity a USING (cluster_id) WHERE dimension = 'content'),
    points AS (SELECT *,
      CASE WHEN size >= 5 THEN least(size / 50.0, 1.0) * 0.25 ELSE 0 END + CASE WHEN pct_replied >= 20 THEN least(pct_replied / 50.0, 1.0) * 0.3 ELSE 0 END
      + CASE WHEN people >= 2 THEN least(people / 10.0, 1.0) * 0.2 ELSE 0 END
      + CASE WHEN days < 14 THEN greatest(0, 1 - days / 14.0) * 0.25 ELSE 0 END + CASE WHEN coherence_score >= 0.5 THEN coherence_score * 0.1 ELSE 0 END AS score,
      CASE WHEN last_activity IS NULL THEN 'stale' WHEN days > 30 THEN 'completed' WHEN days > 14 THEN 'stale' ELSE 'active' END AS fresh
      FROM content)
"""
CLUSTERED = {"blocks": ("messages", "assignments", "meta"), "extra": ACTIVITY}


def _activity(spark, d):
    return projects.cluster_activity(table(spark, d, "assignments"), table(spark, d, "messages"))


@query("N1_cluster_activity", "SELECT * FROM activity", **CLUSTERED)
def n1(spark, d):
    return present(_activity(spark, d))


@query(
    "N2_project_score",
    """
    SELECT cluster_id, round(CAST(score AS DOUBLE), 6) AS score, concat_ws(', ', CASE WHEN size >= 5 THEN concat('size=', size) END,
      CASE WHEN pct_replied >= 20 THEN printf('engagement=%.1f%%', pct_replied) END, CASE WHEN people >= 2 THEN concat('participants=', people) END,
      CASE WHEN days < 14 THEN concat('days_since=', CAST(days AS INT)) END, CASE WHEN coherence_score >= 0.5 THEN printf('coherence=%.2f', coherence_score) END) AS reason
    FROM points
    """,
    **CLUSTERED,
)
def n2(spark, d):
    out = projects.detect_projects(table(spark, d, "meta"), _activity(spark, d), now())
    return present(out.select("cluster_id", F.col("confidence").alias("score"), "reason"))


@query("N3_project_status", "SELECT cluster_id, fresh AS status FROM points", **CLUSTERED)
def n3(spark, d):
    rows = table(spark, d, "meta").filter("dimension = 'content'").join(_activity(spark, d), "cluster_id", "left")
    return rows.select("cluster_id", S.project_status(F.col("last_activity"), now(), projects.ProjectRules()).alias("status"))


@query(
    "N4_detect_projects",
    "SELECT cluster_id, score >= 0.4 AS is_project, CASE WHEN score >= 0.4 THEN fresh END AS status, round(CAST(score AS DOUBLE), 6) AS confidence "
    "FROM points",
    **CLUSTERED,
)
def n4(spark, d):
    out = projects.detect_projects(table(spark, d, "meta"), _activity(spark, d), now())
    return present(out.drop("reason", "last_activity"))


@query(
    "N4_detection_summary",
    "SELECT count(*) AS clusters_analyzed, count(*) FILTER (score >= 0.3) AS projects_detected, count(*) FILTER (score >= 0.3 AND fresh = 'active') AS active_projects, "
    "count(*) FILTER (score >= 0.3 AND fresh = 'stale') AS stale_projects, count(*) FILTER (score >= 0.3 AND fresh = 'completed') AS completed_projects FROM points",
    **CLUSTERED,
)
def n4_summary(spark, d):
    return projects.detection_summary(projects.detect_projects(table(spark, d, "meta"), _activity(spark, d), now(), min_score=0.3))


@query(
    "N4_apply_detection",
    "SELECT m.dimension, m.cluster_id, m.is_project OR coalesce(p.score >= 0.4, false) AS is_project, "
    "CASE WHEN p.score >= 0.4 THEN p.fresh ELSE m.project_status END AS project_status, CASE WHEN p.score >= 0.4 THEN coalesce(p.last_activity, m.activity_s) ELSE m.activity_s END AS last_activity_at "
    "FROM meta m LEFT JOIN points p ON p.cluster_id = m.cluster_id AND p.dimension = m.dimension",
    **CLUSTERED,
)
def n4_apply(spark, d):
    meta = table(spark, d, "meta")
    out = projects.apply_detection(meta, projects.detect_projects(meta, _activity(spark, d), now()))
    return present(out.select("dimension", "cluster_id", "is_project", "project_status", "last_activity_at"))


@query(
    "N5_refresh_project_status",
    "SELECT count(*) FILTER (fresh <> project_status AND fresh = 'active') AS to_active, count(*) FILTER (fresh <> project_status AND fresh = 'stale') AS to_stale, "
    "count(*) FILTER (fresh <> project_status AND fresh = 'completed') AS to_completed, count(*) FILTER (fresh = project_status) AS unchanged FROM points WHERE is_project",
    **CLUSTERED,
)
def n5(spark, d):
    return projects.refresh_project_status(table(spark, d, "meta"), _activity(spark, d), now())[1]


@query(
    "N5_refreshed_metadata",
    "SELECT m.dimension, m.cluster_id, CASE WHEN m.is_project THEN p.fresh ELSE m.project_status END AS project_status FROM meta m "
    "LEFT JOIN points p ON p.cluster_id = m.cluster_id AND p.dimension = m.dimension",
    **CLUSTERED,
)
def n5_meta(spark, d):
    out = projects.refresh_project_status(table(spark, d, "meta"), _activity(spark, d), now())[0]
    return out.select("dimension", "cluster_id", "project_status")


@query(
    "N6_project_summary",
    "SELECT count(*) FILTER (is_project) AS total_projects, count(*) FILTER (is_project AND project_status = 'active') AS active_projects, count(*) AS total_content_clusters "
    "FROM meta WHERE dimension = 'content'",
    ("meta",),
)
def n6(spark, d):
    return projects.project_summary(table(spark, d, "meta"))[0]


@query(
    "N6_top_projects",
    "SELECT cluster_id, auto_label AS label, size, pct_replied AS engagement FROM meta WHERE dimension = 'content' AND is_project AND project_status = 'active' "
    "ORDER BY activity_s DESC NULLS LAST, cluster_id LIMIT 10",
    ("meta",),
)
def n6_top(spark, d):
    return projects.project_summary(table(spark, d, "meta"))[1]


@query(
    "N7_enrich_clusters",
    "SELECT dimension, cluster_id, CASE WHEN dimension = 'content' THEN coalesce(a.participant_count, 0) END AS participant_count, "
    "CASE WHEN dimension = 'content' THEN coalesce(a.last_activity, activity_s) ELSE activity_s END AS last_activity_at FROM meta m LEFT JOIN activity a USING (cluster_id)",
    **CLUSTERED,
)
def n7(spark, d):
    out = projects.enrich_clusters(table(spark, d, "meta"), _activity(spark, d))
    return present(out.select("dimension", "cluster_id", "participant_count", "last_activity_at"))


@query("N8_temporal_activity", "SELECT * FROM tail_counts", **CLUSTERED)
def n8(spark, d):
    return present(projects.temporal_activity(table(spark, d, "assignments"), table(spark, d, "messages"), now()))


@query(
    "N9_temporal_strength",
    f"""
    SELECT cluster_id, round(v, 6) AS activity_velocity, round(t, 6) AS activity_trend,
      round(exp(-floor(({NOW_S} - last_activity) / 86400.0) * ln(2) / 7) * 0.35 + v * 0.35 + (t + 1) / 2 * 0.3, 6) AS temporal_strength
    FROM (SELECT *, least(emails_7d / 7.0, 5.0) / 5.0 AS v, CASE WHEN emails_prev_7d > 0 THEN greatest(-1.0, least(1.0, (emails_7d - emails_prev_7d) / emails_prev_7d))
      WHEN emails_7d > 0 THEN 1.0 ELSE 0.0 END AS t FROM tail_counts)
    """,
    **CLUSTERED,
)
def n9(spark, d):
    rows = projects.temporal_activity(table(spark, d, "assignments"), table(spark, d, "messages"), now())
    return present(projects.temporal_strength(rows, now()).select("cluster_id", "activity_velocity", "activity_trend", "temporal_strength"))


@query(
    "N10_cluster_stats",
    "SELECT count(*) AS total_clusters, CAST(sum(size) AS BIGINT) AS total_emails, round(avg(size), 6) AS avg_cluster_size, max(size) AS largest_cluster_size, "
    "min(size) AS smallest_cluster_size, count(auto_label) AS labeled_clusters, count(*) FILTER (is_project) AS project_clusters, "
    "count(*) FILTER (is_project AND project_status = 'active') AS active_projects FROM meta WHERE dimension = 'content'",
    ("meta",),
)
def n10(spark, d):
    return present(projects.cluster_stats(table(spark, d, "meta"), "content"))


@query(
    "N11_list_clusters",
    "SELECT cluster_id, size FROM meta WHERE dimension = 'people' ORDER BY size DESC, cluster_id LIMIT 5 OFFSET 3", ("meta",),
)
def n11(spark, d):
    return projects.list_clusters(table(spark, d, "meta"), "people", limit=5, offset=3)[0].select("cluster_id", "size")


@query(
    "N11_list_projects",
    "SELECT cluster_id, project_status FROM meta WHERE dimension = 'content' AND is_project ORDER BY activity_s DESC NULLS LAST, cluster_id LIMIT 3 OFFSET 1",
    ("meta",),
)
def n11_projects(spark, d):
    return projects.list_projects(table(spark, d, "meta"), limit=3, offset=1)[0].select("cluster_id", "project_status")
