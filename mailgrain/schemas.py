"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _flat(columns: str) -> T.StructType:
    """Schema of plain columns; unlike DDL parsing it needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


MESSAGE_JSON = _flat(
    "message_id string, thread_id string, in_reply_to string, references string, labels array<string>, "
    "date string, date_original string, `from` string, `to` string, cc string, bcc string, subject string, "
    "body string, body_html string, has_attachments boolean, mbox_offset bigint, raw_size_bytes int, "
    "action string, response_timing string, response_time_seconds int"
)

# rows produced by the archive reader; ``error`` is set instead of a message
ARCHIVE_ROW = _flat(
    "message_id string, thread_id string, in_reply_to string, references string, labels array<string>, "
    "date string, `from` string, `to` string, cc string, bcc string, subject string, body string, "
    "body_html string, has_attachments boolean, mbox_offset bigint, raw_size_bytes int, error string"
)

MESSAGE = _flat(
    "id bigint, message_id string, thread_id string, in_reply_to string, date_parsed timestamp, "
    "from_email string, from_name string, to_emails array<string>, cc_emails array<string>, subject string, "
    "body_text string, body_preview string, word_count int, labels array<string>, has_attachments boolean, "
    "attachment_count int, is_sent boolean, action string, timing string, response_time_seconds int"
)

# one provider message; its part tree has no bounded depth and is read apart
API_MESSAGE = (
    "id string, threadId string, historyId string, labelIds array<string>, snippet string, sizeEstimate int, "
    "payload struct<headers: array<struct<name: string, value: string>>>"
)

EVENT = _flat(
    "event_id string, thread_id string, seq bigint, ts bigint, actor string, type string, payload string, "
    "correlation_id string, session_id string, user_id string, org_id string"
)

MODEL_LABEL = _flat(
    "action_type string, urgency string, ai_can_handle string, next_step string, suggested_action string, "
    "one_liner string"
)
CLUSTER_LABEL = _flat("label string, confidence double")
