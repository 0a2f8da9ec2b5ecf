"""JSON lines and provider API messages (operators A2, A3), and B15."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.functions import normalize as N
from mailgrain.schemas import API_MESSAGE, MESSAGE, MESSAGE_JSON


def read_message_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A2: message rows of JSON-lines files; blank lines are skipped."""
    return spark.read.schema(MESSAGE_JSON).json(path)


def _header(headers: Column, name: str) -> Column:
    """Value of a header; the last one wins, as in a dictionary."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def _decoded(data: Column) -> Column:
    return F.make_valid_utf8(F.unbase64(F.translate(data, "-_", "+/")).cast("string"))


PARTS = "plain array<string>, html array<string>, attached boolean"


def walk_parts(payload: dict | None) -> tuple[list[str], list[str], bool]:
    """Encoded plain and HTML bodies of a message in document order, and whether a part is an attachment.

    Parts may be nested to any depth.  A part that counts as plain text never counts as HTML.
    """
    plain, html, attached = [], [], False
    waiting = [(payload, True)] if isinstance(payload, dict) else []
    while waiting:
        part, top = waiting.pop()
        kind, data = part.get("mimeType") or "", (part.get("body") or {}).get("data")
        if data:
            if "text/plain" in kind:
                plain.append(data)
            elif "text/html" in kind:
                html.append(data)
        if not top:
            named = {(h.get("name") or "").lower(): (h.get("value") or "").lower() for h in part.get("headers") or [] if isinstance(h, dict)}
            attached = attached or bool(part.get("filename")) or "attachment" in named.get("content-disposition", "")
        waiting += [(p, False) for p in reversed(part.get("parts") or []) if isinstance(p, dict)]
    return plain, html, attached


def _parts(documents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in documents:
        found = []
        for text in series:
            try:
                payload = json.loads(text).get("payload") if text else None
            except (ValueError, AttributeError):
                payload = None
            found.append(walk_parts(payload))
        yield pd.DataFrame(found, columns=["plain", "html", "attached"])


def _first_body(bodies: Column) -> Column:
    """First body that is not empty."""
    return F.try_element_at(F.filter(F.transform(bodies, _decoded), lambda b: b != ""), F.lit(1))


def parse_api_messages(df: DataFrame, column: str = "json", now=None) -> DataFrame:
    """A3: provider JSON documents to message rows; documents without an id are dropped.

    A missing or unreadable date becomes ``now`` (null when not given).
    """
    doc = F.from_json(F.col(column), API_MESSAGE)
    rows = df.withColumn("_m", doc).filter(F.col("_m.id").isNotNull() & (F.col("_m.id") != ""))
    # a schema cannot nest without end, so the part tree is walked in Arrow batches
    rows = rows.withColumn("_p", F.pandas_udf(_parts, PARTS)(F.col(column)))
    headers = F.col("_m.payload.headers")

    def text(name: str) -> Column:
        return F.coalesce(_header(headers, name), F.lit(""))

    sender = N.strict_address_parts(text("from"))
    fallback = F.lit(now).cast("timestamp") if now is not None else F.lit(None).cast("timestamp")
    return rows.select(
        F.col("_m.id").alias("provider_id"),
        F.coalesce(_header(headers, "message-id"), F.concat(F.lit("<"), F.col("_m.id"), F.lit("@gmail.com>"))).alias("message_id"),
        F.coalesce("_m.threadId", F.lit("")).alias("thread_id"),
        F.coalesce("_m.historyId", F.lit("")).alias("history_id"),
        F.coalesce("_m.labelIds", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("_m.snippet", F.lit("")).alias("snippet"),
        F.coalesce("_m.sizeEstimate", F.lit(0)).alias("size_bytes"),
        text("subject").alias("subject"),
        sender["email"].alias("from_email"),
        sender["name"].alias("from_name"),
        N.address_list_quoted(text("to")).alias("to_emails"),
        N.address_list_quoted(text("cc")).alias("cc_emails"),
        F.coalesce(N.parse_mail_date(text("date")), fallback).alias("date_parsed"),
        _header(headers, "in-reply-to").alias("in_reply_to"),
        N.reference_ids(text("references")).alias("references"),
        F.coalesce(_first_body(F.col("_p.plain")), F.lit("")).alias("body_text"),
        _first_body(F.col("_p.html")).alias("body_html"),
        F.coalesce("_p.attached", F.lit(False)).alias("has_attachments"),
    )


def _null_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def build_messages(raw: DataFrame) -> DataFrame:
    """Archive or JSON-lines rows to the message table, without the surrogate ``id``."""
    sender = N.address_parts("from")
    body = N.sanitize_text("body")
    columns = set(raw.columns)

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)

    return raw.select(
        "message_id",
        "thread_id",
        N.null_if_blank(N.sanitize_text("in_reply_to")).alias("in_reply_to"),
        N.parse_mail_date("date").alias("date_parsed"),
        sender["email"].alias("from_email"),
        sender["name"].alias("from_name"),
        _null_if_empty(N.address_list("to")).alias("to_emails"),
        _null_if_empty(N.address_list("cc")).alias("cc_emails"),
        N.sanitize_text("subject").alias("subject"),
        body.alias("body_text"),
        N.preview(body).alias("body_preview"),
        N.word_count(body).alias("word_count"),
        _null_if_empty(F.col("labels")).alias("labels"),
        F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
        F.lit(None).cast("int").alias("attachment_count"),
        N.is_sent_label("labels").alias("is_sent"),
        optional("action", "string").alias("action"),
        optional("response_timing", "string").alias("timing"),
        optional("response_time_seconds", "int").alias("response_time_seconds"),
    )


def api_to_messages(parsed: DataFrame) -> DataFrame:
    """B15 for API documents: rows of :func:`parse_api_messages` as the message table, with ids.

    Mail is sent if it has the SENT label; the preview is the raw start of the body and words are split at white space.
    """
    body = N.sanitize_text("body_text")
    rows = parsed.select(
        "message_id", "thread_id", N.null_if_blank(F.col("in_reply_to")).alias("in_reply_to"), "date_parsed", "from_email",
        "from_name", _null_if_empty(F.col("to_emails")).alias("to_emails"), _null_if_empty(F.col("cc_emails")).alias("cc_emails"),
        N.sanitize_text("subject").alias("subject"), body.alias("body_text"), N.raw_preview(body).alias("body_preview"),
        F.coalesce(F.regexp_count(body, F.lit(r"\S+")), F.lit(0)).alias("word_count"), _null_if_empty(F.col("labels")).alias("labels"), "has_attachments",
        F.lit(None).cast("int").alias("attachment_count"),
        F.coalesce(F.array_contains("labels", "SENT"), F.lit(False)).alias("is_sent"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("timing"),
        F.lit(None).cast("int").alias("response_time_seconds"),
    )
    return with_ids(rows).select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])


def with_ids(messages: DataFrame) -> DataFrame:
    """Surrogate ``id`` from the message id: stable under re-runs, no global count needed.

    It is 62 bits of a hash; :func:`id_collisions` counts message ids that share one, and a run refuses to go on with any.
    """
    return messages.select(F.xxhash64("message_id").bitwiseAND((1 << 62) - 1).alias("id"), "*")


def id_collisions(messages: DataFrame) -> DataFrame:
    """``id`` of different messages, and how many share it."""
    return messages.groupBy("id").agg(
        F.min("message_id").alias("_low"), F.max("message_id").alias("_high"), F.count(F.lit(1)).alias("messages")
    ).filter(F.col("_low") < F.col("_high")).select("id", "messages")
