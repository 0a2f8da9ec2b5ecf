"""Model-assisted labelling: queue, prompts, scoring hook, parsing (operators L1-L10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgrain.constants import DIMENSIONS
from mailgrain.functions.normalize import squeeze, strip
from mailgrain.schemas import CLUSTER_LABEL, MODEL_LABEL
from mailgrain.session import bound_batches

Scorer = Callable[[list[str]], list[dict | None]]

MIN_BODY_CHARS = 50
# fixed values: how much of a body the prompts show
BODY_CHARS, PROMPT_CHARS = 800, 500
NO_RANK = 9999

# Keys and values the model is asked for (fixed values: the parsed fields).
ANSWER_FORM = """{
  "action_type": "reply|task|decision|approval|fyi|none",
  "urgency": "immediate|today|this_week|whenever|none",
  "ai_can_handle": "fully|partially|not_at_all",
  "next_step": "skip|quick_action|needs_deep_analysis",
  "suggested_action": "FILE_TO_FOLDER|DRAFT_REPLY|SCHEDULE_MEETING|SUMMARIZE_ATTACHMENT|PREPARE_CONTEXT|null",
  "one_liner": "summary in at most 10 words"
}"""

MESSAGE_PROMPT = (
    "Decide how an assistant should treat this mail. Answer with one JSON object.\n\n"
    "Sender: %s\nSubject: %s\nReceived: %s\n\n%s\n\n"
    "Relationship: %s, %s%% of this sender's mail was answered\n"
    "Important sender: %s\nAutomated: %s\nPriority: %s (rank %s)\nQueue level: %s\n\n"
    "Form of the answer:\n" + ANSWER_FORM.replace("%", "%%")
)

CLUSTER_PROMPTS = {
    "content": "Name the topic shared by a group of %(size)s mails (%(pct_replied)s%% answered, "
    "%(avg_hours)s hours on average) in 2-5 words.\nSender: %(sender)s\nSubject: %(subject)s\nDate: %(date)s\n\n%(body)s",
    "people": "Name the kind of sender in 2-4 words.\nSender: %(sender)s\nRelationship: %(strength)s\n"
    "Answered: %(pct_replied)s%%\nSubject: %(subject)s\nDate: %(date)s\n\n%(body)s",
    "service": "Name the kind of automated mail in 2-4 words.\nSender: %(sender)s\nSubject: %(subject)s\n"
    "Date: %(date)s\n\n%(body)s",
    "behavior": "Name how mail like this is handled in 2-4 words.\nSubject: %(subject)s\nAction: %(action)s\n"
    "Response: %(response_hours)s hours\n\n%(body)s",
    "temporal": "Name the time pattern of this mail in 2-4 words.\nSubject: %(subject)s\nDate: %(date)s",
}
CLUSTER_ANSWER = '\n\nAnswer with {"label": "...", "confidence": 0.0-1.0}.'


def _start(text: str, chars: int | None) -> Column:
    return F.col(text) if chars is None else F.substring(text, 1, chars)


def _eligible(
    messages: DataFrame, classes: DataFrame, body_chars: int | None = BODY_CHARS, keep: Sequence[str] = ()
) -> DataFrame:
    wanted = classes.filter(F.col("predicted_handleability") == "needs_llm").select("email_id", "llm_priority", *keep)
    long_enough = messages.filter(~F.col("is_sent") & (F.length("body_text") > MIN_BODY_CHARS)).select(
        F.col("id").alias("email_id"), "from_email", "subject", "date_parsed", "action", "thread_id",
        _start("body_text", body_chars).alias("body_preview"), *keep,
    )
    return long_enough.join(wanted, ["email_id", *keep])


def llm_queue(
    messages: DataFrame, features: DataFrame, classes: DataFrame, contacts: DataFrame, priority: DataFrame,
    done: DataFrame, limit: int | None = 50, body_chars: int | None = BODY_CHARS, keep: Sequence[str] = (),
) -> DataFrame:
    """L1: messages the rules left open, with their context, by queue level then id.

    ``body_chars`` bounds the body that goes into a prompt; None keeps it whole.  ``keep`` names columns of messages,
    features and classes that come along.
    """
    rows = _eligible(messages, classes, body_chars, keep).join(done.select("email_id"), "email_id", "left_anti")
    rows = rows.join(
        features.select("email_id", "relationship_strength", "user_replied_to_sender_rate", "is_service_email", *keep), ["email_id", *keep]
    )
    people = contacts.select(F.lower("email").alias("_who"), "is_important_sender")
    rows = rows.join(people, F.lower("from_email") == F.col("_who"), "left")
    rows = rows.join(priority.select("email_id", "priority_score", "priority_rank"), "email_id", "left")
    rows = rows.select(
        "email_id", "from_email", "subject", "date_parsed", "body_preview",
        "relationship_strength", "user_replied_to_sender_rate", "is_service_email", "llm_priority",
        F.col("action").alias("actual_action"), "thread_id",
        F.coalesce("is_important_sender", F.lit(False)).alias("is_important_sender"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"),
        F.coalesce("priority_rank", F.lit(NO_RANK)).alias("priority_rank"), *keep,
    )
    return rows if limit is None else rows.orderBy("llm_priority", "email_id").limit(limit)


def llm_queue_status(messages: DataFrame, classes: DataFrame, done: DataFrame) -> DataFrame:
    """L2: ``total, processed, remaining``."""
    total = _eligible(messages, classes).agg(F.count(F.lit(1)).alias("total"))
    processed = done.agg(F.count(F.lit(1))).scalar()
    return total.select("total", processed.alias("processed"), (F.col("total") - processed).alias("remaining"))


def _number(c: Column, digits: int) -> Column:
    """Rounded number as text, ``0`` for zero and null."""
    return F.when(c != 0, F.round(c, digits).cast("string")).otherwise("0")


def build_prompts(queue: DataFrame, body_chars: int | None = PROMPT_CHARS) -> DataFrame:
    """L3: add ``relationship_level`` and ``prompt``; ``body_chars`` of the cleaned body, None for all of it."""
    body = F.coalesce("body_preview", F.lit(""))
    markup = F.lower(body).contains("<html") | F.lower(body).contains("<head")
    flat = strip(squeeze(F.regexp_replace(body, "<[^>]+>", " ")))
    body = F.when(markup, flat).otherwise(body)
    body = body if body_chars is None else F.substring(body, 1, body_chars)
    strength = F.col("relationship_strength")
    level = F.when(strength > 0.6, "STRONG").when(strength > 0.3, "MODERATE").when(strength > 0.1, "WEAK").otherwise("MINIMAL")
    rank = F.when(F.col("priority_rank") < NO_RANK, F.col("priority_rank").cast("string")).otherwise("N/A")
    prompt = F.format_string(
        MESSAGE_PROMPT,
        F.coalesce("from_email", F.lit("None")),
        F.coalesce("subject", F.lit("None")),
        F.coalesce(F.date_format("date_parsed", "yyyy-MM-dd"), F.lit("unknown")),
        F.when(body != "", body).otherwise("(empty body)"),
        F.col("relationship_level"),
        _number(F.col("user_replied_to_sender_rate") * 100, 1),
        F.when(F.col("is_important_sender"), "Yes (high engagement history)").otherwise("No"),
        F.when(F.col("is_service_email"), "Yes").otherwise("No"),
        _number(F.col("priority_score"), 2),
        rank,
        F.col("llm_priority").cast("string"),
    )
    return queue.withColumn("relationship_level", level).withColumn("prompt", prompt)


SCORED = "raw_response string, prompt_tokens int, completion_tokens int, total_tokens int, error string"


def score_with(prompts: DataFrame, scorer: Scorer, keep: list[str], batch: int = 100) -> DataFrame:
    """L4: run a user-supplied batch scorer over ``prompt``.

    The scorer maps a list of prompts to dicts with ``response`` and optional
    ``prompt_tokens``/``completion_tokens``.  A row it fails on is kept with a
    null response and the error text.
    """
    bound_batches(prompts.sparkSession)
    keep_types = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                answers = _answers(scorer, part["prompt"].tolist())
                yield pd.concat([part[keep + ["prompt"]].reset_index(drop=True), pd.DataFrame(answers, columns=_ANSWER_COLUMNS)], axis=1)

    return prompts.select(*keep, "prompt").mapInPandas(run, f"{keep_types}, prompt string, {SCORED}")


_ANSWER_COLUMNS = ["raw_response", "prompt_tokens", "completion_tokens", "total_tokens", "error"]


def _answers(scorer: Scorer, prompts: list[str]) -> list[tuple]:
    try:
        replies = scorer(prompts)
    except Exception:
        replies = []
        for prompt in prompts:
            try:
                replies.append((scorer([prompt]) or [None])[0])
            except Exception as problem:
                replies.append(problem)
    # a scorer that returns fewer or more replies than prompts cannot be matched to them
    if len(replies) != len(prompts):
        replies = [None] * len(prompts)
    return [_answer(reply) for reply in replies]


def _answer(reply) -> tuple:
    if not isinstance(reply, dict):
        return None, None, None, None, str(reply) if reply is not None else "no answer"
    asked, given = int(reply.get("prompt_tokens", 0)), int(reply.get("completion_tokens", 0))
    return reply["response"].strip(), asked, given, asked + given, None


_CORRUPT = "_unparsed"


def json_text(c: Column) -> Column:
    """The fenced block of a model reply if it has one, else the reply."""
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)


def parse_model_json(c: Column | str, schema: T.StructType = MODEL_LABEL) -> Column:
    """``struct(result, parse_error)`` of a model reply."""
    text = json_text(F.col(c) if isinstance(c, str) else c)
    wide = T.StructType(list(schema.fields) + [T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(text, wide, {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"})
    failed = text.isNotNull() & (parsed.isNull() | parsed[_CORRUPT].isNotNull())
    result = F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields])
    return F.struct(F.when(~failed & text.isNotNull(), result).alias("result"), failed.alias("parse_error"))


def model_labels(scored: DataFrame, key: str = "email_id") -> DataFrame:
    """L4+L5: the label table from scored prompts; failed calls are left out."""
    rows = scored.filter(F.col("error").isNull()).withColumn("p", parse_model_json("raw_response"))
    return rows.select(
        key, json_text(F.col("raw_response")).alias("raw_response"), F.col("prompt").alias("raw_prompt"),
        *[F.col(f"p.result.{f.name}").alias(f.name) for f in MODEL_LABEL.fields],
        "prompt_tokens", "completion_tokens", "total_tokens", F.col("p.parse_error").alias("parse_error"),
    )


def usage_rollup(scored: DataFrame) -> DataFrame:
    """``calls, tokens, errors, saved``."""
    failed = F.col("error").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(F.when(~failed, F.col("total_tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(failed).alias("errors"),
        F.count_if(~failed & F.col("raw_response").isNotNull()).alias("saved"),
    )


def cluster_label_prompts(
    meta: DataFrame, messages: DataFrame, features: DataFrame, body_chars: int | None = PROMPT_CHARS
) -> DataFrame:
    """One prompt per cluster from its representative message, with ``body_chars`` of it (None: all)."""
    sample = messages.select(
        F.col("id").alias("representative_email_id"), "from_email", "subject", "date_parsed",
        _start("body_text", body_chars).alias("_body"), "action", "response_time_seconds",
    )
    strength = features.select(F.col("email_id").alias("representative_email_id"), "relationship_strength")
    rows = meta.filter(F.col("representative_email_id").isNotNull()).join(sample, "representative_email_id")
    rows = rows.join(strength, "representative_email_id", "left")
    values = {
        "size": F.coalesce("size", F.lit(0)).cast("string"),
        "pct_replied": F.coalesce("pct_replied", F.lit(0.0)).cast("string"),
        "avg_hours": F.round(F.coalesce("avg_response_time_hours", F.lit(0.0)), 1).cast("string"),
        "sender": F.coalesce("from_email", F.lit("unknown")),
        "subject": F.coalesce("subject", F.lit("(no subject)")),
        "date": F.coalesce(F.date_format("date_parsed", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown")),
        "body": F.coalesce("_body", F.lit("")),
        "strength": F.round(F.coalesce("relationship_strength", F.lit(0.0)), 2).cast("string"),
        "action": F.coalesce("action", F.lit("unknown")),
        "response_hours": F.round(F.coalesce("response_time_seconds", F.lit(0)) / 3600.0, 1).cast("string"),
    }
    prompt = F.when(F.lit(False), F.lit(""))
    for dimension, template in CLUSTER_PROMPTS.items():
        prompt = prompt.when(F.col("dimension") == dimension, _filled(template + CLUSTER_ANSWER, values))
    return rows.select("dimension", "cluster_id", "representative_email_id", prompt.alias("prompt"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """``%(name)s`` template as a concatenation of literals and columns."""
    pieces, rest = [], template
    while "%(" in rest:
        text, rest = rest.split("%(", 1)
        name, rest = rest.split(")s", 1)
        pieces += [F.lit(text.replace("%%", "%")), values[name]]
    return F.concat(*pieces, F.lit(rest.replace("%%", "%")))


def unlabeled_clusters(meta: DataFrame, dimension: str | None = None, limit: int = 100) -> DataFrame:
    """Clusters without a label, largest first."""
    rows = meta.filter(F.col("auto_label").isNull())
    if dimension is not None:
        rows = rows.filter(F.col("dimension") == dimension)
    return rows.orderBy(F.desc("size"), "dimension", "cluster_id").limit(limit)


def labeling_stats(meta: DataFrame) -> DataFrame:
    """Total, labelled and unlabelled clusters of each of the five dimensions."""
    counted = meta.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("total_clusters"), F.count("auto_label").alias("labeled_clusters")
    )
    dims = meta.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    total = F.coalesce("total_clusters", F.lit(0))
    labelled = F.coalesce("labeled_clusters", F.lit(0))
    return dims.join(counted, "dimension", "left").select(
        "dimension", total.alias("total_clusters"), labelled.alias("labeled_clusters"),
        (total - labelled).alias("unlabeled_clusters"),
    )


def cluster_labels(replies: DataFrame, response: str = "raw_response") -> DataFrame:
    """Label and confidence from replies; an unreadable reply gives its first 50 characters at 0.3."""
    rows = replies.withColumn("p", parse_model_json(response, CLUSTER_LABEL))
    failed = F.col("p.parse_error")
    fallback = strip(F.substring(json_text(F.col(response)), 1, 50))
    label = F.when(failed, fallback).otherwise(F.substring(strip(F.col("p.result.label")), 1, 100))
    confidence = F.when(failed, 0.3).otherwise(F.coalesce("p.result.confidence", F.lit(0.5)))
    return rows.select(
        "dimension", "cluster_id", F.when(label != "", label).alias("label"), confidence.alias("confidence")
    )


def apply_cluster_labels(meta: DataFrame, labels: DataFrame) -> DataFrame:
    """Set ``auto_label`` where a label came back."""
    found = labels.filter(F.col("label").isNotNull()).select("dimension", "cluster_id", F.col("label").alias("_label"))
    return meta.join(found, ["dimension", "cluster_id"], "left").withColumn(
        "auto_label", F.coalesce("_label", "auto_label")
    ).select(*meta.columns)
