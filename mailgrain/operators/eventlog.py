"""Append-only event log per thread (operators P1-P11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.constants import AGENT_CLOSE, AGENT_OPEN, TEXT_SUBMIT, USER_CLOSE, USER_OPEN, VOICE_FINAL
from mailgrain.session import cut_lineage, loose


def latest_seq(log: DataFrame) -> DataFrame:
    """Highest seq per thread."""
    return log.groupBy("thread_id").agg(F.max("seq").alias("latest_seq"))


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """Number new events on from each thread's last seq, in (ts, event_id) order.

    Events are range-partitioned by (thread, ts, id), so a thread, or an hour of one, fills as many tasks as its size
    asks for.  Positions inside the ranges are fixed by a reliable checkpoint; what a thread has in earlier ranges is
    carried over from one row per thread and range.  The numbering depends on ``ts`` and ``event_id`` only, which
    makes a replayed batch give the same numbers.  Events without a thread are left out.
    """
    order = ["thread_id", "ts", "event_id"]
    rows = new.filter(F.col("thread_id").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    # range in the upper 31 bits, position in the lower 33
    rows = cut_lineage(rows.withColumn("_slot", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_slot", 33))
    pieces = rows.groupBy("thread_id", "_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_slot").alias("_first"))
    # a thread has one piece for each range at most
    earlier = Window.partitionBy("thread_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    pieces = pieces.join(latest_seq(log), "thread_id", "left").select(
        "thread_id", "_range", (F.col("_before") + F.coalesce("latest_seq", F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    numbered = rows.join(loose(pieces), ["thread_id", "_range"])
    return numbered.select(*new.columns, (F.col("_offset") + F.col("_slot")).alias("seq"))


def events_after(log: DataFrame, thread_id: str, after: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The next page of a thread, and ``has_more, next_seq``."""
    probe = log.filter((F.col("thread_id") == thread_id) & (F.col("seq") > after)).orderBy("seq").limit(limit + 1)
    page = probe.orderBy("seq").limit(limit)
    more = probe.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > limit).alias("has_more"))
    last = page.agg(F.coalesce(F.max("seq"), F.lit(after).cast("bigint")))
    return page, more.withColumn("next_seq", last.scalar())


def events_by_correlation(log: DataFrame, correlation_id: str) -> DataFrame:
    """P4."""
    return log.filter(F.col("correlation_id") == correlation_id).orderBy("seq")


def events_by_type(log: DataFrame, thread_id: str, kind: str, limit: int = 100) -> DataFrame:
    """P5."""
    return log.filter((F.col("thread_id") == thread_id) & (F.col("type") == kind)).orderBy("seq").limit(limit)


def count_events(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events per thread, or per any other columns."""
    return log.groupBy(*(by or ["thread_id"])).agg(F.count(F.lit(1)).alias("n_events"))


def expand_turns(turns: DataFrame) -> DataFrame:
    """One turn to its open, content and close events.

    Reads ``correlation_id, thread_id, session_id, user_id, org_id, ts,
    input_type`` (text or voice), ``text``, ``confidence`` and ``duration_ms``.
    """
    corr = F.col("correlation_id").alias("correlation_id")
    is_text = F.col("input_type") == "text"

    def event(kind: Column, payload: Column) -> Column:
        return F.struct(kind.alias("type"), payload.alias("payload"))

    opened = event(F.lit(USER_OPEN), F.to_json(F.struct(corr, F.col("input_type").alias("input_type"))))
    content = event(
        F.when(is_text, TEXT_SUBMIT).otherwise(VOICE_FINAL),
        F.when(is_text, F.to_json(F.struct(corr, F.col("text").alias("text")))).otherwise(
            F.to_json(F.struct(corr, F.col("text").alias("transcript"), "confidence", "duration_ms"))
        ),
    )
    closed = event(F.lit(USER_CLOSE), F.to_json(F.struct(corr, F.lit("submit").alias("reason"))))
    rows = turns.select("*", F.posexplode(F.array(opened, content, closed)).alias("pos", "e"))
    return rows.select(
        F.concat_ws("-", "correlation_id", "pos").alias("event_id"), "thread_id", F.col("ts").alias("ts"),
        F.lit("user").alias("actor"), F.col("e.type").alias("type"), F.col("e.payload").alias("payload"),
        "correlation_id", "session_id", "user_id", "org_id",
    )


def turn_timeline(log: DataFrame) -> DataFrame:
    """What happened between an agent's open and close, per correlation id.

    ``status`` is the close reason, ``open`` while it is missing.
    """
    kind = F.col("type")
    frame = kind.isin(AGENT_OPEN, AGENT_CLOSE)
    agent = log.filter((F.col("actor") == "agent") | frame)
    closed = F.when(kind == AGENT_CLOSE, F.get_json_object("payload", "$.reason"))
    return agent.groupBy("correlation_id").agg(
        F.min(F.when(kind == AGENT_OPEN, F.col("ts"))).alias("opened_at"),
        F.max(F.when(kind == AGENT_CLOSE, F.col("ts"))).alias("closed_at"),
        F.count_if(~frame).alias("events_emitted"),
        F.coalesce(F.max(closed), F.lit("open")).alias("status"),
    ).filter(F.col("opened_at").isNotNull())


def active_sessions(sessions: DataFrame) -> DataFrame:
    """Newest active session of every thread."""
    newest = F.max(F.struct("started_at", "session_id")).alias("s")
    return sessions.filter(F.col("status") == "active").groupBy("thread_id").agg(newest).select(
        "thread_id", "s.session_id", "s.started_at"
    )


def list_sessions(sessions: DataFrame, thread_id: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sessions of a thread, newest first, and the total."""
    rows = sessions.filter(F.col("thread_id") == thread_id)
    page = rows.orderBy(F.desc("started_at"), "session_id").offset(offset).limit(limit)
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def list_threads(threads: DataFrame, user_id: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """P10: a user's threads, latest update first, and the total."""
    rows = threads.filter(F.col("user_id") == user_id)
    page = rows.orderBy(F.desc("updated_at"), "thread_id").offset(offset).limit(limit)
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def latest_session_state(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions with the end table ``session_id, ended_at`` applied."""
    ended = ends.groupBy("session_id").agg(F.max("ended_at").alias("_ended"))
    out = sessions.join(ended, "session_id", "left")
    return out.withColumn("status", F.when(F.col("_ended").isNotNull(), "ended").otherwise(F.col("status"))).withColumn(
        "ended_at", F.coalesce("_ended", "ended_at")
    ).select(*sessions.columns)
