"""Sender statistics that follow the ingest batch by batch (F1-F5 for Q6).

Nothing here reads mail again.  Each batch of new messages adds rows to three tables:

* ``sender_links``: each message under its own id, and under the id it answers.  A batch looks up the ids it touches, and
  learns from them which questions its messages answer and which of its messages were answered before.
* ``sender_changes``: what the batch changes for each sender: arrivals by hour, questions answered and response time,
  mail the user began, sent mail and its answers.  Rows add up in any order.
* ``sender_arrivals``: arrivals by sender and microsecond, which the 7, 30 and 90-day counts need for the hour that
  the window opens in; hours after it count as wholes.

F5 of some senders is then a sum over the changes of these senders.  Response times are whole microseconds, so sums do not
depend on the order of batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.session import settled
from mailgrain.streaming.store import BatchTables, bucket_of

LINKS = "ref string, own boolean, is_sent boolean, sender string, at bigint"
ADDED = ["n", "replied", "pairs", "micros", "initiated", "sent", "answered"]
CHANGES = "sender string, hour bigint, last_at bigint, " + ", ".join(f"{c} bigint" for c in ADDED)
ARRIVALS = "sender string, at bigint, n bigint"
REFERENCE = "at bigint"
#: what F5 is made of, each a sum over batches (``last_at``: the latest)
SUMS = ["emails_all", "emails_7d", "emails_30d", "emails_90d", "last_at", "replied", "pairs", "micros", "initiated", "sent", "answered"]
HOUR, DAY = 3_600_000_000, 86_400_000_000
WINDOWS = (7, 30, 90)


def _sender() -> Column:
    return F.lower("from_email").alias("sender")


def links_of(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each message under its own id and under the id it answers; columns in ``keep`` come along."""
    at = F.unix_micros("date_parsed").alias("at")
    own = messages.select(F.col("message_id").alias("ref"), F.lit(True).alias("own"), "is_sent", _sender(), at, *keep)
    reply = messages.filter(F.col("in_reply_to").isNotNull()).select(
        F.col("in_reply_to").alias("ref"), F.lit(False).alias("own"), "is_sent", F.lit(None).cast("string").alias("sender"), at, *keep)
    return own.unionByName(reply)


def _changes(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows of the change table: ``sender`` with the given values, zero for the others."""
    columns = {"hour": F.lit(None), "last_at": F.lit(None)} | {c: F.lit(0) for c in ADDED} | values
    return rows.select("sender", *[c.cast("bigint").alias(name) for name, c in columns.items()])


def arrival_changes(messages: DataFrame) -> DataFrame:
    """F1 of a batch: received messages by sender and hour."""
    received = messages.filter(~F.col("is_sent")).select(_sender(), F.unix_micros("date_parsed").alias("at"))
    hours = received.groupBy("sender", F.floor(F.col("at") / HOUR).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
    return _changes(hours, hour=F.col("hour"), last_at=F.col("last_at"), n=F.col("n"))


def begun_changes(messages: DataFrame) -> DataFrame:
    """F3 of a batch: sent messages by recipient."""
    recipients = messages.filter("is_sent").select(F.explode("to_emails").alias("recipient"))
    counts = recipients.groupBy(F.lower("recipient").alias("sender")).agg(F.count(F.lit(1)).alias("n"))
    return _changes(counts, initiated=F.col("n"))


def answer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """F2 and F4 of a batch from the links of the ids it touches, stored (``old``) and its own (``new``).

    A pair of question and answer counts in the batch that brings the later of both, whichever that is.
    """
    rows = new.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False)))
    reply = ~F.col("own")

    def count(*conditions: Column) -> Column:
        met = reply
        for c in conditions:
            met = met & c
        return F.count_if(met)

    fresh, sent, dated = F.col("fresh"), F.col("is_sent"), F.col("at").isNotNull()
    own = F.max(F.when(F.col("own"), F.struct("fresh", "is_sent", "sender", "at"))).alias("mail")
    # summed per id first, so an id that draws a large share of all answers is one row for each task
    by_id = rows.groupBy("ref").agg(
        own,
        count(sent).alias("by_me"), count(sent, fresh).alias("by_me_now"),
        count(sent, dated).alias("dated"), count(sent, dated, fresh).alias("dated_now"),
        F.sum(F.when(reply & sent, F.col("at"))).alias("times"), F.sum(F.when(reply & sent & fresh, F.col("at"))).alias("times_now"),
        count(~sent).alias("to_me"), count(~sent, fresh).alias("to_me_now"),
    ).filter(F.col("mail").isNotNull())
    mail, asked = F.col("mail"), F.col("mail.at")
    now = mail["fresh"]  # the message itself is new: all its answers count, not the new ones alone

    def counted(name: str) -> Column:
        return F.when(now, F.col(name)).otherwise(F.col(f"{name}_now"))

    question = by_id.filter(~mail["is_sent"]).select(
        mail["sender"].alias("sender"),
        ((F.col("by_me") > 0) & (now | (F.col("by_me") == F.col("by_me_now")))).cast("int").alias("replied"),
        F.when(asked.isNotNull(), counted("dated")).otherwise(0).alias("pairs"),
        F.when(asked.isNotNull(), F.coalesce(counted("times"), F.lit(0)) - counted("dated") * asked).otherwise(0).alias("micros"))
    question = question.groupBy("sender").agg(*[F.sum(c).alias(c) for c in ("replied", "pairs", "micros")])
    outgoing = by_id.filter(mail["is_sent"]).select(
        mail["sender"].alias("sender"), now.cast("int").alias("sent"),
        ((F.col("to_me") > 0) & (now | (F.col("to_me") == F.col("to_me_now")))).cast("int").alias("answered"))
    outgoing = outgoing.groupBy("sender").agg(F.sum("sent").alias("sent"), F.sum("answered").alias("answered"))
    return _changes(question, **{c: F.col(c) for c in ("replied", "pairs", "micros")}).unionByName(
        _changes(outgoing, sent=F.col("sent"), answered=F.col("answered")))


def summed_changes(rows: DataFrame) -> DataFrame:
    """Changes with one row for each sender and hour."""
    return rows.groupBy("sender", "hour").agg(F.max("last_at").alias("last_at"), *[F.sum(c).alias(c) for c in ADDED]).select(
        "sender", "hour", "last_at", *ADDED)


def steps_by_batch(messages: DataFrame, links: DataFrame, ref: int) -> DataFrame:
    """What each batch of ``messages`` (column ``batch_no``) adds to the sums of each sender, as rows of :data:`SUMS`.

    ``links`` are those of the messages and, with ``batch_no`` -1, the stored ones of the ids they name.  A pair of question
    and answer counts in the batch that brings the later of both, as in :func:`answer_changes`.
    """
    def rows(df: DataFrame, **values: Column) -> DataFrame:
        columns = {c: F.lit(None if c == "last_at" else 0) for c in SUMS} | values
        return df.select("sender", "batch_no", *[v.cast("bigint").alias(c) for c, v in columns.items()])

    at = F.col("at")
    received = messages.filter(~F.col("is_sent")).select(_sender(), F.unix_micros("date_parsed").alias("at"), "batch_no")
    since = {f"emails_{d}d": F.coalesce(at >= ref - d * DAY, F.lit(False)).cast("int") for d in WINDOWS}
    arrived = rows(received, emails_all=F.lit(1), last_at=at, **since)
    begun = rows(messages.filter("is_sent").select(F.explode("to_emails").alias("recipient"), "batch_no").select(
        F.lower("recipient").alias("sender"), "batch_no"), initiated=F.lit(1))
    # answers of one message that come in one batch are one row: an id that draws many is as many rows as batches
    answer, sent = ~F.col("own"), F.col("is_sent")
    dated = answer & sent & at.isNotNull()
    by_id = links.groupBy("ref", "batch_no").agg(
        F.max(F.when(F.col("own"), F.struct("batch_no", "is_sent", "sender", "at"))).alias("mail"),
        F.count_if(answer & sent).alias("by_me"), F.count_if(answer & ~sent).alias("to_me"),
        F.count_if(dated).alias("dated"), F.sum(F.when(dated, at)).alias("times"))
    whole = Window.partitionBy("ref")

    def first(name: str) -> Column:
        return F.min(F.when(F.col(name) > 0, F.col("batch_no"))).over(whole)

    by_id = by_id.select(
        "batch_no", "by_me", "to_me", "dated", "times", F.max("mail").over(whole).alias("mail"), first("by_me").alias("first_by_me"),
        first("to_me").alias("first_to_me")).filter(F.col("mail").isNotNull())
    mail, here = F.col("mail"), F.col("batch_no")
    asked = mail["at"]
    paired = F.when(~mail["is_sent"] & asked.isNotNull(), F.col("dated")).otherwise(0)
    answers = rows(
        by_id.select(mail["sender"].alias("sender"), F.greatest(here, mail["batch_no"]).alias("batch_no"),
                     paired.alias("pairs"), F.when(paired > 0, F.col("times") - paired * asked).otherwise(0).alias("micros"),
                     (~mail["is_sent"] & (here == F.col("first_by_me"))).cast("int").alias("replied"),
                     (mail["is_sent"] & (here == F.col("first_to_me"))).cast("int").alias("answered"),
                     (mail["is_sent"] & (here == mail["batch_no"])).cast("int").alias("sent")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("pairs", "micros", "replied", "answered", "sent")})
    steps = arrived.unionByName(begun).unionByName(answers).filter(F.col("sender").isNotNull() & (here >= 0))
    return steps.groupBy("sender", "batch_no").agg(*[(F.max if c == "last_at" else F.sum)(c).alias(c) for c in SUMS])


def sums_of(changes: DataFrame, arrivals: DataFrame, ref: int) -> DataFrame:
    """The :data:`SUMS` of the senders in ``changes``; ``ref`` is the newest date of the mailbox in microseconds.

    ``arrivals`` needs the hours that the windows open in (:func:`opening_days`).
    """
    opens = {days: ref - days * DAY for days in WINDOWS}
    # rows added up are hour rows, few for each sender; the partial sums are made map-side
    sums = changes.groupBy("sender").agg(
        F.sum("n").alias("emails_all"),
        *[F.sum(F.when(F.col("hour") > opens[d] // HOUR, F.col("n")).otherwise(0)).alias(f"whole_{d}") for d in WINDOWS],
        F.max("last_at").alias("last_at"), *[F.sum(c).alias(c) for c in ADDED if c != "n"],
    )

    def hour_of(d: int) -> Column:
        return F.floor(F.col("at") / HOUR) == opens[d] // HOUR

    edges = arrivals.filter(hour_of(7) | hour_of(30) | hour_of(90)).groupBy("sender").agg(
        *[F.sum(F.when(hour_of(d) & (F.col("at") >= opens[d]), F.col("n")).otherwise(0)).alias(f"edge_{d}") for d in WINDOWS])
    joined = sums.alias("s").join(edges.alias("e"), F.col("s.sender").eqNullSafe(F.col("e.sender")), "left").drop(F.col("e.sender"))
    counts = {f"emails_{d}d": F.col(f"whole_{d}") + F.coalesce(f"edge_{d}", F.lit(0)) for d in WINDOWS}
    return joined.select("sender", *[counts.get(c, F.col(c)).alias(c) for c in SUMS])


def stats_of(sums: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """F5 of the senders in ``sums`` that have sent any mail."""
    return sums.filter(F.col("emails_all") > 0).select(
        "sender", *keep, "emails_all", *[f"emails_{d}d" for d in WINDOWS],
        F.timestamp_micros("last_at").alias("last_received"),
        F.col("replied").alias("user_replied_count"),
        F.coalesce(F.when(F.col("pairs") > 0, F.col("micros") / 1e6 / F.col("pairs") / 3600), F.lit(0.0)).alias("avg_response_hours"),
        F.col("initiated").alias("user_initiated_count"),
        F.coalesce(F.when(F.col("sent") > 0, F.col("answered") / F.col("sent")), F.lit(0.0)).alias("sender_reply_rate"),
    )


def opening_days(ref: int) -> list[int]:
    """Days in which the 7, 30 and 90-day windows open."""
    return [(ref - d * DAY) // DAY for d in WINDOWS]


def _touched(rows: DataFrame, key: str) -> list[int]:
    """Buckets of the keys in ``rows``: at most ``BUCKETS`` numbers and one for null."""
    return [r["b"] for r in rows.select(bucket_of(key).alias("b")).distinct().collect()]


class SenderState:
    """The three tables in a :class:`BatchTables` store."""

    def __init__(self, tables: BatchTables):
        self.tables = tables

    def stored_links(self, ids: DataFrame) -> DataFrame:
        """Committed links of the ids in the column ``ref`` of ``ids``."""
        rows = self.tables.read("sender_links", LINKS, parts=_touched(ids, "ref"))
        return rows.join(ids.select("ref").distinct(), "ref", "left_semi").select("ref", "own", "is_sent", "sender", "at")

    def add(self, messages: DataFrame, batch: int) -> None:
        """Write what a batch of messages, none of them stored before, changes."""
        tables = self.tables
        new = tables.write("sender_links", batch, links_of(messages))
        # mail without a sender is counted, but F2-F4 have no one to attach to
        others = begun_changes(messages).unionByName(answer_changes(self.stored_links(new), new)).filter(F.col("sender").isNotNull())
        changes = arrival_changes(messages).unionByName(others)
        tables.write("sender_changes", batch, changes)
        received = messages.filter(~F.col("is_sent") & F.col("date_parsed").isNotNull())
        arrivals = received.groupBy(_sender(), F.unix_micros("date_parsed").alias("at")).agg(F.count(F.lit(1)).alias("n"))
        tables.write("sender_arrivals", batch, arrivals)
        tables.write("sender_reference", batch, messages.agg(F.max(F.unix_micros("date_parsed")).alias("at")))

    def reference(self, upto: int | None = None) -> int | None:
        """Newest date of the mailbox in microseconds: one row a batch is read."""
        return self.tables.read("sender_reference", REFERENCE, upto).agg(F.max("at")).first()[0]

    def stats(self, senders: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """F5 of the ``senders`` (column ``sender``), of all without; ``upto`` may name a batch being written."""
        return stats_of(self._sums(self.reference(upto) or 0, senders, upto))

    def stats_by_batch(self, messages: DataFrame, ref: int) -> DataFrame:
        """F5 of the senders of each batch (``batch_no``) of new messages, as known once that batch is in.

        One row for each sender and batch with mail from or to them.  Stored are the batches committed before; ``ref``
        is the newest date of the mailbox in every batch.  A running sum over one sender sees a row for each batch.
        """
        new = links_of(messages, ["batch_no"])
        old = self.stored_links(new).withColumn("batch_no", F.lit(-1).cast("bigint"))
        steps = settled(steps_by_batch(messages, new.unionByName(old), ref))
        known = self._sums(ref, steps.select("sender")).withColumn("batch_no", F.lit(-1).cast("bigint"))
        so_far = Window.partitionBy("sender").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
        sums = known.unionByName(steps).select(
            "sender", "batch_no", *[(F.max if c == "last_at" else F.sum)(c).over(so_far).alias(c) for c in SUMS])
        # stored: what Spark infers from the sums would otherwise be carried through all columns of the features
        return settled(stats_of(sums.filter(F.col("batch_no") >= 0), ["batch_no"]))

    def _sums(self, ref: int, senders: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        tables, days = self.tables, opening_days(ref)
        if senders is None:
            changes, arrivals = tables.read("sender_changes", CHANGES, upto), tables.read("sender_arrivals", ARRIVALS, upto, days)
        else:
            senders = senders.select("sender").distinct()
            changes = tables.read("sender_changes", CHANGES, upto, _touched(senders, "sender")).join(senders, "sender", "left_semi")
            arrivals = tables.read("sender_arrivals", ARRIVALS, upto, days).join(senders, "sender", "left_semi")
        return sums_of(changes, arrivals, ref)

    def compact(self) -> None:
        tables = self.tables
        tables.compact("sender_links", LINKS, bucket_of("ref"))
        tables.compact("sender_changes", CHANGES, bucket_of("sender"), summed_changes)
        tables.compact("sender_arrivals", ARRIVALS, F.floor(F.col("at") / DAY).cast("int"), lambda rows: rows.groupBy("sender", "at").agg(
            F.sum("n").alias("n")))
        tables.compact("sender_reference", REFERENCE, F.lit(0), lambda rows: rows.agg(F.max("at").alias("at")))

