"""Incremental ingest and back-fill (operators Q6-Q8, Q11)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailgrain.constants import BACKFILL_PHASES
from mailgrain.functions.clean import prepare_for_embedding
from mailgrain.operators import labeling
from mailgrain.operators.features import message_features
from mailgrain.operators.priority import rank_globally
from mailgrain.operators.rules import classify_messages
from mailgrain.operators.tables import insert_new
from mailgrain.operators.vectors import Encoder, embed
from mailgrain.schemas import MESSAGE
from mailgrain.session import cut_lineage, settled
from mailgrain.streaming.senders import SenderState
from mailgrain.streaming.store import BatchTables


def embedding_inputs(messages: DataFrame, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Messages with the feature columns C10 reads; defaults where features are missing.  ``keep`` comes along."""
    mail = messages.filter(~F.col("is_sent")).select(F.col("id").alias("email_id"), "subject", "body_text", *keep)
    known = features.select("email_id", "is_service_email", "service_importance", "relationship_strength", *keep)
    return mail.join(known, ["email_id", *keep], "left").select(
        "email_id", *keep, "subject", "body_text",
        F.coalesce("is_service_email", F.lit(False)).alias("is_service"),
        F.coalesce("service_importance", F.lit(0.5)).alias("service_importance"),
        F.coalesce("relationship_strength", F.lit(0.5)).alias("relationship_strength"),
    )


VECTORS = "email_id bigint, embedding array<float>, token_count int, content_hash string"
LABELS = (
    "email_id bigint, raw_response string, raw_prompt string, action_type string, urgency string, "
    "ai_can_handle string, next_step string, suggested_action string, one_liner string, prompt_tokens int, "
    "completion_tokens int, total_tokens int, parse_error boolean"
)
CONTACTS = "email string, is_important_sender boolean"
RANKS = "email_id bigint, priority_score double, priority_rank bigint"
COMPACT_EVERY = 100
#: messages that a back-fill takes at a time, whatever the size of its batches
ROUND_MESSAGES = 1_000_000
PROGRESS = ["emails_fetched", "emails_processed", "features_computed", "embeddings_generated", "llm_classified"]
PROGRESS_ROW = "phase_order int, batch_no bigint, " + ", ".join(f"{c} bigint" for c in PROGRESS)


class MailTables(BatchTables):
    """The tables of an ingest job, and the state of its senders."""

    @property
    def senders(self) -> SenderState:
        return SenderState(self)

    def plain(self, name: str, schema) -> DataFrame:
        """A table that a refresh writes as a whole, empty before the first."""
        if self._files().exists(self._path(name)):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)


def new_messages(batch: DataFrame, tables: MailTables, keep: Sequence[str] = ()) -> DataFrame:
    """A4 for a batch: messages whose id is not stored; only the links of the batch's own ids are read.

    Columns in ``keep`` come along; of messages with one id that with the smallest of them counts.
    """
    incoming = batch.select(*keep, *MESSAGE.fieldNames())
    stored = tables.senders.stored_links(incoming.select(F.col("message_id").alias("ref"))).filter("own")
    return insert_new(stored.select(F.col("ref").alias("message_id")), incoming, "message_id")


def ingest_batch(
    batch: DataFrame, tables: MailTables, encoder: Encoder | None = None, scorer: labeling.Scorer | None = None,
    label_limit: int | None = None, phase_order: int = 0,
) -> dict[str, int]:
    """Q6: store the new messages of one batch and everything derived from them.

    Returns the counts that Q8 adds up, and keeps them as a row of the table ``progress``; they are taken while the
    tables are written.  At most ``label_limit`` messages are labelled.

    The batch reads itself, the stored links of the ids it names, and the changes of the senders it has mail from;
    no stored message is read.  It counts once all its tables are written: a batch that fails half-way is
    written again under the same number, and one that comes again adds nothing.
    """
    number = tables.committed() + 1
    mail = tables.write("messages", number, new_messages(batch, tables))
    state = tables.senders
    state.add(mail, number)
    # rows are built for new messages only, with what is known of their senders now
    who = mail.filter(~F.col("is_sent")).select(F.lower("from_email").alias("sender"))
    latest = F.timestamp_micros(F.lit(state.reference(number)).cast("bigint"))
    features = tables.write("features", number, message_features(mail, state.stats(who, number), latest))
    classes = tables.write("classes", number, classify_messages(mail, features))
    counts = {
        "emails_fetched": batch.count(), "emails_processed": tables.written["messages"],
        "features_computed": tables.written["features"], "embeddings_generated": 0, "llm_classified": 0}
    if encoder is not None:
        tables.write("vectors", number, embed(prepare_for_embedding(embedding_inputs(mail, features)), encoder))
        counts["embeddings_generated"] = tables.written["vectors"]
    if scorer is not None and label_limit != 0:
        none = tables.spark.createDataFrame([], LABELS)
        tables.write("labels", number, _labelled(mail, features, classes, tables, scorer, none, label_limit))
        counts["llm_classified"] = tables.written["labels"]
    tables.write("progress", number, tables.spark.createDataFrame([(phase_order, number, *counts.values())], PROGRESS_ROW))
    tables.commit(number)
    if number % COMPACT_EVERY == COMPACT_EVERY - 1:
        state.compact()
    return counts


def ingest_batches(
    batches: DataFrame, last: int, tables: MailTables, encoder: Encoder | None = None, scorer: labeling.Scorer | None = None,
    label_limit: int | None = None, phase_order: int = 0,
) -> dict[str, int]:
    """Q6 for many batches at a time, with the rows that :func:`ingest_batch` would store for one after the other.

    ``batch_no`` tells the batch of a message: numbers after the committed ones up to ``last``, under which all are
    committed at once.  Batches are newest first, so that the newest date of the mailbox is the same in each.  Features
    know of a sender what is stored and what came up to the message's own batch.  Messages, features, classes, vectors
    and labels are stored with their batch.
    """
    by, state = ["batch_no"], tables.senders
    before = tables.committed()
    tables.discard()
    mail = tables.write("messages", last, new_messages(batches, tables, by))
    state.add(mail, last)
    ref = state.reference(last)
    latest = F.timestamp_micros(F.lit(ref).cast("bigint"))
    features = tables.write("features", last, message_features(mail, state.stats_by_batch(mail, ref or 0), latest, by))
    classes = tables.write("classes", last, classify_messages(mail, features, by))
    counted = {"emails_fetched": batches, "emails_processed": mail, "features_computed": features}
    if encoder is not None:
        inputs = prepare_for_embedding(_with_key(embedding_inputs(mail, features, by)), "_key")
        counted["embeddings_generated"] = tables.write("vectors", last, _without_key(embed(inputs, encoder, "_key")))
    if scorer is not None and label_limit != 0:
        counted["llm_classified"] = tables.write("labels", last, _labelled_batches(mail, features, classes, tables, scorer, label_limit))
    rows = reduce(DataFrame.unionByName, [
        df.select("batch_no", *[F.lit(int(c == name)).cast("bigint").alias(c) for c in PROGRESS]) for name, df in counted.items()])
    progress = rows.groupBy("batch_no").agg(*[F.sum(c).alias(c) for c in PROGRESS]).select(
        F.lit(phase_order).alias("phase_order"), F.col("batch_no").cast("bigint").alias("batch_no"), *PROGRESS)
    progress = tables.write("progress", last, progress)
    tables.commit(last)
    if (last + 1) // COMPACT_EVERY > (before + 1) // COMPACT_EVERY:
        state.compact()
    return progress.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in PROGRESS]).first().asDict()


def _with_key(rows: DataFrame) -> DataFrame:
    """Batch and id as one column, for steps that carry a single key."""
    return rows.withColumn("_key", F.concat(F.col("batch_no").cast("string"), F.lit(":"), F.coalesce(F.col("email_id").cast("string"), F.lit(""))))


def _without_key(rows: DataFrame) -> DataFrame:
    part = F.split("_key", ":")
    return rows.select(
        F.nullif(part[1], F.lit("")).cast("bigint").alias("email_id"), part[0].cast("bigint").alias("batch_no"),
        *[c for c in rows.columns if c != "_key"])


def _labelled_batches(
    mail: DataFrame, features: DataFrame, classes: DataFrame, tables: MailTables, scorer: labeling.Scorer, limit: int | None,
) -> DataFrame:
    """Labels of many batches, at most ``limit`` of them in all, earlier batches first.

    A batch asks for as many labels as the batches before it have left.  How many of theirs fail is known only afterwards,
    so batches are taken together as long as the limit cannot end among them, and the one it may end in alone.
    """
    def queued(*wanted: Column, limit: int | None = None) -> DataFrame:
        people, ranked = tables.plain("contacts", CONTACTS), tables.plain("priority", RANKS)
        none = tables.spark.createDataFrame([], LABELS)
        return labeling.llm_queue(*[reduce(DataFrame.filter, wanted, df) for df in (mail, features, classes)], people, ranked, none, limit, keep=["batch_no"])

    def labelled(queue: DataFrame) -> DataFrame:
        prompts = _with_key(labeling.build_prompts(queue))
        return _without_key(labeling.model_labels(labeling.score_with(prompts, scorer, ["_key"]), "_key"))

    if limit is None:
        return labelled(queued())
    done, at = labelled(queued(F.lit(False))), -1
    sizes = settled(queued().groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")))
    while limit > 0:
        # every row has a message or more, so `limit` of them are enough
        ahead = sizes.filter(F.col("batch_no") > at).orderBy("batch_no").limit(limit).collect()
        if not ahead:
            break
        fits = sum(total <= limit for total in accumulate(r["n"] for r in ahead))
        first, at = at, ahead[max(fits, 1) - 1]["batch_no"]
        wave = settled(labelled(queued(F.col("batch_no") > first, F.col("batch_no") <= at, limit=None if fits else limit)))
        done, limit = done.unionByName(wave), limit - wave.count()
    return done


def _labelled(
    mail: DataFrame, features: DataFrame, classes: DataFrame, tables: MailTables, scorer: labeling.Scorer, done: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    # contacts and ranks are those of the last refresh; empty before the first
    people, ranked = tables.plain("contacts", CONTACTS), tables.plain("priority", RANKS)
    queue = labeling.llm_queue(mail, features, classes, people, ranked, done, limit=limit)
    return labeling.model_labels(labeling.score_with(labeling.build_prompts(queue), scorer, ["email_id"]))


def catch_up(
    tables: MailTables, encoder: Encoder | None = None, scorer: labeling.Scorer | None = None, label_limit: int | None = None
) -> None:
    """Vectors and labels for committed messages that have none, as a batch of its own (at most ``label_limit`` labels).

    For mail that came in while no encoder or scorer was given; unlike a batch it reads the stored messages.
    """
    number = tables.committed() + 1
    mail = tables.read("messages", MESSAGE)
    received = mail.filter(~F.col("is_sent"))
    features = tables.read("features", message_features(mail).schema)
    if encoder is not None:
        known = tables.read("vectors", VECTORS)
        inputs = embedding_inputs(received, features).join(known.select("email_id"), "email_id", "left_anti")
        tables.write("vectors", number, embed(prepare_for_embedding(inputs), encoder))
    if scorer is not None:
        classes = tables.read("classes", classify_messages(mail, features).schema)
        done = tables.read("labels", LABELS)
        tables.write("labels", number, _labelled(received, features, classes, tables, scorer, done, label_limit))
    tables.commit(number)


def ingest_stream(
    stream: DataFrame, tables: MailTables, checkpoint: str, encoder: Encoder | None = None,
    scorer: labeling.Scorer | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Q6: run :func:`ingest_batch` on every micro-batch of a message stream.

    Batches are numbered by what is committed in ``tables``, not by the stream, so a stream with a new checkpoint or a
    second one after it goes on where the tables are.  One stream at a time may write to a store.
    """
    writer = stream.writeStream.foreachBatch(
        lambda batch, _: ingest_batch(batch, tables, encoder, scorer)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def phase_partition(messages: DataFrame, now, phases=BACKFILL_PHASES) -> DataFrame:
    """Q7: the back-fill phase of each message with its settings.

    Every message comes back: mail dated after ``now`` is in the first phase, mail without a date or older than the
    last phase has null settings.
    """
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    age = (F.unix_micros(at) - F.unix_micros("date_parsed")) / 86_400_000_000
    chosen = F.when(F.lit(False), F.struct(*_phase_fields(phases[0], 0)))
    for number, phase in enumerate(phases):
        since = F.lit(True) if number == 0 else age >= phase[1]
        chosen = chosen.when(since & (age < phase[2]), F.struct(*_phase_fields(phase, number)))
    return messages.withColumn("_p", chosen).select("*", "_p.*").drop("_p")


def _phase_fields(phase: tuple, number: int) -> list[Column]:
    name, _, _, batch_size, run_vectors, run_labels, label_limit = phase
    return [
        F.lit(name).alias("phase"), F.lit(number).alias("phase_order"), F.lit(batch_size).alias("batch_size"),
        F.lit(run_vectors).alias("run_vectors"), F.lit(run_labels).alias("run_labels"),
        F.lit(label_limit).cast("int").alias("label_limit"),
    ]


def phase_plan(phased: DataFrame) -> DataFrame:
    """Q7: messages and batches per phase."""
    return phased.filter(F.col("phase").isNotNull()).groupBy("phase", "phase_order", "batch_size").agg(F.count(F.lit(1)).alias("messages")).withColumn(
        "batches", F.ceil(F.col("messages") / F.col("batch_size"))
    )


def phase_progress(batches: DataFrame, max_messages: int, block: int = 1024) -> DataFrame:
    """Q8: running counters over batch results ``phase_order, batch_no, <PROGRESS>``.

    Batches are summed per block of numbers first, so the running total over
    everything sees one row per block and the detailed one sees one block.
    The fraction of ``max_messages`` processed stays below 1 until the run ends.
    """
    numbered = batches.withColumn("_block", F.floor(F.col("batch_no") / block))
    blocks = numbered.groupBy("phase_order", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in PROGRESS])
    earlier = Window.orderBy("phase_order", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "phase_order", "_block", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in PROGRESS]
    )
    within = Window.partitionBy("phase_order", "_block").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    running = numbered.select("phase_order", "_block", "batch_no", *[F.sum(c).over(within).alias(c) for c in PROGRESS])
    totals = running.join(blocks, ["phase_order", "_block"]).select(
        "phase_order", "batch_no", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in PROGRESS]
    )
    return totals.withColumn("progress", F.least(F.col("emails_processed") / max_messages, F.lit(0.99)))


def backfill(
    messages: DataFrame, tables: MailTables, now, encoder: Encoder | None = None, scorer: labeling.Scorer | None = None,
    max_messages: int | None = None, phases=BACKFILL_PHASES,
) -> DataFrame:
    """Q7: ingest past mail phase by phase, newest first, and return Q8's progress of every batch.

    Each phase has its batch size, runs vectors and labels only if it says so, and labels at most ``label_limit``
    messages in all.  ``max_messages`` bounds the messages of all phases together.  Mail of no phase is left out.
    Batches are stored many at a time (:func:`ingest_batches`), so the number of jobs does not follow theirs.
    A back-fill that is started again finds what is stored already and goes on with the rest.
    """
    phased = phase_partition(messages, now, phases).filter(F.col("phase").isNotNull())
    ranked = rank_globally(phased, [F.asc("phase_order"), F.desc("date_parsed"), F.asc("id")], "_place")
    if max_messages is not None:
        ranked = ranked.filter(F.col("_place") <= max_messages)
    ranked = cut_lineage(ranked)
    # one row for each phase
    starts = {r["phase_order"]: (r["first"], r["n"]) for r in ranked.groupBy("phase_order").agg(
        F.min("_place").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    done = tables.read("progress", PROGRESS_ROW).agg(F.max("batch_no")).first()[0]
    for order, (_, _, _, batch_size, run_vectors, run_labels, label_limit) in enumerate(phases):
        first, total = starts.get(order, (0, 0))
        left = label_limit
        step = max(1, ROUND_MESSAGES // batch_size) * batch_size
        for at in range(first, first + total, step):
            end = min(at + step, first + total)
            number = tables.committed() + 1
            part = ranked.filter((F.col("_place") >= at) & (F.col("_place") < end)).withColumn(
                "batch_no", F.floor((F.col("_place") - at) / batch_size) + number)
            counts = ingest_batches(
                part.select("batch_no", *MESSAGE.fieldNames()), number + (end - at - 1) // batch_size, tables,
                encoder if run_vectors else None, scorer if run_labels else None, left, order)
            if left is not None:
                left = max(0, left - counts["llm_classified"])
    rows = tables.read("progress", PROGRESS_ROW)
    rows = rows.filter(F.col("batch_no") > done) if done is not None else rows
    return phase_progress(rows, max_messages if max_messages is not None else max(1, sum(n for _, n in starts.values())))
