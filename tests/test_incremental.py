"""Batch tables and sender statistics that follow the ingest."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from mailgrain.operators.features import message_features, sender_stats
from mailgrain.schemas import MESSAGE
from mailgrain.session import shared_folder
from mailgrain.streaming import ingest, senders, store
from tests.helpers import START, YOU, message, messages


def mailbox(count=160, seed=1):
    """Mail with answers before and after their questions, null dates and senders, edges of the windows."""
    own = random.Random(seed)
    rows = []
    for i in range(count):
        sent = own.random() < 0.4
        fields = dict(
            is_sent=sent, from_email=own.choice([YOU, "Other@corp.example"]) if sent else own.choice(["Ann@x.example", "bob@y.example", "cy@z.example", None]),
            to_emails=own.choice([None, ["ann@x.example"], ["Bob@y.example", "cy@z.example"]]) if sent else [YOU],
            in_reply_to=own.choice([None, f"m{own.randrange(count)}", f"m{own.randrange(count)}", "<unknown>"]))
        row = message(i, own.choice([0, 60 * 24 * 10, 60 * 24 * 93, 60 * 24 * 70, 60 * 24 * 100]) + own.randint(0, 900), **fields)
        if own.random() < 0.05:
            row["date_parsed"] = None
        rows.append(row)
    newest = START + timedelta(days=101)
    rows.append(message(count, from_email="ann@x.example", date_parsed=newest))
    for k, days in enumerate((7, 30, 90)):  # exactly on the edge, and a microsecond before it
        rows.append(message(count + 1 + 2 * k, from_email="edge@x.example", date_parsed=newest - timedelta(days=days)))
        rows.append(message(count + 2 + 2 * k, from_email="edge@x.example", date_parsed=newest - timedelta(days=days, microseconds=1)))
    return rows


def values(df):
    out = {}
    for r in df.collect():
        d = r.asDict()
        d["avg_response_hours"] = round(d["avg_response_hours"], 6)
        out[d.pop("sender")] = d
    return out


def feature_values(df):
    return {r["email_id"]: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}


@pytest.mark.parametrize("seed, compact", [(1, False), (2, True)])
def test_any_order_of_batches_gives_f5(spark, tmp_path, seed, compact):
    rows = mailbox(seed=seed)
    own = random.Random(seed)
    own.shuffle(rows)
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    batches = [rows[:90], rows[60:], rows[:20]]  # an overlap and a replay among them
    for k, batch in enumerate(batches):
        ingest.ingest_batch(messages(spark, *batch), tables)
        if compact and k == 0:
            tables.senders.compact()
            for name in ("sender_links", "sender_changes", "sender_arrivals", "sender_reference"):
                tables.forget(name)
    stored = tables.read("messages", MESSAGE)
    assert stored.count() == len(rows) == stored.select("message_id").distinct().count()
    want = values(sender_stats(stored))
    assert values(tables.senders.stats()) == want and None in want and want["edge@x.example"]["emails_7d"] == 1
    some = spark.createDataFrame([("ann@x.example",), ("edge@x.example",), ("nobody@x.example",)], "sender string")
    assert values(tables.senders.stats(some)) == {k: want[k] for k in ("ann@x.example", "edge@x.example")}


def test_features_of_a_batch_are_those_of_the_whole_mailbox(spark, tmp_path):
    rows = mailbox(80)
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    ingest.ingest_batch(messages(spark, *rows[:50]), tables)
    ingest.ingest_batch(messages(spark, *rows[50:]), tables)
    whole = feature_values(message_features(messages(spark, *rows)))
    got = feature_values(tables.read("features", message_features(messages(spark, *rows)).schema))
    assert set(got) == set(whole)
    late = {r["id"] for r in rows[50:] if not r["is_sent"]}
    assert {k: got[k] for k in late} == {k: whole[k] for k in late}  # earlier rows know less of their senders


def test_failed_batch_leaves_nothing(spark, tmp_path):
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    ingest.ingest_batch(messages(spark, *mailbox(30)[:20]), tables)
    before = values(tables.senders.stats())

    class Broken(Exception):
        pass

    def broken(*_):
        raise Broken

    original = tables.commit
    tables.commit = broken
    with pytest.raises(Broken):
        ingest.ingest_batch(messages(spark, *mailbox(30)[20:]), tables)
    assert tables.read("messages", MESSAGE).count() == 20 and values(tables.senders.stats()) == before
    tables.commit = original
    ingest.ingest_batch(messages(spark, *mailbox(30)[25:]), tables)  # another batch takes the number
    kept = mailbox(30)[:20] + mailbox(30)[25:]
    assert values(tables.senders.stats()) == values(sender_stats(messages(spark, *kept)))


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    many = [message(i, i, from_email=f"p{i % 2000}@x.example") for i in range(6000)]
    ingest.ingest_batch(messages(spark, *many), tables)
    tables.senders.compact()
    small = [message(10_000 + i, 7000 + i, from_email=f"p{i}@x.example") for i in range(3)]
    paths = tables._paths("sender_changes", None, senders._touched(messages(spark, *small).select(F.lower("from_email").alias("sender")), "sender"))
    assert len(paths) <= 3 and all("/upto=0/part=" in p for p in paths)
    links = tables.senders.stored_links(messages(spark, *small).select(F.col("message_id").alias("ref")))
    assert links.count() == 0
    read = sum(spark.read.parquet(p).count() for p in paths)
    assert read <= 6000 * 6 / store.BUCKETS  # three of 256 buckets
    ids = messages(spark, *small).select(F.col("message_id").alias("ref"))
    assert sum(spark.read.parquet(p).count() for p in tables._paths("sender_links", None, senders._touched(ids, "ref"))) <= 6000 * 6 / store.BUCKETS
    ingest.ingest_batch(messages(spark, *small), tables)
    assert values(tables.senders.stats())["p0@x.example"]["emails_all"] == 4
    # no stored message is opened again
    files = set(tables.senders.stats(messages(spark, *small).select(F.lower("from_email").alias("sender")), 1).inputFiles())
    assert files and not any("/messages/" in f for f in files)


def test_catch_up(spark, tmp_path):
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    ingest.ingest_batch(messages(spark, *[message(i, i, body_text="please look at this long text") for i in range(5)]), tables)
    ingest.catch_up(tables, encoder=lambda texts: [[float(len(t))] for t in texts])
    ingest.catch_up(tables, encoder=lambda texts: [[float(len(t))] for t in texts])
    assert tables.read("vectors", ingest.VECTORS).count() == 5


def test_backfill_runs_the_phases(spark, tmp_path):
    now = START + timedelta(days=100)
    ages = [1, 2, 3, 10, 11, 12, 13, 40, 50, 95, None]
    rows = [message(i, 0, date_parsed=None if a is None else now - timedelta(days=a), body_text="Could you please look at this long enough text about it ?")
            for i, a in enumerate(ages)]
    phases = [("quick", 0, 7, 2, True, True, 1), ("standard", 7, 30, 3, True, False, None), ("deep", 30, 90, 5, False, False, None)]
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))

    def scorer(prompts):
        return [{"response": '{"action_type": "task", "urgency": "today"}'} for _ in prompts]

    def encoder(texts):
        return [[float(len(t))] for t in texts]

    out = ingest.backfill(messages(spark, *rows), tables, now, encoder, scorer, phases=phases)
    got = [tuple(r[c] for c in ("phase_order", "emails_fetched", "emails_processed", "features_computed", "embeddings_generated", "llm_classified"))
           for r in out.orderBy("batch_no").collect()]
    assert got == [(0, 2, 2, 2, 2, 1), (0, 3, 3, 3, 3, 1), (1, 6, 6, 6, 6, 1), (1, 7, 7, 7, 7, 1), (2, 9, 9, 9, 7, 1)]
    assert [round(r["progress"], 4) for r in out.orderBy("batch_no").collect()] == [0.2222, 0.3333, 0.6667, 0.7778, 0.99]
    assert {r["id"] for r in tables.read("messages", MESSAGE).collect()} == set(range(9))


def test_parts_of_many_files_are_one_batch_each(spark, monkeypatch):
    """Q6's parts were written by one task, as one file each."""
    from contract import serving

    folders = {}

    def folder(session, name):
        folders[name] = shared_folder(session, name)
        return folders[name]

    monkeypatch.setattr(serving, "shared_folder", folder)
    rows = mailbox()
    mail = messages(spark, *rows).repartition(4)
    tables = serving._ingested(spark, mail, 2)
    assert tables.committed() == 2  # two parts and the replay
    files = [f for f in os.listdir(folders["incoming"].removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) > 3
    assert tables.read("messages", MESSAGE).count() == len(rows)
    assert values(tables.senders.stats()) == values(sender_stats(messages(spark, *rows)))


def old_mail(count=60, seed=3):
    """Mail of three phases whose ids, answers and senders cross the batches; some ids come twice, some with other texts."""
    own = random.Random(seed)
    now = START + timedelta(days=100)
    rows = []
    for i in range(count):
        sent = own.random() < 0.4
        row = message(
            own.randrange(count // 2) if i % 7 == 0 else i, 0, is_sent=sent, date_parsed=now - timedelta(days=own.choice([-1, 2, 6, 8, 20, 29, 40, 80]), minutes=own.randrange(500)),
            message_id=f"m{own.randrange(count)}" if i % 5 == 0 else f"m{i}", in_reply_to=own.choice([None, f"m{own.randrange(count)}", f"m{own.randrange(count)}"]),
            from_email=own.choice([YOU, "Other@corp.example"]) if sent else own.choice(["Ann@x.example", "bob@y.example", "cy@z.example", None]),
            to_emails=own.choice([None, ["ann@x.example"], ["Bob@y.example", "cy@z.example"]]) if sent else [YOU],
            body_text=f"Could you please look at this long enough text {own.randrange(9)} about it ?")
        rows.append(row)
    return rows, now


def some_fail(prompts):
    return [None if "text 3" in p or "text 5" in p else {"response": '{"action_type": "task"}'} for p in prompts]


def lengths(texts):
    return [[float(len(t))] for t in texts]


def one_by_one(rows, tables, spark, now, encoder, scorer, phases):
    """The back-fill as a loop over its batches."""
    for order, (_, low, high, size, vectors, labels, left) in enumerate(phases):
        def fits(r):
            age = (now - r["date_parsed"]) / timedelta(days=1)
            return (order == 0 or age >= low) and age < high

        own = sorted(filter(fits, rows), key=lambda r: (-r["date_parsed"].timestamp(), r["id"]))
        for at in range(0, len(own), size):
            counts = ingest.ingest_batch(messages(spark, *own[at: at + size]), tables, encoder if vectors else None, scorer if labels else None, left, order)
            left = None if left is None else max(0, left - counts["llm_classified"])


def test_backfill_stores_what_batch_after_batch_stores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "ROUND_MESSAGES", 12)  # the second round finds mail, answers and senders of the first
    rows, now = old_mail(24)
    phases = [("all", 0, 90, 6, True, True, 5)]
    want, got = (ingest.MailTables(spark, str(tmp_path / name)) for name in ("want", "got"))
    one_by_one(rows, want, spark, now, lengths, some_fail, phases)
    ingest.backfill(messages(spark, *rows), got, now, lengths, some_fail, phases=phases)
    assert got.committed() == want.committed() == 3
    feature_schema = message_features(messages(spark, *rows)).schema
    class_schema = "email_id bigint, predicted_handleability string, classification_metadata string, llm_priority int"
    tables = {"messages": MESSAGE, "features": feature_schema, "classes": class_schema, "vectors": ingest.VECTORS, "labels": ingest.LABELS, "progress": ingest.PROGRESS_ROW}
    for name, schema in tables.items():
        left, right = (sorted(map(str, store_.read(name, schema).collect())) for store_ in (want, got))
        assert left == right and left, name
    assert values(got.senders.stats()) == values(want.senders.stats())


def test_jobs_of_a_backfill_do_not_follow_its_batches(spark, tmp_path):
    now = START + timedelta(days=100)
    rows = [message(i, 0, date_parsed=now - timedelta(minutes=i)) for i in range(24)]
    jobs = {}
    for size in (12, 2):
        group = f"backfill-{size}"
        spark.sparkContext.setJobGroup(group, group)
        out = ingest.backfill(messages(spark, *rows), ingest.MailTables(spark, str(tmp_path / group)), now, phases=[("quick", 0, 7, size, False, False, None)])
        jobs[size] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert out.count() == 24 // size
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] < jobs[12] * 1.5


def test_a_round_that_failed_leaves_nothing(spark, tmp_path, monkeypatch):
    rows, now = old_mail(30)
    phases = [("all", 0, 90, 10, True, False, None)]
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    original = tables.commit

    def broken(_):
        raise RuntimeError

    tables.commit = broken
    with pytest.raises(RuntimeError):
        ingest.backfill(messages(spark, *rows), tables, now, lengths, phases=phases)
    tables.commit = original
    some = [r for r in rows if r["date_parsed"] > now - timedelta(days=25)]
    for part in (some, rows):  # the numbers up to the failed one are passed by other rounds
        ingest.backfill(messages(spark, *part), tables, now, phases=phases)
    assert tables.read("vectors", ingest.VECTORS).count() == 0
    stored = tables.read("messages", MESSAGE)
    assert stored.count() == len({r["message_id"] for r in rows})
    assert values(tables.senders.stats()) == values(sender_stats(stored))
