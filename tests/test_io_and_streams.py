"""Archive reading, streaming operators and the whole run."""

import base64
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailgrain.plans.mailbox import STEPS, MailboxRun
from mailgrain.schemas import MESSAGE
from mailgrain.sources.archive import read_mail_archive
from mailgrain.sources.documents import build_messages, parse_api_messages
from mailgrain.streaming import ingest, notifications
from tests.helpers import START, YOU, message, messages

MBOX = b"""From a@b Mon Jan  1 00:00:00 2024
Message-ID: <1@x>
From: =?utf-8?q?J=C3=B6rg?= <jorg@x.example>
To: me@corp.example
Subject: First
Date: Mon, 1 Jan 2024 10:00:00 +0000
X-Gmail-Labels: Inbox,"a, b"

Hello
>From the start

From c@d Mon Jan  1 00:00:00 2024
Message-ID: <2@x>
Subject: Second
Content-Type: multipart/mixed; boundary=zz

--zz
Content-Type: text/html; charset=latin1
Content-Transfer-Encoding: 8bit

<p>caf\xe9</p>
--zz
Content-Type: application/pdf; name=a.pdf
Content-Disposition: attachment; filename=a.pdf

x
--zz--
"""


def test_archive(spark, tmp_path):
    (tmp_path / "in.mbox").write_bytes(MBOX)
    rows = read_mail_archive(spark, str(tmp_path), with_offsets=True).orderBy("mbox_offset").collect()
    assert [r["message_id"] for r in rows] == ["<1@x>", "<2@x>"]
    assert rows[0]["from"] == "Jörg <jorg@x.example>" and rows[0]["labels"] == ["Inbox", "a, b"]
    assert rows[0]["body"] == "Hello\n>From the start\n" and rows[0]["mbox_offset"] == 0
    assert rows[1]["body"].strip() == "<p>café</p>" and rows[1]["has_attachments"]
    assert rows[1]["mbox_offset"] == rows[0]["raw_size_bytes"] + 1
    built = build_messages(read_mail_archive(spark, str(tmp_path))).orderBy("message_id").collect()
    assert built[0]["from_email"] == "jorg@x.example" and built[0]["date_parsed"] == datetime(2024, 1, 1, 10)
    assert built[0]["to_emails"] == ["me@corp.example"] and built[1]["to_emails"] is None


def test_api_messages(spark):
    def data(text):
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    nested = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": data("plain ?>")}},
                                                              {"mimeType": "text/html", "body": {"data": data("<p>h</p>")}}]}
    doc = {"id": "g1", "threadId": "t1", "labelIds": ["INBOX"], "payload": {
        "mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "a"}, {"name": "SUBJECT", "value": "b"}, {"name": "To", "value": '"X, Y" <xy@z.org>'}],
        "parts": [{"mimeType": "multipart/related", "parts": [nested]}, {"mimeType": "image/png", "headers": [{"name": "Content-Disposition", "value": "Attachment; x"}]}]}}
    row = parse_api_messages(spark.createDataFrame([(json.dumps(doc),), ("{}",)], "json string")).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["subject"], row["body_text"], row["body_html"], row["has_attachments"]) == ("b", "plain ?>", "<p>h</p>", True)
    assert row["message_id"] == "<g1@gmail.com>" and row["to_emails"] == ["xy@z.org"]


def test_dedup_within_ttl(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "email string, history_id string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = notifications.dedup_notifications(spark.readStream.schema(schema).parquet(source), "ts")
        run = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        run.start(out).awaitTermination()

    arrive(("a", "1", START), ("a", "1", START + timedelta(seconds=10)), ("a", "2", START))
    arrive(("a", "1", START + timedelta(seconds=100)), ("b", "1", START + timedelta(hours=1)))
    arrive(("b", "1", START + timedelta(hours=1, seconds=5)), ("a", "1", START + timedelta(hours=1)))
    got = sorted((r["email"], r["history_id"]) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")]


def test_bad_notifications_have_reasons(spark):
    good = base64.b64encode(b'{"emailAddress": "a@x", "historyId": 7}').decode()
    empty = base64.b64encode(b'{"historyId": 7}').decode()
    rows = spark.createDataFrame([("1", good), ("2", "%%"), ("3", empty)], "id string, data string")
    parsed = notifications.parse_notifications(rows)
    assert [(r["email"], r["history_id"]) for r in notifications.valid_notifications(parsed).collect()] == [("a@x", "7")]
    assert {r["id"] for r in notifications.bad_notifications(parsed).collect()} == {"2", "3"}


def test_replayed_batch_adds_nothing(spark, tmp_path):
    tables = ingest.MailTables(spark, str(tmp_path / "tables"))
    batch = messages(spark, message(1), message(2, 5), message(3, 6, is_sent=True, from_email=YOU))

    def encoder(texts):
        return [[float(len(t))] for t in texts]

    for _ in range(2):
        ingest.ingest_batch(batch, tables, encoder)
    assert tables.read("messages", MESSAGE).count() == 3
    for name in ("features", "classes", "vectors"):
        assert tables.read(name, "email_id bigint").count() == 2


def test_phases(spark):
    now = START + timedelta(days=100)
    m = messages(spark, *[message(i, 60 * 24 * i) for i in (1, 15, 60, 80, 99, 100)])
    out = {r["id"]: r["phase"] for r in ingest.phase_partition(m, now).collect()}
    assert out == {100: "quick", 99: "quick", 80: "standard", 60: "deep", 15: "deep", 1: None}


def test_whole_run(spark, tmp_path):
    rows = []
    for i in range(60):
        rows.append(message(i, i * 300, from_email=f"p{i % 6}@x.example", thread_id=f"t{i % 9}", subject=f"Topic {i % 5}",
                            body_text="Could you please look at this long enough text about number %d ?" % i))
    rows += [message(100 + i, i * 300 + 30, is_sent=True, from_email=YOU, to_emails=[f"p{i % 6}@x.example"], in_reply_to=f"m{i}", thread_id=f"t{i % 9}") for i in range(0, 60, 4)]

    def encoder(texts):
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]

    def scorer(prompts):
        return [{"response": '{"action_type": "task", "urgency": "today"}'} for _ in prompts]

    run = MailboxRun(str(tmp_path / "run"), [YOU], START + timedelta(days=14), encoder, scorer, restarts=1)
    out = run.run(messages(spark, *rows))
    counts = {r["step"]: r["records"] for r in run.row_counts().collect()}
    assert set(counts) == set(STEPS)
    assert counts["features"] == counts["vectors"] == counts["classes"] == counts["priority"] == counts["clusters"] == 60
    assert sorted(r["priority_rank"] for r in out["priority"].collect()) == list(range(1, 61))
    assert out["messages"].filter(F.col("action") == "REPLIED").count() == 15
    again = MailboxRun(str(tmp_path / "run"), [YOU], START + timedelta(days=14), encoder, scorer, restarts=1)
    assert again.run(messages(spark, *rows), start_from="contexts")["priority"].count() == 60
