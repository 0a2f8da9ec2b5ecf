"""Small message tables for the tests."""

from datetime import datetime, timedelta

from mailgrain.schemas import MESSAGE

START = datetime(2024, 1, 1, 10, 0, 0)
YOU = "me@corp.example"


def message(id, minutes=0, **fields):
    row = dict.fromkeys(MESSAGE.fieldNames())
    row.update(
        id=id, message_id=f"m{id}", thread_id="t", date_parsed=START + timedelta(minutes=minutes), from_email="ann@x.example",
        to_emails=[YOU], subject="hello", body_text="text", labels=["Inbox"], has_attachments=False, is_sent=False,
    )
    row.update(fields)
    return row


def messages(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in MESSAGE.fieldNames()) for r in rows], MESSAGE)


def column(spark, value, expression, kind="string"):
    """Value of a column expression built on ``c`` for one input value."""
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression("c").alias("out")).first()["out"]
