"""Normalisation and cleaning against literal values."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailgrain.functions import clean as C
from mailgrain.functions import html as H
from mailgrain.functions import normalize as N
from tests.helpers import column


@pytest.mark.parametrize("raw, email, name", [
    ('"John Doe" <John@Example.com>', "john@example.com", "John Doe"),
    ("Jane <jane@x.org>", "jane@x.org", "Jane"),
    ("<bare@x.org>", "bare@x.org", None),
    ("Bare@X.org ", "bare@x.org", None),
    ("nobody", None, None),
    ("", None, None),
    (None, None, None),
])
def test_address_parts(spark, raw, email, name):
    got = column(spark, raw, N.address_parts)
    assert (got["email"], got["name"]) == (email, name)


def test_address_lists(spark):
    assert column(spark, "a@x.org, B <b@x.org>; junk;", N.address_list) == ["a@x.org", "b@x.org"]
    assert column(spark, None, N.address_list) == []
    assert column(spark, '"Doe, Jane" <j@x.org>, k@x.org', N.address_list_quoted) == ["j@x.org", "k@x.org"]
    # an odd quote protects only commas with an odd number of quotes after them
    assert column(spark, 'a@x.org, b"c@x.org, d@x.org', N.address_list_quoted) == ['a@x.org, b"c@x.org', "d@x.org"]


@pytest.mark.parametrize("raw, expected", [
    ("Mon, 15 Jan 2024 10:30:00 +0000", datetime(2024, 1, 15, 10, 30)),
    ("15 Jan 2024 10:30:00 -0800 (PST)", datetime(2024, 1, 15, 18, 30)),
    ("2024-01-15 10:30:00+02:00", datetime(2024, 1, 15, 8, 30)),
    ("2024-01-15T10:30:00Z", datetime(2024, 1, 15, 10, 30)),
    ("2024-01-15   10:30:00", datetime(2024, 1, 15, 10, 30)),
    ("2024-01-15T10:30:00", datetime(2024, 1, 15, 10, 30)),
    ("15 Foo 2024 10:30:00 +0000", None),
    ("32 Jan 2024 10:30:00 +0000", None),
    ("soon", None),
    (None, None),
])
def test_parse_mail_date(spark, raw, expected):
    seconds = column(spark, raw, lambda c: F.unix_timestamp(N.parse_mail_date(c)))
    assert seconds == (None if expected is None else int((expected - datetime(1970, 1, 1)).total_seconds()))


def test_small_text_functions(spark):
    assert column(spark, "a\x00b\r\nc\rd", N.sanitize_text) == "ab\nc\nd"
    assert column(spark, "x " * 150, N.preview) == ("x " * 150).strip()[:200] + "..."
    assert column(spark, "", N.preview) is None
    assert column(spark, "one two\n three", N.word_count) == 3
    assert column(spark, "  \n", N.word_count) == 0
    assert column(spark, None, N.word_count) == 0
    assert column(spark, 'A,"b, c",\r\n D, ,', N.label_list) == ["A", "b, c", "D"]
    assert column(spark, "<a@b> c@d\n e", N.reference_ids) == ["<a@b>", "<c@d>"]
    assert column(spark, ["Inbox", "sEnT"], N.is_sent_label, "array<string>") is True
    assert column(spark, None, N.is_sent_label, "array<string>") is False
    assert column(spark, ["SENT", "SPAM"], N.label_flags, "array<string>").asDict() == {
        "is_sent": True, "is_inbox": False, "is_unread": False, "is_starred": False, "is_draft": False, "is_spam": True,
        "is_trash": False,
    }


@pytest.mark.parametrize("html, text", [
    ("<p>Hello</p><script>x()</script>World", "Hello World"),
    ("a<!-- gone -->b", "a b"),
    ('<div style="display: none">x<div>y</div>z</div>seen', "seen"),
    ('<span style="VISIBILITY:hidden">x</span>seen', "seen"),
    ("<head><title>t</title></head><body>b &amp; c&nbsp;d</body>", "b & c d"),
    ('<img width="1" src="t"><p>q', "q"),
    ("plain", "plain"),
    ("", ""),
])
def test_strip_html(spark, html, text):
    assert column(spark, html, H.strip_html) == text


def test_strip_html_basic_keeps_hidden(spark):
    assert column(spark, '<p style="display:none">kept</p><style>gone</style>', H.strip_html_basic) == "kept"
    assert column(spark, " no \n markup ", H.strip_html_basic) == "no markup"
    assert column(spark, None, H.strip_html_basic) == ""


@pytest.mark.parametrize("raw, expected", [
    ("Hi {{ name }}!", "Hi !"),
    ("a {% if x %}\nb{% endif %} c", "a b c"),
    ("x {# note #} <% erb %> y", "x y"),
    ("none  here", "none here"),
])
def test_strip_templates(spark, raw, expected):
    assert column(spark, raw, C.strip_templates) == expected


def brute_quotes(text):
    """Line-by-line statement of the quote rules, for comparison on small texts."""
    text = re.sub(r"On [^>]+wrote:\s*>.*$", "", text, flags=re.M | re.I)
    kept, quoted = [], False
    for line in text.split("\n"):
        s = line.strip()
        opens = s.startswith(">") or re.match(r"^On .+ wrote:$", s, re.I) or re.match(
            r"^-+\s*(Forwarded message|Original Message)\s*-+$", s, re.I)
        if opens:
            quoted = True
        elif re.match(r"^(From|Sent|To|Subject|Date|Cc|Bcc):\s*.+$", s):
            pass
        elif s:
            quoted = False
            kept.append(line)
        elif not quoted:
            kept.append(line)
    return re.sub(r"\s*>\s+\S.*$", "", "\n".join(kept).strip(), flags=re.M).strip()


QUOTED = [
    "My answer\n> old text\n> more", "On Mon Ann wrote:\n\n\nafter", "one\n\n> q\n\n  \ntwo\n\nthree", "From: a\nTo: b\ntext",
    "> a\nFrom: x\n\nplain\n\nend", "text\n---- Original Message ----\n\nbody", "a > b c", "Reply On Mon Ann wrote: > quoted", "plain only",
    "x\nOn Monday wrote:\ny\n\n", "", "a\n>\n\n\n>b\nc",
]


@pytest.mark.parametrize("raw", QUOTED)
def test_strip_quotes_against_line_rules(spark, raw):
    assert column(spark, raw, C.strip_quotes) == brute_quotes(raw)


@pytest.mark.parametrize("raw, text, removed", [
    ("Hello\n-- \nJane", "Hello", True), ("Hello\nBest regards,\nJ", "Hello", True), ("Hello\nSent from my iPhone", "Hello", True),
    ("Hello\nSent via \nx", "Hello\nSent via \nx", False), ("Best, all", "", True), ("no mark", "no mark", False),
])
def test_strip_signature(spark, raw, text, removed):
    assert column(spark, raw, C.strip_signature) == text
    assert column(spark, raw, C.has_signature) is removed


def test_characters_and_white_space(spark):
    assert column(spark, "“a” ‘b’ — c… é​", C.normalize_chars) == "\"a\" 'b' - c... é"
    assert column(spark, "a  \t b \n \n\n c\n d ", C.collapse_whitespace) == "a b\n\nc\nd"


def test_sanitize_messages_counts(spark):
    rows = spark.createDataFrame([(1, "<p>Hello {{x}} world</p>"), (2, ""), (3, None)], "id int, body string")
    out = {r["id"]: r for r in C.sanitize_messages(rows, "body").collect()}
    assert (out[1]["clean_text"], out[1]["html_stripped"], out[1]["original_length"]) == ("Hello world", True, 24)
    assert out[1]["reduction_ratio"] == pytest.approx(1 - 11 / 24)
    assert out[2]["reduction_ratio"] == 0.0 and out[3]["clean_text"] == ""


def test_tokens_and_embedding_text(spark):
    assert column(spark, "abcde", C.token_estimate) == 2
    assert column(spark, "abcdefgh", lambda c: C.truncate_tokens(c, 2)) == "abcd..."
    rows = spark.createDataFrame(
        [(1, " Hi ", "Body text", True, 0.7, 0.0), (2, None, None, False, 0.0, 0.3), (3, "s", "y" * 40000, False, 0.0, 0.6)],
        "email_id bigint, subject string, body_text string, is_service boolean, service_importance double, relationship_strength double",
    )
    out = {r["email_id"]: r for r in C.prepare_for_embedding(rows).collect()}
    assert out[1]["text"] == "[TYPE: SERVICE] [PRIORITY: HIGH]\n[SUBJECT] Hi\n[BODY] Body text"
    assert out[2]["text"] == "[TYPE: PERSON] [PRIORITY: MEDIUM]"
    assert out[3]["text"].endswith("y...") and out[3]["token_count"] <= 8000
    assert len(out[1]["content_hash"]) == 16
