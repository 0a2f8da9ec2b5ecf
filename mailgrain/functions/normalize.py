"""Message normalisation (operators B1-B11): header text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, spelled out because ``\s`` is ASCII only on the JVM.
WHITE_SPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
SPACE = f"[{_CLASS}]"
NOT_SPACE = f"[^{_CLASS}]"
# white space that stays on its line
INLINE_SPACE = r"[ \t\x0b\f\r\x1c-\x1f\x85\p{Z}]"
# runs that are not a single space already, so ordinary text has few matches
_LOOSE = f" {SPACE}+|[{_CLASS}&&[^ ]]{SPACE}*"
_LOOSE_INLINE = f" {INLINE_SPACE}+|[{_CLASS}&&[^ \\n]]{INLINE_SPACE}*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(_col(c), _LOOSE, " ")


def squeeze_lines(c: Column | str) -> Column:
    """Like :func:`squeeze`, line breaks kept."""
    return F.regexp_replace(_col(c), _LOOSE_INLINE, " ")


def _literal(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(column: str, words: list[str]) -> Column:
    """True when the named text column contains at least one of the literal ``words``."""
    return F.expr(" OR ".join(f"contains({column}, {_literal(w)})" for w in words))


def count_hits(column: str, words: list[str]) -> Column:
    """How many of the literal ``words`` occur in the named text column."""
    return F.expr(" + ".join(f"int(contains({column}, {_literal(w)}))" for w in words))


def like_any(column: str, patterns: list[str]) -> Column:
    return F.expr(f"{column} LIKE ANY ({', '.join(_literal(p) for p in patterns)})")


def lowered(df: DataFrame, **columns: str) -> DataFrame:
    """Add lower-cased, non-null copies of text columns: ``lowered(df, body="body_text")``.

    The word-list functions read such columns, so a text is lower-cased once
    however many words it is searched for.
    """
    return df.withColumns({name: F.lower(F.coalesce(F.col(c), F.lit(""))) for name, c in columns.items()})


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def sanitize_text(c: Column | str) -> Column:
    """B1: drop NUL characters, turn CRLF and CR into LF."""
    return F.regexp_replace(F.translate(_col(c), "\x00", ""), r"\r\n?", "\n")


def address_parts(c: Column | str) -> Column:
    """B2: ``Name <mail>`` or a bare address to ``struct(email, name)``."""
    raw = sanitize_text(c)
    bracketed = raw.rlike(r"[^<]*<[^>]+>")
    name = F.regexp_replace(strip(F.regexp_extract(raw, r"([^<]*)<([^>]+)>", 1)), "^[\"']+|[\"']+$", "")
    email = strip(F.regexp_extract(raw, r"([^<]*)<([^>]+)>", 2))
    return F.struct(
        F.when(bracketed, F.lower(email)).when(raw.contains("@"), F.lower(strip(raw))).alias("email"),
        F.when(bracketed, null_if_blank(name)).alias("name"),
    )


def address_list(c: Column | str) -> Column:
    """Addresses of a comma or semicolon separated list, in order."""
    parts = F.split(F.coalesce(sanitize_text(c), F.lit("")), "[,;]")
    mails = F.transform(parts, lambda p: address_parts(strip(p))["email"])
    return F.filter(mails, lambda m: m.isNotNull() & (m != ""))


def strict_address_parts(c: Column | str) -> Column:
    """Provider-API variant of B2: whole-string match, bare words are kept."""
    text = strip(_col(c))
    named = r'^"?([^"<]+)"?\s*<([^>]+)>$'
    bare = r"^<([^>]+)>$"
    return F.struct(
        F.when(text.rlike(named), F.lower(strip(F.regexp_extract(text, named, 2))))
        .when(text.rlike(bare), F.lower(strip(F.regexp_extract(text, bare, 1))))
        .when(text.contains("@"), F.lower(text))
        .otherwise(F.coalesce(text, F.lit("")))
        .alias("email"),
        F.when(text.rlike(named), null_if_blank(strip(F.regexp_extract(text, named, 1)))).alias("name"),
    )


# A run without separators, where a quoted stretch may hold separators.
# Possessive, so one pass and no back-tracking on long headers.
_QUOTED_TOKEN = r'((?:[^",]++|"[^"]*+(?:"|$))++)'


def address_list_quoted(c: Column | str) -> Column:
    """Split on commas outside double quotes, then :func:`strict_address_parts`.

    A comma separates when an even number of quotes follows it, so the text is
    tokenised from its end.
    """
    backwards = F.regexp_extract_all(F.reverse(F.coalesce(_col(c), F.lit(""))), F.lit(_QUOTED_TOKEN), F.lit(1))
    parts = F.reverse(F.transform(backwards, lambda p: strip(F.reverse(p))))
    mails = F.transform(F.filter(parts, lambda p: p != ""), lambda p: strict_address_parts(p)["email"])
    return F.filter(mails, lambda m: m != "")


def parse_mail_date(c: Column | str) -> Column:
    """RFC 2822 and ISO dates to timestamp; anything else is null.

    The accepted shapes are checked by pattern, brought to one of two layouts
    and parsed once.  Dates without an offset are UTC.
    """
    text = F.regexp_replace(sanitize_text(c), r"\s*\([^)]+\)\s*$", "")
    text = F.trim(squeeze(text))
    text = F.regexp_replace(F.regexp_replace(text, r"([+-]\d\d):?(\d\d)$", "$1$2"), r"(?<=\d) ?Z$", "+0000")
    iso = r"^(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{1,2}:\d{1,2}) ?([+-]\d{4})?$"
    rfc = (
        r"^(?i:(?:mon|tue|wed|thu|fri|sat|sun), )?"
        r"(\d{1,2}) ([A-Za-z]{3}) (\d{4} \d{1,2}:\d{1,2}:\d{1,2}) ?([+-]\d{4})$"
    )
    offset = F.regexp_extract(text, iso, 3)
    iso_text = F.concat(
        F.regexp_extract(text, iso, 1), F.lit(" "), F.regexp_extract(text, iso, 2), F.lit(" "),
        F.when(offset == "", F.lit("+0000")).otherwise(offset),
    )
    rfc_text = F.concat_ws(
        " ", F.regexp_extract(text, rfc, 1), F.initcap(F.regexp_extract(text, rfc, 2)),
        F.regexp_extract(text, rfc, 3), F.regexp_extract(text, rfc, 4),
    )
    return F.when(text.rlike(iso), F.try_to_timestamp(iso_text, F.lit("yyyy-M-d H:m:s Z"))).when(
        text.rlike(rfc), F.try_to_timestamp(rfc_text, F.lit("d MMM yyyy H:m:s Z"))
    )


def preview(c: Column | str, max_length: int = 200) -> Column:
    """White space collapsed, cut at ``max_length`` with ``...``."""
    body = _col(c)
    flat = strip(squeeze(body))
    cut = F.when(F.length(flat) > max_length, F.concat(F.substring(flat, 1, max_length), F.lit("...")))
    return F.when(body != "", F.coalesce(cut, flat))


def raw_preview(c: Column | str, max_length: int = 200) -> Column:
    """B6, live-sync form: the first characters as they are."""
    body = _col(c)
    return F.when(body != "", F.substring(body, 1, max_length))


def word_count(c: Column | str) -> Column:
    """Number of white-space separated tokens, 0 for null."""
    return spaced_words(strip(squeeze(c)))


def spaced_words(flat: Column) -> Column:
    """Words of a text whose words are separated by single spaces."""
    # no CASE: its branches would evaluate ``flat`` again
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.coalesce(spaces + (flat != "").cast("int"), F.lit(0))


def is_sent_label(c: Column | str) -> Column:
    """Any label reads ``sent``, in whatever case."""
    return F.coalesce(F.exists(_col(c), lambda label: F.lower(label) == "sent"), F.lit(False))


def label_list(c: Column | str) -> Column:
    """Comma separated labels, quotes protect commas, header folding removed."""
    flat = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\r\n\s*", " ")
    tokens = F.regexp_extract_all(flat, F.lit(_QUOTED_TOKEN), F.lit(1))
    labels = F.transform(tokens, lambda t: strip(F.replace(t, F.lit('"'), F.lit(""))))
    return F.filter(labels, lambda label: label != "")


def label_flags(c: Column | str) -> Column:
    """Provider label ids to ``struct(is_sent, is_inbox, ...)``."""
    labels = F.coalesce(_col(c), F.array().cast("array<string>"))
    names = ["SENT", "INBOX", "UNREAD", "STARRED", "DRAFT", "SPAM", "TRASH"]
    return F.struct(*[F.array_contains(labels, name).alias(f"is_{name.lower()}") for name in names])


def reference_ids(c: Column | str) -> Column:
    """References header to an array of ``<id>``."""
    tokens = F.split(F.coalesce(strip(c), F.lit("")), f"{SPACE}+")
    ids = F.transform(
        tokens,
        lambda t: F.when(t.startswith("<") & t.endswith(">"), t).when(
            t.contains("@"), F.concat(F.lit("<"), t, F.lit(">"))
        ),
    )
    return F.filter(ids, lambda i: i.isNotNull())
