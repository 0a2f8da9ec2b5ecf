"""Text cleaning (operators C1-C12) as staged projections.

Every step is linear in the text and runs on whole texts.  Steps that look at
their input more than once are guarded by a cheap literal test, so plain text
skips the regular expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailgrain.constants import (
    HTML_HINTS, MAX_TOKENS, MIN_BODY_TOKENS, SIGNATURE_MARKERS, TOKEN_RESERVE,
)
from mailgrain.functions.html import strip_html
from mailgrain.functions.normalize import (
    INLINE_SPACE, NOT_SPACE, SPACE, _col, contains_any, lowered, squeeze, squeeze_lines, strip,
)

_INLINE = INLINE_SPACE
_WORD = NOT_SPACE

_TEMPLATE_TAGS = [
    r"(?s)\{%.*?%\}", r"(?s)\{\{.*?\}\}", r"(?s)\{#.*?#\}", r"(?s)<%.*?%>", r"(?s)\{\{[#^/].*?\}\}",
]
_INLINE_QUOTE = rf"(?dmi)On [^>]+wrote:{SPACE}*>.*$"
_HEADER_LINE = rf"(?dm)^{_INLINE}*+(?:From|Sent|To|Subject|Date|Cc|Bcc):{_INLINE}*+[^\n]+$\n?"
# a line that opens a quote block, with the blank lines that follow it
_QUOTE_BLOCK = (
    rf"(?dmi)^{_INLINE}*+(?:>[^\n]*|On [^\n]+ wrote:{_INLINE}*"
    rf"|-+{_INLINE}*(?:Forwarded message|Original Message){_INLINE}*-+{_INLINE}*)$(?:\n{_INLINE}*+$)*+\n?"
)
_QUOTE_TAIL = rf"(?dm){SPACE}*+>{SPACE}+{_WORD}.*$"
# a marker that ends in a space needs a word after it on its line
_SIGNATURE = rf"(?dm)^{_INLINE}*+(?:" + "|".join(
    m + r"[^\n]*" + _WORD if m[-1] == " " else m for m in SIGNATURE_MARKERS
) + ")"


def strip_templates(c: Column | str) -> Column:
    """Remove template tags, then collapse all white space."""
    text = F.coalesce(_col(c), F.lit(""))
    bare = text
    for tag in _TEMPLATE_TAGS:
        bare = F.regexp_replace(bare, tag, "")
    tagged = text.contains("{") | text.contains("<%")
    return strip(squeeze(F.when(tagged, bare).otherwise(text)))


def strip_quotes(c: Column | str) -> Column:
    """C4: remove quoted reply chains.

    Blank lines belong to the quote block opened above them, and header lines
    neither open nor close a block; so a block is an opening line plus the
    blank lines after it once header lines are gone.
    """
    text = F.coalesce(_col(c), F.lit(""))
    inline = text.contains(">") & F.lower(text).contains("wrote:")
    rest = F.when(inline, F.regexp_replace(text, _INLINE_QUOTE, "")).otherwise(text)
    rest = strip(F.regexp_replace(F.regexp_replace(rest, _HEADER_LINE, ""), _QUOTE_BLOCK, ""))
    rest = strip(F.regexp_replace(rest, _QUOTE_TAIL, ""))
    # every line that goes has one of these characters
    suspect = text.contains(">") | text.contains(":") | text.contains("-")
    return F.when(suspect, rest).otherwise(strip(text))


def _signature_parts(c: Column | str) -> Column:
    """``[text]``, or ``[above, below]`` around the first marker."""
    return F.split(F.coalesce(_col(c), F.lit("")), _SIGNATURE, 2)


def has_signature(c: Column | str) -> Column:
    return F.size(_signature_parts(c)) > 1


def strip_signature(c: Column | str) -> Column:
    """Text above the first line that starts with a signature marker."""
    parts = _signature_parts(c)
    return F.when(F.size(parts) > 1, strip(parts[0])).otherwise(parts[0])


# typographic characters and what replaces them (fixed values)
_PLAIN = str.maketrans({
    "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "…": "...",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
})


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).translate(_PLAIN))


def normalize_chars(c: Column | str) -> Column:
    """NFC, plain quotes, dashes and dots, zero-width characters removed.

    ASCII text is in that form already and stays on the JVM.
    """
    text = F.coalesce(_col(c), F.lit(""))
    beyond_ascii = F.octet_length(text) != F.length(text)
    return F.coalesce(_compose(F.when(beyond_ascii, text)), text)


def collapse_whitespace(c: Column | str) -> Column:
    """Single spaces, trimmed lines, paragraph breaks kept."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"\n{SPACE}*\n", "\n\n")
    text = squeeze_lines(text)
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return strip(text)


def sanitize_messages(
    df: DataFrame,
    content: str,
    *,
    strip_html_content: bool = True,
    remove_templates: bool = True,
    remove_quotes: bool = True,
    remove_signature: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """The cleaning steps in order, each behind its switch.

    Adds ``clean_text``, ``original_length``, ``sanitized_length``, the flags
    ``html_stripped``, ``quotes_removed``, ``signature_removed`` and
    ``reduction_ratio``.  Each step is its own projection, so no step's input
    expression is repeated inside the next one.
    """
    raw = F.coalesce(F.col(content), F.lit(""))
    marked_up = contains_any("_lowered", HTML_HINTS) if strip_html_content else F.lit(False)
    out = lowered(df, _lowered=content).withColumns({"original_length": F.length(raw), "html_stripped": marked_up})
    out = out.drop("_lowered")
    text = raw
    if strip_html_content:
        text = F.when(F.col("html_stripped"), strip_html(F.when(F.col("html_stripped"), raw))).otherwise(raw)
    out = out.withColumn("clean_text", text)
    if remove_templates:
        out = out.withColumn("clean_text", strip_templates("clean_text"))
    if remove_quotes:
        out = out.withColumn("_unquoted", strip_quotes("clean_text"))
        out = out.withColumn("quotes_removed", F.length("_unquoted") < F.length("clean_text"))
        out = out.withColumn("clean_text", F.col("_unquoted")).drop("_unquoted")
    else:
        out = out.withColumn("quotes_removed", F.lit(False))
    if remove_signature:
        out = out.withColumn("_parts", _signature_parts("clean_text"))
        out = out.withColumn("signature_removed", F.size("_parts") > 1)
        above = F.when(F.col("signature_removed"), strip(F.col("_parts")[0])).otherwise(F.col("_parts")[0])
        out = out.withColumn("clean_text", above).drop("_parts")
    else:
        out = out.withColumn("signature_removed", F.lit(False))
    if normalize:
        out = out.withColumn("clean_text", normalize_chars("clean_text"))
    out = out.withColumn("clean_text", collapse_whitespace("clean_text"))
    out = out.withColumn("sanitized_length", F.length("clean_text"))
    return out.withColumn(
        "reduction_ratio",
        F.when(F.col("original_length") == 0, F.lit(0.0)).otherwise(
            1.0 - F.col("sanitized_length") / F.col("original_length")
        ),
    )


def token_estimate(c: Column | str) -> Column:
    """Half the number of characters."""
    return F.floor(F.length(F.coalesce(_col(c), F.lit(""))) / 2).cast("int")


def truncate_tokens(c: Column | str, max_tokens: int | Column) -> Column:
    """Cut to two characters per token, ``...`` marks the cut."""
    text = F.coalesce(_col(c), F.lit(""))
    limit = (F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens) * 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), limit), F.lit("...")))


def embedding_text(df: DataFrame) -> DataFrame:
    """Add ``text``, the tagged input of the encoder.

    Reads ``subject``, ``body_text``, ``is_service``, ``service_importance``
    and ``relationship_strength``.
    """
    importance, strength = F.col("service_importance"), F.col("relationship_strength")
    level = F.when(
        F.col("is_service"),
        F.when(importance >= 0.7, "HIGH").when(importance >= 0.4, "MEDIUM").otherwise("LOW"),
    ).otherwise(F.when(strength > 0.5, "HIGH").when(strength > 0.2, "MEDIUM").otherwise("LOW"))
    kind = F.when(F.col("is_service"), "SERVICE").otherwise("PERSON")
    subject_line = F.when(F.col("subject") != "", F.concat(F.lit("[SUBJECT] "), strip("subject")))
    out = df.withColumn(
        "_header",
        F.concat_ws("\n", F.format_string("[TYPE: %s] [PRIORITY: %s]", kind, level), subject_line),
    )
    out = out.withColumn("_budget", F.lit(MAX_TOKENS - TOKEN_RESERVE) - token_estimate("_header"))
    out = sanitize_messages(out, "body_text")
    fits = (F.col("_budget") > MIN_BODY_TOKENS) & (F.col("clean_text") != "")
    body_line = F.when(fits, F.concat(F.lit("[BODY] "), truncate_tokens("clean_text", F.col("_budget"))))
    return out.withColumn("text", F.concat_ws("\n", F.col("_header"), body_line)).drop(
        "_header", "_budget", "clean_text", "original_length", "sanitized_length", "html_stripped",
        "quotes_removed", "signature_removed", "reduction_ratio",
    )


def content_hash(c: Column | str) -> Column:
    """C11: first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def prepare_for_embedding(df: DataFrame, key: str = "email_id") -> DataFrame:
    """``key, text, token_count, content_hash``.

    The tag line makes every text non-blank and longer than the 10 characters asked for,
    so no row is dropped here; a filter on the built text would be pushed below
    the cleaning steps and repeat them.
    """
    text = embedding_text(df).select(key, "text")
    over = token_estimate("text") > MAX_TOKENS
    text = text.withColumn("text", F.when(over, truncate_tokens("text", MAX_TOKENS)).otherwise(F.col("text")))
    return text.select(
        key, "text", token_estimate("text").alias("token_count"), content_hash("text").alias("content_hash")
    )
