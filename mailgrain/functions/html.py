"""HTML to text inside Arrow batches: the parser part of C1/C2.

Nested hidden elements cannot be matched by a regular expression, so the
removal of elements walks the markup with the standard library parser.  Rows
without markup never reach Python: callers pass null for them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailgrain.constants import DROPPED_ELEMENTS, DROPPED_ELEMENTS_BASIC
from mailgrain.functions.normalize import squeeze, strip

# elements that never have content (HTML standard)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr basefont bgsound command "
    "frame image isindex nextid spacer keygen menuitem".split()
)
_HIDDEN_STYLE = re.compile(r"display:\s*none|visibility:\s*hidden", re.IGNORECASE)
_COMMON_ENTITIES = {
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lt;": "<",
    "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&",
}
_RAW_TEXT = frozenset(["script", "style", "template"])


class _VisibleText(HTMLParser):
    """Collects text nodes that have no dropped or hidden ancestor."""

    def __init__(self, dropped: frozenset[str], drop_hidden: bool):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped | _RAW_TEXT
        self.drop_hidden = drop_hidden
        self.open_elements: list[tuple[str, bool]] = []
        self.hidden_depth = 0
        self.nodes: list[str] = []
        self.joinable = False

    def _hides(self, tag, attrs):
        if tag in self.dropped:
            return True
        return self.drop_hidden and any(k == "style" and v and _HIDDEN_STYLE.search(v) for k, v in attrs)

    def handle_starttag(self, tag, attrs):
        self.joinable = False
        if tag in _VOID:
            return
        hides = self._hides(tag, attrs)
        self.open_elements.append((tag, hides))
        self.hidden_depth += hides

    def handle_startendtag(self, tag, attrs):
        self.joinable = False

    def handle_endtag(self, tag):
        self.joinable = False
        if not any(name == tag for name, _ in self.open_elements):
            return
        while True:
            name, hides = self.open_elements.pop()
            self.hidden_depth -= hides
            if name == tag:
                return

    def handle_comment(self, data):
        self.joinable = False

    def handle_data(self, data):
        if self.hidden_depth:
            return
        if self.joinable:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
            self.joinable = True


def visible_text(html: str, dropped: frozenset[str], drop_hidden: bool) -> str:
    parser = _VisibleText(dropped, drop_hidden)
    parser.feed(html)
    parser.close()
    return re.sub(r"\s+", " ", " ".join(parser.nodes)).strip()


def _series_to_text(html: pd.Series, dropped: list[str], drop_hidden: bool) -> pd.Series:
    names = frozenset(dropped)

    def one(value):
        if value is None:
            return None
        try:
            return visible_text(value, names, drop_hidden)
        except Exception:
            # malformed beyond the parser: plain tag removal
            return re.sub(r"<[^>]+>", " ", value)

    return html.map(one)


@F.pandas_udf(StringType())
def _visible_text_full(html: pd.Series) -> pd.Series:
    return _series_to_text(html, DROPPED_ELEMENTS, True)


# Declared non-deterministic so that the planner keeps it as a step of its own:
# it would otherwise copy what is built on the text into every later use of it.
_visible_text_full = _visible_text_full.asNondeterministic()


@F.pandas_udf(StringType())
def _visible_text_basic(html: pd.Series) -> pd.Series:
    return _series_to_text(html, DROPPED_ELEMENTS_BASIC, False)


def strip_html(c: Column | str) -> Column:
    """Visible text; scripts, head, hidden elements and 1-px images dropped."""
    html = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_visible_text_full(html), F.lit(""))


def strip_html_basic(c: Column | str) -> Column:
    """Text without script, style, head, meta and link elements.

    Text with neither a tag nor an entity only has its white space collapsed,
    which stays on the JVM.
    """
    html = F.col(c) if isinstance(c, str) else c
    marked_up = html.rlike(r"[<&]")
    flat = strip(squeeze(html))
    return F.when(marked_up, _visible_text_basic(F.when(marked_up, html))).otherwise(F.coalesce(flat, F.lit("")))


def strip_html_regex(c: Column | str) -> Column:
    """C1/C2 for trusted well-formed markup, wholly on the JVM.

    Gives the parser's result when elements are closed, hidden elements are not
    nested in one another and only the common entities listed above occur.
    """
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style|head|noscript|iframe|object|applet)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in _COMMON_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(squeeze(text))
