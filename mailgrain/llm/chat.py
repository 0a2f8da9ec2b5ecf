"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string.  Nothing is known of its inside: turn
by turn the growing conversation is rendered from its first turn on and consecutive outputs are compared.  What the
longer output adds is the turn's span; where the shorter output is not its prefix, the template rewrites history and
the span begins where the outputs part.  Where the text lies in its span is found by rendering the same turns with two
probe texts of the text's length: what both outputs share at the start and end is the template's own.

A template may depend on all turns, so every prefix is rendered whole: a conversation of n turns is held by its task
and costs n (n + 1) / 2 rendered turns, three times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

PROBES = ("alpha", "probe")  # different at each place, so repeated and cut they have no common start or end
SCHEMA = (
    "conv_id long, turn_no long, role string, piece string, piece_start long, n_replaced long, content_start int,"
    " content_end int, in_loss boolean, rewrites_history boolean, exact boolean"
)

# The control strings of the template below.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, then break every control string after its first character."""
    text = text.replace("\\", "\\\\")
    # a broken string may begin inside the next one, so look again from its second character
    out, at = [], 0
    while found := _CONTROL.search(text, at):
        out += [text[at: found.start() + 1], "\\"]
        at = found.start() + 1
    return "".join(out) + text[at:]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct_template(turns: list[Turn]) -> str:
    """Turns as ``<s>[INST] role`` / text / `` [/INST]</s>``; control strings inside roles and texts are escaped."""
    return "".join(
        "<s>[INST] " + escape(role).replace("\n", "\\\n") + "\n" + escape(text) + " [/INST]</s>\n" for role, text in turns)


#: a turn of the template read back: escaped role and text
TURN = re.compile(r"<s>\[INST\] ((?:[^\\\n]|\\.)*)\n(.*?) \[/INST\]</s>\n", re.DOTALL)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of :func:`instruct_template`."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def common(a: str, b: str) -> int:
    """Length of the common start, by halving: outputs are long and differ near their ends."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def turn_piece(template: Template, before: list[Turn], turn: Turn, shorter: str) -> tuple[str, int, int, int]:
    """The whole output with ``turn`` after ``before``, where its piece begins, and the bounds of the text in the output.

    ``shorter`` is the output for ``before``.  The piece begins where the outputs part, or at the text if that is earlier.
    Bounds are -1 where the text is not found.
    """
    whole = template([*before, turn])
    kept = len(shorter) if whole.startswith(shorter) else common(shorter, whole)
    size = max(len(turn[1]), 1)
    a, b = (template([*before, (turn[0], (probe * (size // len(probe) + 1))[:size])]) for probe in PROBES)
    head = common(a, b)
    tail = common(a[head:][::-1], b[head:][::-1])
    if head + tail > len(whole) or whole[:head] != a[:head] or (tail and whole[-tail:] != a[-tail:]):
        return whole, kept, -1, -1
    return whole, min(kept, head), head, len(whole) - tail


def _render(template: Template, undo: Callable[[str], str], loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, output = object(), ""
        before: list[Turn] = []
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, output, before = conv, "", []
                turn = (role or "", text or "")
                whole, place, start, end = turn_piece(template, before, turn, output)
                replaced = len(output) - place
                exact = start >= 0 and undo(whole[start:end]) == turn[1]
                bounds = (start - place, end - place) if start >= 0 else (-1, -1)
                rows.append((conv, len(before), turn[0], whole[place:], place, replaced, *bounds, turn[0] == loss_role and exact,
                             replaced > 0, exact))
                before.append(turn)
                output = whole
            names = ("conv_id", "turn_no", "role", "piece", "piece_start", "n_replaced", "content_start", "content_end", "in_loss",
                     "rewrites_history", "exact")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(),
                     pa.bool_(), pa.bool_())
            if rows:
                yield base.batch_of(**{n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    return run


def format_turns(
    conversations: DataFrame, template: Template = instruct_template, undo: Callable[[str], str] = unescape,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per turn: its piece of the formatted conversation, the place of the piece, the bounds of the text in it.

    The formatted conversation is made by :func:`assemble` from its pieces in ``turn_no`` order: each takes the place of
    the last ``n_replaced`` characters.  ``in_loss`` marks turns whose text is trained on, unless a later piece replaces it.
    ``exact`` says that undoing the template's escapes gives the text back; where it is false nothing is under the
    loss mask.  ``rewrites_history`` says that the turn changed earlier output.  Null role or text counts as empty;
    rows of equal turn number are ordered by role and text and all kept; rows without ``conv_id`` form one conversation.
    """
    base.ship_code(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_render(template, undo, loss_role), SCHEMA)


def assemble(pieces: Iterable[tuple]) -> tuple[str, list[tuple[int, int]]]:
    """Output and bounds of the text under the loss mask, from (piece, piece_start, content_start, content_end, in_loss).

    A piece that rewrites history puts an end to the bounds of earlier texts that reach into it.
    """
    parts: list[str] = []
    size, spans = 0, []
    for piece, place, start, end, in_loss in pieces:
        if place < size:
            parts = ["".join(parts)[:place]]
            spans = [span for span in spans if span[1] <= place]
        parts.append(piece)
        size = place + len(piece)
        if in_loss:
            spans.append((place + start, place + end))
    return "".join(parts), spans


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, pieces = object(), []

    def row() -> pa.RecordBatch:
        formatted, spans = assemble(pieces)
        turns = parse(formatted)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        trained = [unescape(formatted[start:end]) for start, end in spans]
        return base.batch_of(
            conv_id=pa.array([now], pa.int64()), n_turns=pa.array([len(turns)], pa.int64()),
            turns_sha256=pa.array([whole.hexdigest()]), loss_chars=pa.array([sum(map(len, trained))], pa.int64()),
            loss_sha256=pa.array([hashlib.sha256("".join(trained).encode()).hexdigest()]),
            formatted_chars=pa.array([len(formatted)], pa.int64()))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "piece", "piece_start", "content_start", "content_end", "in_loss"))
        for conv, *piece in zip(*columns):
            if conv != now:
                if pieces:
                    yield row()
                now, pieces = conv, []
            pieces.append(piece)
    if pieces:
        yield row()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted pieces alone: turns, what is under the loss mask, and length."""
    ordered = turns.select("conv_id", "turn_no", "piece", "piece_start", "content_start", "content_end", "in_loss").repartition(
        "conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
