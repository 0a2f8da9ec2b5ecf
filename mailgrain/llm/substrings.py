"""Removal of word passages that occur in earlier documents, by suffix automata of reference shards.

The corpus is its own reference, so no automaton of it could be broadcast under a size bound.  Reference shards are
made by content instead: passages that share an anchor gram (:mod:`mailgrain.llm.repeats`) meet in one shard, with
all that could match them.  A shard's automaton is built from its passages in ascending document order, and each
passage first streams past the automaton of the documents before its own, which gives the matching statistics: at
each word the length of the longest suffix seen before.  Maximal spans of at least ``window`` words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base, repeats
from mailgrain.llm.decontaminate import SuffixAutomaton

WINDOW, GRAM = 50, 16


def _words(column: pa.Array) -> base.Words:
    return base.Words(column, lower=False, alphabet=base.NOT_SPACE)


def _symbols(column: pa.Array):
    words = _words(column)
    return base.Rolling(words.hash), words.first


def _cut(column: pa.Array):
    words = _words(column)
    return lambda doc, start, end: words.hash[words.first[doc] + start: words.first[doc] + end].tobytes()


def _stream_shard(window: int):
    """Rows sorted by (g, key, place); matching statistics against passages of smaller keys with the same gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_g = now_key = automaton = None
        waiting: list[list[int]] = []
        for batch in batches:
            out = []
            for g, ctx, key, place, piece in zip(*(batch.column(c).to_pylist() for c in ("g", "ctx", "key", "place", "piece"))):
                if g != now_g:
                    now_g, now_key, automaton, waiting = g, key, SuffixAutomaton(), []
                elif key != now_key:  # passages of one document never match each other
                    for words in waiting:
                        automaton.add(words)
                    now_key, waiting = key, []
                words = np.frombuffer(piece, np.uint64).tolist()
                state = matched = 0
                hits = np.zeros(len(words), bool)
                for i, word in enumerate(words):
                    state, matched = automaton.step(state, matched, word)
                    hits[i] = matched >= window
                for a, b in repeats.runs_of(hits):
                    out.append((g, ctx, key, a - window + 1, b))
                waiting.append(words)
            if out:
                yield base.batch_of(**{n: pa.array(c, pa.int64()) for n, c in zip(("g", "ctx", "key", "a", "b"), zip(*out))})

    return run


def _exploded(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rolling = base.Rolling(np.frombuffer(row["piece"], np.uint64))
                grams = base.signed(rolling.grams(window))
                n = len(grams)
                yield base.batch_of(
                    w1=grams, w2=np.full(n, row["g"]), g=np.full(n, row["g"]), ctx=np.full(n, row["ctx"]),
                    key=np.full(n, row["key"]), a=np.arange(n))

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """(key, start, end) in words, overlapping: windows whose words also start in a document with a smaller key.

    ``docs`` is keyed (:func:`repeats.keyed_documents`).
    """
    shared = repeats.shared_regions(docs, _symbols, window, gram)
    whole = repeats.whole_region_spans(shared.where("kind = 0"), window)
    cold, hot = repeats.split_by_group(shared.where("kind = 1").select("g", "ctx", "key", "place"), group_limit)
    pieces = repeats.with_pieces(docs, cold, _cut, window).repartition("g").sortWithinPartitions("g", "key", "place")
    found = pieces.mapInArrow(_stream_shard(window), "g long, ctx long, key long, a long, b long")
    if hot is not None:
        windows = repeats.with_pieces(docs, hot, _cut, window).mapInArrow(
            _exploded(window), "w1 long, w2 long, g long, ctx long, key long, a long")
        late = repeats.earliest_window(windows, ["key"]).where(F.col("first.key") < F.col("key"))
        found = found.unionByName(late.select("g", "ctx", "key", "a", (F.col("a") + window).alias("b")))
    # what holds for the first region of a class in its document holds for the equal ones in the same document
    places = shared.where("kind <> 0").select("g", "ctx", "key", F.shiftright("place", 2 * repeats.FIELD).alias("first"))
    partial = found.join(places, ["g", "ctx", "key"]).select(
        "key", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b")).alias("end"))
    return whole.unionByName(partial)


def _apply(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                words = _words(rows.column("text"))
                data = words.data.tobytes()
                removed, kept = [], []
                for doc, spans in enumerate(rows.column("spans").to_pylist()):
                    first, last = int(words.first[doc]), int(words.first[doc + 1])
                    gone = repeats.covered(last - first, spans)
                    removed.append(int(gone.sum()))
                    stay = np.flatnonzero(~gone) + first
                    kept.append(b" ".join([data[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist())]))
                columns = dict(
                    doc_id=rows.column("doc_id"), n_words=pa.array(words.count.astype(np.int64)),
                    n_removed=pa.array(removed, pa.int64()), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                if keep_text:
                    columns["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
                yield base.batch_of(**columns)

    return run


def remove_repeated_passages(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT, keep_text: bool = True,
) -> DataFrame:
    """Per document: words, removed words, and the kept words joined by spaces (text and digest).

    Words are runs without ASCII white space; null texts have none.  Rows with the same doc_id are separate documents
    in the order of their texts, a null doc_id comes first.
    """
    base.ship_code(docs.sparkSession)
    keyed, _ = repeats.keyed_documents(docs)
    spans = repeated_spans(keyed, window, gram, group_limit)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return repeats.joined_spans(keyed, spans).mapInArrow(_apply(keep_text), schema)
