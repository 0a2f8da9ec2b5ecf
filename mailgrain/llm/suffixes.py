"""Removal of byte strings that occur earlier, by sorting suffixes.

Candidate suffixes (the windows of first regions, :mod:`mailgrain.llm.repeats`) are range-partitioned by their leading
bytes with splitters that Spark samples.  Each bucket sorts its suffixes by multikey quicksort: three-way splits on
one eight-byte symbol after the other, only within runs that are still equal.  In a run of suffixes equal over the
window all but the earliest are repeats.  Runs may cross from one bucket into the next: each bucket's largest key is
compared with the keys after it.

Suffixes that could be equal share the anchor gram, so the leading bytes of a suffix are taken from its anchor on; a
gram with too many first regions for one bucket has its suffixes sorted across the cluster by their whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm import base, repeats

WINDOW, GRAM = 100, 32
#: bytes of exploded suffixes sorted at a time
SORT_BYTES = 12 << 20


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a symbol matrix, and the number of the run of equal rows at each place of that order.

    Multikey quicksort with all pivots of a level at once: rows are split by one symbol within the runs that are
    still equal; runs of one row are done.  Equal rows keep their order.
    """
    order = np.arange(len(keys))
    run = np.zeros(len(keys), np.int64)
    for column in range(keys.shape[1]):
        size = np.bincount(run, minlength=run[-1] + 1 if len(run) else 1)
        open_places = np.flatnonzero(size[run] > 1)
        if not len(open_places):
            break
        rows = order[open_places]
        symbol = keys[rows, column]
        turn = np.lexsort((symbol, run[open_places]))
        order[open_places] = rows[turn]
        breaks = np.ones(len(order), bool)
        breaks[1:] = run[1:] != run[:-1]
        now = np.zeros(len(order), keys.dtype)
        now[open_places] = symbol[turn]
        breaks[1:] |= now[1:] != now[:-1]
        run = np.cumsum(breaks) - 1
    return order, run


def _bytes_of(column: pa.Array):
    base.let_go()
    data, offsets = base.byte_arrays(column)
    return base.Rolling(base.BYTE_CODE[data]), offsets


def _cut(column: pa.Array):
    data, offsets = base.byte_arrays(column)
    return lambda doc, start, end: data[offsets[doc] + start: offsets[doc] + end].tobytes()


def _sorted_spans(group: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """Spans of repeated windows among pieces (g, key, place, piece) in (g, key, place) order."""
    counts = np.asarray([repeats.count_of(p[2]) for p in group])
    data = np.frombuffer(b"".join([p[3] for p in group]) + b"\0" * 8, np.uint8)
    sizes = counts + window - 1
    starts = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(group)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    lead = np.asarray([repeats.lead_of(p[2]) for p in group])
    symbols = -(-window // 8)
    at = starts[piece] + inside
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    keys = np.empty((len(piece), symbols + 2), np.uint64)
    number = {g: i for i, g in enumerate(dict.fromkeys(p[0] for p in group))}
    keys[:, 0] = np.asarray([number[p[0]] for p in group], np.uint64)[piece]
    keys[:, 1] = (inside - lead[piece] + window).astype(np.uint64)
    for s in range(symbols):
        # the last symbol overlaps the one before, so that it ends with the window
        keys[:, 2 + s] = np.ascontiguousarray(eight[at + min(8 * s, window - 8)]).view(">u8").ravel()
    order, run = multikey_order(keys)
    late = np.zeros(len(piece), bool)
    late[order[1:]] = run[1:] == run[:-1]
    out = []
    for a, b in repeats.runs_of(late):
        for own in range(piece[a], piece[b - 1] + 1):
            base_row = int(np.searchsorted(piece, own))
            first, last = max(a, base_row), min(b, base_row + int(counts[own]))
            start = repeats.first_of(group[own][2]) + first - base_row
            out.append((group[own][1], start, start + last - first - 1 + window))
    return out


def _sort_bucket(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def spans() -> Iterator[pa.RecordBatch]:
            if held and (found := _sorted_spans(held, window)):
                yield base.batch_of(**{n: pa.array(c, pa.int64()) for n, c in zip(("key", "start", "end"), zip(*found))})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "place", "piece"))):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield from spans()
                    held, size = [], 0
                held.append(row)
                size += repeats.count_of(row[2]) * (window + 20)
        yield from spans()

    return run


def _exploded(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, first, piece = repeats.count_of(row["place"]), repeats.first_of(row["place"]), row["piece"]
                yield base.batch_of(
                    suffix=pa.array([piece[i: i + window] for i in range(n)], pa.binary()), key=np.full(n, row["key"]),
                    start=np.arange(first, first + n))

    return run


def late_across_buckets(suffixes: DataFrame) -> DataFrame:
    """(key, start) of suffixes equal to an earlier one; equal suffixes may fill any number of buckets.

    ``suffixes`` has suffix, key and start.  Range buckets are sorted and stored; then each suffix is compared with
    the one before it, the first of a bucket with the largest of the buckets before.
    """
    order = ["suffix", "key", "start"]
    buckets = base.store(
        suffixes.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()).sortWithinPartitions(*order), "buckets")
    edges = buckets.groupBy("bucket").agg(F.max("suffix").alias("largest"))
    # one row for each bucket
    before = edges.withColumn("previous", F.lag("largest").over(Window.orderBy("bucket"))).select("bucket", "previous")
    firsts = buckets.groupBy("bucket", "suffix").agg(F.min(F.struct("key", "start")).alias("first"))
    marked = firsts.join(F.broadcast(before), "bucket").select(
        "bucket", "suffix", "first", F.coalesce(F.col("suffix") == F.col("previous"), F.lit(False)).alias("continued"))
    return buckets.join(marked, ["bucket", "suffix"]).where(
        F.col("continued") | (F.struct("key", "start") != F.col("first"))).select("key", "start")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """(key, start, end) in bytes, overlapping: windows that also start earlier, in a smaller key or the same document."""
    shared = repeats.shared_regions(docs, _bytes_of, window, gram)
    whole = repeats.whole_region_spans(shared.where("kind <> 1"), window)
    cold, hot = repeats.split_by_group(shared.where("kind = 1").select("g", "ctx", "key", "place"), group_limit)
    lead = F.expr(f"substring(piece, cast(shiftright(place, {repeats.FIELD}) & {repeats.MOST} as int) + 1, {gram})")
    # the pieces of all regions in one pass: the texts move once, however many grams are hot
    firsts = cold if hot is None else cold.withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True)))
    pieces = base.store(repeats.with_pieces(docs, firsts, _cut, window), "pieces")
    base.free_shuffles(docs.sparkSession)  # the texts that moved for the pieces, before they move for the spans
    buckets = (pieces if hot is None else pieces.where("not hot")).repartitionByRange(lead, "g").sortWithinPartitions(
        lead, "g", "key", "place")
    spans = whole.unionByName(buckets.mapInArrow(_sort_bucket(window), "key long, start long, end long"))
    if hot is not None:
        suffixes = pieces.where("hot").mapInArrow(_exploded(window), "suffix binary, key long, start long")
        late = late_across_buckets(suffixes)
        spans = spans.unionByName(late.select("key", "start", (F.col("start") + window).alias("end")))
    return spans


def _apply(keep_text: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                data, offsets = base.byte_arrays(rows.column("text"))
                lengths, removed, runs, digests, texts = np.diff(offsets), [], [], [], []
                for doc, spans in enumerate(rows.column("spans").to_pylist()):
                    own = data[offsets[doc]: offsets[doc + 1]]
                    if not spans:
                        removed.append(0), runs.append(0), digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                        texts.append(own.tobytes() if keep_text else b"")
                        continue
                    gone = repeats.covered(len(own), spans)
                    removed.append(int(gone.sum()))
                    runs.append(len(repeats.runs_of(gone)))
                    digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
                    texts.append(whole_characters(own, gone) if keep_text else b"")
                columns = dict(
                    **{c: rows.column(c) for c in keep}, n_bytes=pa.array(lengths.astype(np.int64)), n_removed=pa.array(removed, pa.int64()),
                    n_spans=pa.array(runs, pa.int64()), kept_sha256=pa.array(digests))
                if keep_text:
                    kept = pa.array([t.decode() for t in texts], pa.string())
                    columns["kept_text"] = pc.if_else(pc.is_null(rows.column("text")), None, kept)
                yield base.batch_of(**columns)

    return run


def whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """Kept bytes; a character stays if any byte of it stays, so that the result is UTF-8."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    all_gone = np.minimum.reduceat(gone, starts) if len(starts) else gone[:0]
    sizes = np.diff(np.r_[starts, len(data)])
    return data[~np.repeat(all_gone, sizes)].tobytes()


def remove_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT, keep_text: bool = True,
    keep_rows: bool = False,
) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest of the kept bytes; with ``keep_text`` the kept text.

    The text keeps whole characters.  Null texts have no bytes and stay null.  Rows with the same doc_id are separate
    documents in the order of their texts, a null doc_id comes first.  ``keep_rows`` adds the columns but text as ``_row``.
    """
    base.ship_code(docs.sparkSession)
    keyed, _ = repeats.keyed_documents(docs, keep_rows)
    spans = repeated_spans(keyed, window, gram, group_limit)
    keep = ["doc_id", *(["_row"] if keep_rows else [])]
    found = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return repeats.joined_spans(keyed, spans).mapInArrow(_apply(keep_text, keep), base.schema_of(keyed, keep, found))
