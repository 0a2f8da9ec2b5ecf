"""Repeated stretches of texts: what the word-level and the byte-level operator share.

A window is ``window`` consecutive symbols (words or bytes) of one document.  Its anchor is the place of the smallest
hash among its ``gram``-symbol grams, the leftmost if there are several; equal windows have equal anchors.  Windows
that follow each other mostly share an anchor, so a document falls into *regions*, runs of windows with one anchor,
about one for every half window.  Only regions travel, as hashes:

* regions whose gram occurs nowhere else hold no repeated window;
* a region equal to an earlier one is repeated as a whole;
* what is left are the first regions of each kind around a shared gram.  Their symbols are fetched, and the operators
  compare them window by window.

Nothing is sampled or capped: every window is in exactly one region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

_PLACE = np.uint64((1 << 28) - 1)
#: a region's place is first << 32 | lead << 16 | count, so lead and count have 16 bits
FIELD = 16
MOST = (1 << FIELD) - 1
#: first regions of one gram that are compared in one task; more are compared window by window across the cluster
GROUP_LIMIT = 2000


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each run of ``width`` values, the leftmost of equal ones (36 bits decide)."""
    n = len(values)
    keyed = (values & ~_PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    found = np.minimum(behind[: n - width + 1], ahead[width - 1: n])
    return (found & _PLACE).astype(np.int64)


def packed_place(first, lead, count):
    """First window, anchor minus first window and number of windows of a region in one number."""
    return (first << 2 * FIELD) | (lead << FIELD) | count


def first_of(place):
    return place >> 2 * FIELD


def lead_of(place):
    return (place >> FIELD) & MOST


def count_of(place):
    return place & MOST


def check_width(window: int, gram: int) -> None:
    """The grams of a window must fit the fields of a place."""
    if not 0 < gram <= window or window - gram + 1 > MOST:
        raise ValueError(f"a window needs 1 to {MOST} grams: window {window}, gram {gram}")


def chunk_regions(rolling: base.Rolling, bounds: np.ndarray, window: int, gram: int):
    """Regions of a chunk: document number, first window, number of windows, anchor minus first window, two hashes."""
    grams = rolling.grams(gram)
    if len(grams) > int(_PLACE):
        raise ValueError(f"a document may have at most {int(_PLACE)} symbols")
    width = window - gram + 1
    empty = np.zeros(0, np.int64)
    if len(grams) < width:
        return empty, empty, empty, empty, empty, empty
    anchor = leftmost_minimum(grams, width)
    places = np.arange(len(anchor))
    owner = np.searchsorted(bounds, places, side="right") - 1
    valid = places + window <= bounds[owner + 1]
    opens = np.ones(len(anchor), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(valid & opens)
    closes = np.ones(len(anchor), bool)
    closes[:-1] = opens[1:] | ~valid[1:]
    last = np.flatnonzero(valid & closes)
    count = last - first + 1
    at = anchor[first]
    lead = at - first
    whole = base.mix(rolling.of(first, last + window) + lead.astype(np.uint64))
    doc = owner[first]
    return doc, first - bounds[doc], count, lead, base.signed(grams[at]), base.signed(whole)


def keyed_documents(docs: DataFrame, keep_rows: bool = False) -> tuple[DataFrame, bool]:
    """``docs`` as (key, doc_id, text): the key is the doc_id where these are unique and not null.

    Otherwise rows are numbered by (doc_id, text), null first, so that repeated ids are documents of their own, later
    ones after earlier ones.  The flag says which; the numbering needs one sort of the documents.  ``keep_rows`` adds
    the other columns as ``_row``.
    """
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")] if keep_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    rest = ["_row"] if keep_rows else []
    odd = rows.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text", *rest), True
    placed = base.store(
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .withColumn("at", F.monotonically_increasing_id()), "keyed")
    return placed.select(F.col("at").alias("key"), "doc_id", "text", *rest), False


REGION = "g long, ctx long, key long, place long"


def _repeated_here(g: np.ndarray, ctx: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which regions of a chunk equal one of a smaller key in the chunk: they need not travel to be known as repeats."""
    code = base.mix(g.view(np.uint64) ^ base.mix(ctx.view(np.uint64)))
    order = np.lexsort((key, code))
    opens = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    least = np.repeat(key[order][opens], np.diff(np.r_[opens, len(order)]))
    out = np.zeros(len(key), bool)
    out[order] = key[order] != least
    return out


def _region_mapper(symbols: Callable, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                rolling, bounds = symbols(rows.column("text"))
                doc, first, count, lead, g, ctx = chunk_regions(rolling, bounds, window, gram)
                if len(doc):
                    key = np.asarray(rows.column("key"))[doc]
                    place = packed_place(first, lead, count)
                    late = _repeated_here(g, ctx, key)
                    # known repeats go anywhere, so that a frequent region is no hot key
                    spread = base.signed(base.mix(key.view(np.uint64) * np.uint64(31) + place.view(np.uint64)))
                    yield base.batch_of(
                        g=np.where(late, spread, g), ctx=ctx, key=key, place=place, late=pa.array(late))

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, ctx, key, place) to kinds: 0 equal to an earlier region, in another document; 1 first of
    its class while its gram has several classes; 2 equal to an earlier region of the same document that is the
    first of the class."""
    names = ("g", "ctx", "key", "place")
    held = None  # the first region of the newest class, if it is the first class of its gram
    last_g = last_ctx = last_key = None
    for batch in batches:
        late = batch.filter(batch.column("late"))
        if late.num_rows:
            yield base.batch_of(**{n: late.column(n) for n in names}, kind=pa.array(np.zeros(late.num_rows, np.int8)))
        batch = batch.filter(pc.invert(batch.column("late")))
        if not batch.num_rows:
            continue
        g, ctx, key, place = (np.asarray(batch.column(c)) for c in names)
        new_g = np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_g[0] = last_g is None or g[0] != last_g
        new_class = new_g.copy()
        new_class[1:] |= ctx[1:] != ctx[:-1]
        new_class[0] |= last_ctx is None or ctx[0] != last_ctx
        opened = np.flatnonzero(new_class)
        # key of the class's first region, carried over from the batch before
        number = np.cumsum(new_class) - 1
        first_key = np.where(number >= 0, key[opened[np.maximum(number, 0)]] if len(opened) else 0, last_key if last_key is not None else 0)
        kind = np.where(new_class, 9, np.where(key == first_key, 2, 0)).astype(np.int8)
        kind[opened[~new_g[opened]]] = 1
        followed = np.zeros(len(opened), bool)
        followed[:-1] = ~new_g[opened[1:]]
        kind[opened[new_g[opened] & followed]] = 1
        emit = kind != 9
        extra = []
        if held is not None and len(opened) and not new_g[opened[0]]:
            extra.append(held)
        if len(opened):
            final = opened[-1]
            held = (g[final], ctx[final], key[final], place[final]) if new_g[final] else None
            last_key = key[final]
        last_g, last_ctx = g[-1], ctx[-1]
        columns = [np.concatenate([[row[i] for row in extra], column[emit]]).astype(np.int64)
                   for i, column in enumerate((g, ctx, key, place))]
        kinds = np.concatenate([np.ones(len(extra), np.int8), kind[emit]]).astype(np.int8)
        if len(kinds):
            yield base.batch_of(**dict(zip(names, columns)), kind=pa.array(kinds, pa.int8()))


def shared_regions(docs: DataFrame, symbols: Callable, window: int, gram: int) -> DataFrame:
    """Stored regions of keyed documents that share their gram: (g, ctx, key, place, kind), see :func:`_classes`."""
    check_width(window, gram)
    regions = docs.select("key", "text").mapInArrow(_region_mapper(symbols, window, gram), REGION + ", late boolean")
    ordered = regions.repartition("g").sortWithinPartitions("g", "ctx", "key", "place")
    return base.store(ordered.mapInArrow(_classes, REGION + ", kind byte"), "regions")


def with_pieces(docs: DataFrame, firsts: DataFrame, cut: Callable, window: int) -> DataFrame:
    """Symbols of the regions in ``firsts``: (g, ctx, key, place, piece), one pass over the documents concerned.

    A column ``hot`` of ``firsts`` stays.
    """
    flags = [c for c in ("hot",) if c in firsts.columns]
    wanted = firsts.groupBy("key").agg(F.collect_list(F.struct("g", "ctx", "place", *flags)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                out = []
                find = cut(rows.column("text"))
                for doc, (key, wanted) in enumerate(zip(rows.column("key").to_pylist(), rows.column("wanted").to_pylist())):
                    for want in wanted:
                        first, count = first_of(want["place"]), count_of(want["place"])
                        out.append((want["g"], want["ctx"], key, want["place"], find(doc, first, first + count + window - 1),
                                    *(want[c] for c in flags)))
                if out:
                    columns = list(zip(*out))
                    yield base.batch_of(
                        g=pa.array(columns[0], pa.int64()), ctx=pa.array(columns[1], pa.int64()), key=pa.array(columns[2], pa.int64()),
                        place=pa.array(columns[3], pa.int64()), piece=pa.array(columns[4], pa.binary()),
                        **{c: pa.array(columns[5 + i], pa.bool_()) for i, c in enumerate(flags)})

    # wanted grows with the corpus: joined by shuffle at every size, never broadcast
    return docs.select("key", "text").join(wanted.hint("merge"), "key").mapInArrow(
        run, REGION + ", piece binary" + "".join(f", {c} boolean" for c in flags))


def split_by_group(firsts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Regions of grams with at most ``limit`` first regions, and those of the others (None if there are none)."""
    hot = firsts.groupBy("g").count().where(F.col("count") > limit).select("g")
    if hot.isEmpty():
        return firsts, None
    hot = base.store(hot, "hot-grams")
    return firsts.join(hot, "g", "left_anti"), firsts.join(hot, "g", "left_semi")


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values as (start, end)."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def whole_region_spans(regions: DataFrame, window: int) -> DataFrame:
    """(key, start, end) of regions given by ``place``, in symbols."""
    first, count = F.shiftright("place", 2 * FIELD), F.col("place").bitwiseAND(F.lit(MOST))
    return regions.select("key", first.alias("start"), (first + count + F.lit(window - 1)).alias("end"))


def joined_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Keyed documents with their spans (null without any); texts are shuffled once."""
    own = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(own, "key", "left")


def covered(length: int, spans: list | None) -> np.ndarray:
    """Boolean mask of the symbols that lie in any span."""
    depth = np.zeros(length + 1, np.int32)
    if spans:
        starts = np.asarray([s["start"] for s in spans])
        ends = np.asarray([s["end"] for s in spans])
        np.add.at(depth, starts, 1)
        np.add.at(depth, ends, -1)
    return np.cumsum(depth)[:length] > 0


def earliest_window(windows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``first``: the smallest ``order`` columns among rows of the same (w1, w2)."""
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct(*order)).alias("first"))
    return windows.join(least, ["w1", "w2"])

