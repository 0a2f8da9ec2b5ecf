"""Periodic runs of words: Lyndon arrays by Baier's grouping under both orders, roots extended through LCE.

A run is a stretch of words that repeats itself with its smallest period and that no neighbour extends.  Every run has a
Lyndon root, which is the longest Lyndon word from its place under the order of the words or under the reverse order.
Phase one of Baier's suffix sorter groups suffixes by exactly that word, so no suffix array is built: groups are taken
from the greatest to the least, and the places before them (next place to the left in a lower group) take the
group's word into their own.  Hashes of stretches give the longest common extension of a root to both sides.

Lossless cut before that: each word of a run of exponent e occurs e times in the run, so a word that occurs less often
ends a stretch.  Stretches shorter than the shortest run go, and the count is repeated within what is left.

Each document is worked on where it lies; there is no shuffle.  Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

MIN_LENGTH, MIN_EXPONENT = 6, 4
CUT_ROUNDS = 8  # more rounds only cut more that holds no run
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place of ``symbols``; 0 is a wall that no word crosses.

    Groups form a linked list in ascending order.  A place whose word grows leaves its group for a new one directly
    above; of places that take in the same word several times, those with more copies go higher.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.r_[True, symbols[order][1:] != symbols[order][:-1], True]) if n else np.zeros(1, np.int64)
    members = [order[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    numbers = np.empty(n, np.int64)
    numbers[order] = np.repeat(np.arange(len(members)), np.diff(cuts))
    group = numbers.tolist()
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    wall = (symbols == 0).tolist()
    length, before, done = [1] * n, [-1] * n, bytearray(n)
    current = len(members) - 1
    while current >= 0:
        own = sorted(i for i in members[current] if group[i] == current)
        members[current] = None
        if own and wall[own[0]]:
            break
        for i in own:
            done[i] = 1
        copies: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            if p >= 0 and wall[p]:
                p = -1
            before[i] = p
            if p >= 0:
                copies[p] = copies.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, count in copies.items():
            moved.setdefault((count, group[p]), []).append(p)
        for count, origin in sorted(moved, reverse=True):
            new, upper = len(members), above[origin]
            places = moved[count, origin]
            members.append(places)
            below.append(origin)
            above.append(upper)
            above[origin] = new
            if upper < new:
                below[upper] = new
            more = count * length[own[0]]
            for p in places:
                group[p] = new
                length[p] += more
        current = below[current]
    return np.asarray(length, np.int64)


def common_extension(rolling: base.Rolling, a: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
    """Length of the longest common stretch from places ``a`` and ``b`` > ``a``, or of the one that ends before them."""
    low = np.zeros(len(a), np.int64)
    high = a.copy() if backward else len(rolling.sums) - 1 - b
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        x, y, half = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
        same = rolling.of(x - half, x) == rolling.of(y - half, y) if backward else rolling.of(x, x + half) == rolling.of(y, y + half)
        low[open_[same]] = half[same]
        high[open_[~same]] = half[~same] - 1


def repetitive_stretches(code: np.ndarray, owner: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may lie in a run, and the number of the stretch of each."""
    place, stretch = np.arange(len(code)), owner
    for _ in range(CUT_ROUNDS):
        _, inverse, counts = np.unique(
            base.mix(code[place] + stretch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        kept = counts[inverse] >= times
        place, old = place[kept], stretch[kept]
        opens = np.r_[True, (place[1:] != place[:-1] + 1) | (old[1:] != old[:-1])][: len(place)]
        stretch = np.cumsum(opens) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= least if len(place) else kept[:0]
        place, stretch = place[long], stretch[long]
        if kept.all() and long.all():
            break
    return place, stretch


def chunk_runs(code: np.ndarray, owner: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a chunk's words, in order of start and period; ``owner`` is the document."""
    place, stretch = repetitive_stretches(code, owner, least, times)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    # stretches behind each other, a wall of its own before each and after the last
    walls = stretch[-1] + 2 if len(stretch) else 1
    number = np.cumsum(np.r_[True, stretch[1:] != stretch[:-1]])
    at = np.arange(len(place)) + number
    total = len(place) + int(number[-1]) + 1
    symbols, back = np.zeros(total, np.int64), np.full(total, -1)
    symbols[at] = np.unique(code[place], return_inverse=True)[1] + 1
    back[at] = place
    codes = base.mix(np.arange(total, dtype=np.uint64) ^ np.uint64(walls << 32))  # walls differ from each other
    codes[at] = code[place]
    rolling = base.Rolling(codes)
    found = []
    for ranks in (symbols, np.where(symbols > 0, symbols.max() + 1 - symbols, 0)):
        period = lyndon_lengths(ranks)[at]
        after = np.minimum(at + period, total - 1)
        near = (codes[at] == codes[after]) | (codes[at - 1] == codes[after - 1])
        i, p = at[near], period[near]
        right = common_extension(rolling, i, i + p, False)
        left = common_extension(rolling, i, i + p, True)
        fit = left + p + right >= np.maximum(least, times * p)
        found.append(np.stack([back[(i - left)[fit]], (left + p + right)[fit], p[fit]]))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    order = np.lexsort((period, start))
    return start[order], (start + length)[order], period[order]


def joined_words(words: base.Words, kept: np.ndarray) -> pa.Array:
    """Kept words of each document, joined by one space."""
    place = np.flatnonzero(kept)
    doc = words.doc()[place]
    later = np.r_[False, doc[1:] == doc[:-1]][: len(place)]  # a space goes before
    sizes = words.end[place] - words.start[place] + later
    ends = np.cumsum(sizes)
    out = np.repeat(words.start[place] - later - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    data = words.data[np.maximum(out, 0)] if len(out) else np.zeros(0, np.uint8)
    data[(ends - sizes)[later]] = 32
    offsets = np.r_[0, ends][np.searchsorted(doc, np.arange(len(words.count) + 1))]
    return pa.LargeStringArray.from_buffers(len(words.count), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, keep: list[str] | None = None,
) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (by default doc_id), n_words, runs and the collapsed text.

    Words are runs without ASCII white space, as they are.  ``runs`` holds start (word number), length and period of
    each run of at least ``min_length`` words and ``min_exponent`` (an integer, at least 2) periods, by start and period.
    ``collapsed`` keeps of each run its first period: a word goes if any run holds it after that.  A null or blank text
    has no words, no runs and an empty collapsed text.  Rows are independent: repeated or null ids and further columns
    change nothing, a text of any length is one row's work.
    """
    if min_exponent < 2 or int(min_exponent) != min_exponent:
        raise ValueError("min_exponent must be an integer of at least 2")
    base.ship_code(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.text_slices(batch, "_text"):
                words = base.Words(part.column("_text"), lower=False, alphabet=base.NOT_SPACE)
                start, end, period = chunk_runs(words.hash, words.doc(), min_length, min_exponent)
                depth = np.zeros(len(words.start) + 1, np.int32)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, end, -1)
                first = words.first[:-1]
                doc = np.searchsorted(words.first, start, side="right") - 1
                bounds = np.searchsorted(doc, np.arange(len(first) + 1))
                structs = pa.StructArray.from_arrays(
                    [pa.array(start - first[doc]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [
                        pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
                        joined_words(words, np.cumsum(depth)[:-1] == 0)],
                    [*keep, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, base.schema_of(rows, keep, RUNS))


def longest(field: str) -> Column:
    """Start, length or period of the longest of ``runs`` (the first of equal ones, then the shorter period)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return best[field] if field == "length" else -best[field]


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten repeats itself: with h the CRC-32 of the decimal id, g = h div 10, a
    document of h mod 10 = 0 and n words takes from word a = g mod n on the p = 1 + (n - a) div (3 + g mod 8) words
    there over and over, to the same number of words.  Words are joined by a space where a text changes."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    split = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("words", split).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))
