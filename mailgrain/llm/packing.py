"""Bulk-synchronous best-fit packing of token sequences.

Documents longer than a sequence are cut so that only the first piece may be shorter; full pieces are sequences of
their own.  The remaining pieces and the gaps of open sequences are ordered by length, and packing goes in rounds.
In a round all pieces of one length, the longest still unplaced, look for their successor among the gaps: the
smallest gap that holds them.  Pieces that meet at the same gap size are told apart by rank, one for each gap; the
gaps shrink, and the round repeats until no piece of that length fits an open gap, when new sequences open.

Gaps of one size are interchangeable, so a round works on runs of sequence numbers: at most one run is cut at a round
and the sweep's table is bounded by the sequence length, not by the documents.  Ranks are found where the rows are, as
counts within a task plus the counts of the tasks before, so a length shared by a third of all rows is spread evenly.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm import base
from mailgrain.llm.tokens import encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def _tokenised(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        encode = encoder(path)
        end = np.asarray([end_id], "<u4")
        for batch in batches:
            for rows in base.text_slices(batch):
                out: list[tuple] = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encode.column(rows.column("text"))):
                    ids = np.concatenate([ids, end])
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[a:b].tobytes()
                        out.append((doc, piece, a, b - a, zlib.crc32(own), part, int(seen[b - a]), own if keep_ids else None))
                        seen[b - a] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                width = 8 if keep_ids else 7
                yield base.batch_of(**{n: pa.array(c, k) for n, k, c in list(zip(names, kinds, zip(*out)))[:width]})

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Stored pieces of all documents (null text: only the end id), with the task they came from and their rank in it.

    ``keep_ids`` adds the ids as little-endian 32-bit binary, for callers that write the packed sequences.
    """
    base.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECES + (", ids binary" if keep_ids else "")
    return base.store(rows.mapInArrow(_tokenised(tokenizer_path, end_id, capacity, keep_ids), schema), "pieces")


class GapTable:
    """Open gaps as runs of sequence numbers by gap size."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sizes: list[int] = []
        self.runs: dict[int, deque] = {}

    def put(self, size: int, first: int, count: int) -> None:
        if size <= 0:
            return
        if size not in self.runs:
            self.runs[size] = deque()
            bisect.insort(self.sizes, size)
        self.runs[size].append((first, count))

    def successor(self, length: int) -> int | None:
        at = bisect.bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, size: int, most: int) -> tuple[int, int]:
        first, count = self.runs[size].popleft()
        if count > most:
            self.runs[size].appendleft((first + most, count - most))
            count = most
        if not self.runs[size]:
            del self.runs[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first, count


def best_fit_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence of the first rank, offset) from the number of pieces of each length."""
    gaps, plan, opened = GapTable(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        rank, total = 0, lengths[length]
        while rank < total:
            size = gaps.successor(length)
            if size is None:
                # every new sequence takes as many pieces of this length as fit before the next sweep
                each = capacity // length
                full, rest = divmod(total - rank, each)
                for place in range(each):
                    if full:
                        plan.append((length, rank, rank + full, opened, place * length))
                        rank += full
                gaps.put(capacity - each * length, opened, full)
                opened += full
                if rest:
                    for place in range(rest):
                        plan.append((length, rank, rank + 1, opened, place * length))
                        rank += 1
                    gaps.put(capacity - rest * length, opened, 1)
                    opened += 1
            else:
                first, count = gaps.take(size, total - rank)
                plan.append((length, rank, rank + count, first, capacity - size))
                rank += count
                gaps.put(size - length, first, count)
    return plan


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset, bounds = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            at = np.empty(len(own), np.int64)
            for size in np.unique(own).tolist():
                rows = np.flatnonzero(own == size)
                a, b = bounds[size], bounds[size + 1]
                at[rows] = a + np.searchsorted(first[a:b], rank[rows], side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield base.batch_of(
                **{n: batch.column(n) for n in names}, sequence_id=pa.array(sequence[at] + rank - first[at]),
                offset=pa.array(offset[at]))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``; see the module text for the method."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "before")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = np.asarray(sorted(best_fit_plan(lengths, capacity)), np.int64).reshape(-1, 5)
    bounds = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((plan[:, 0], plan[:, 1], plan[:, 3], plan[:, 4], bounds))
    keep = [c for c in pieces.columns if c not in ("part", "local_rank")]
    ranked = pieces.join(bases, ["part", "length"]).select(*keep, (F.col("before") + F.col("local_rank")).alias("rank"))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(shared), schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """Token sequences from pieces packed with ``keep_ids``: at most ``capacity`` ids in each row."""
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("pieces"), F.sum("length").alias("n_tokens"))
