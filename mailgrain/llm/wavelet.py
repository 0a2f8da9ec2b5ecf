"""Token ids in wavelet-matrix shards: succinct bit-planes with rank and select.

A shard holds the ids of a run of documents in ascending ``doc_id`` order.  Plane by plane, from the highest bit, the
ids are split stably by that bit; only the bits are kept, with a running count of ones for every 512 bits.  From
these planes come the ids themselves, the id at one place (``access``), how often an id occurs before a place
(``rank``), and where its n-th occurrence lies (``select``).

Shards are rows of a Parquet table in the shared folder, one blob each, with a directory of the documents inside, so
they can be read by any executor and reread after a loss.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm import base
from mailgrain.llm.tokens import encoder

MAGIC = b"WVM1"
BLOCK = 512
#: ids in a shard, unless one document alone has more
SHARD_TOKENS = 1 << 18
SHARD_SCHEMA = "shard_part int, shard_no int, part_start long, first_doc long, n_docs long, n_tokens long, wavelet binary"


class WaveletMatrix:
    """One shard.  Layout of the blob: magic, depth, length, zeros of each plane, counts, bits."""

    def __init__(self, length: int, zeros: np.ndarray, planes: np.ndarray, counts: np.ndarray):
        self.length, self.zeros, self.planes, self.counts = length, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        length, width = len(ids), -(-len(ids) // BLOCK) * BLOCK // 8
        planes = np.zeros((depth, width), np.uint8)
        zeros = np.zeros(depth, np.uint32)
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth):
            one = (now & now.dtype.type(1 << (depth - 1 - level))) != 0
            packed = np.packbits(one)
            planes[level, : len(packed)] = packed
            low = now[~one]
            zeros[level] = len(low)
            now = np.concatenate([low, now[one]])
        return cls(length, zeros, planes, cls._count(planes))

    @staticmethod
    def _count(planes: np.ndarray) -> np.ndarray:
        per_block = np.bitwise_count(planes).reshape(len(planes), -1, BLOCK // 8).sum(axis=2, dtype=np.uint32)
        counts = np.zeros((len(planes), per_block.shape[1] + 1), np.uint32)
        np.cumsum(per_block, axis=1, out=counts[:, 1:])
        return counts

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<BQ", len(self.zeros), self.length)
        return head + self.zeros.astype("<u4").tobytes() + self.counts.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "WaveletMatrix":
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        depth, length = struct.unpack_from("<BQ", blob, 4)
        at, blocks = 13, -(-length // BLOCK)
        zeros = np.frombuffer(blob, "<u4", depth, at)
        at += 4 * depth
        counts = np.frombuffer(blob, "<u4", depth * (blocks + 1), at).reshape(depth, -1)
        at += counts.nbytes
        planes = np.frombuffer(blob, np.uint8, depth * blocks * BLOCK // 8, at).reshape(depth, -1)
        return cls(length, zeros, planes, counts)

    def all(self) -> np.ndarray:
        """Every id in order: the stable splits undone from the lowest plane up."""
        now = np.zeros(self.length, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.length).view(bool)
            low = int(self.zeros[level])
            out = np.empty_like(now)
            out[~one] = now[:low]
            out[one] = now[low:] | (1 << (len(self.zeros) - 1 - level))
            now = out
        return now

    def _ones(self, level: int, place: int) -> int:
        block, rest = divmod(place, BLOCK)
        start = block * BLOCK // 8
        tail = self.planes[level, start: start + -(-rest // 8)].copy()
        if rest % 8:
            tail[-1] &= (0xFF00 >> (rest % 8)) & 0xFF
        return int(self.counts[level, block]) + int(np.bitwise_count(tail).sum())

    def access(self, place: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(len(self.zeros)):
            bit = (int(self.planes[level, place >> 3]) >> (7 - (place & 7))) & 1
            value = value * 2 + bit
            ones = self._ones(level, place)
            place = int(self.zeros[level]) + ones if bit else place - ones
        return value

    def _range(self, value: int, place: int) -> tuple[int, int]:
        start = 0
        for level in range(len(self.zeros)):
            a, b = self._ones(level, start), self._ones(level, place)
            if (value >> (len(self.zeros) - 1 - level)) & 1:
                start, place = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, place = start - a, place - b
        return start, place

    def rank(self, value: int, place: int) -> int:
        """How often ``value`` occurs before ``place``."""
        if value >> len(self.zeros):
            return 0
        start, end = self._range(value, place)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.length)

    def select(self, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of ``value``; -1 if there are fewer."""
        if nth < 0 or nth >= self.count(value):
            return -1
        place = self._range(value, self.length)[0] + nth
        for level in range(len(self.zeros) - 1, -1, -1):
            one = (value >> (len(self.zeros) - 1 - level)) & 1
            nth_bit = place - int(self.zeros[level]) if one else place
            place = self._find(level, nth_bit, one)
        return place

    def _find(self, level: int, nth: int, one: int) -> int:
        """Place of the ``nth`` bit equal to ``one`` in a plane."""
        before = self.counts[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8: (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[nth - before[block]])


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(path)
        end = np.asarray([end_id], "<u4")
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            ids = np.concatenate(parts)
            head = struct.pack("<Q", len(docs)) + np.asarray([-(1 << 63) if d is None else d for d in docs], "<i8").tobytes()
            blob = head + np.asarray(sizes, "<u4").tobytes() + WaveletMatrix.build(ids).to_bytes()
            row = base.batch_of(
                shard_part=pa.array([part], pa.int32()), shard_no=pa.array([number], pa.int32()),
                part_start=pa.array([before], pa.int64()), first_doc=pa.array([docs[0]], pa.int64()), n_docs=pa.array([len(docs)], pa.int64()),
                n_tokens=pa.array([len(ids)], pa.int64()), wavelet=pa.array([blob], pa.binary()),
            )
            number, before = number + 1, before + len(ids)
            docs.clear(), parts.clear(), sizes.clear()
            return row

        held = 0
        for batch in batches:
            for piece in base.text_slices(batch):
                for doc, ids in zip(piece.column("doc_id").to_pylist(), encode.column(piece.column("text"))):
                    if docs and held + len(ids) + 1 > shard_tokens:
                        yield flush()
                        held = 0
                    docs.append(doc)
                    parts += [ids, end]
                    sizes.append(len(ids) + 1)
                    held += len(ids) + 1
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write wavelet shards in ascending ``doc_id`` order to ``path``.

    Null texts count as empty.  Rows with the same ``doc_id`` keep an order by text.  A document is never split over
    shards.  Returns the table of shards as read back from ``path``.
    """
    base.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
    return base.store(ordered.mapInArrow(_shards(tokenizer_path, end_id, shard_tokens), SHARD_SCHEMA), "wavelet", path)


def open_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids (the smallest long stands for null), their sizes in ids, and the wavelet matrix."""
    (n,) = struct.unpack_from("<Q", blob, 0)
    docs = np.frombuffer(blob, "<i8", n, 8)
    sizes = np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    return docs, sizes, WaveletMatrix.from_bytes(memoryview(blob)[8 + 12 * n:].tobytes())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for blob, start in zip(batch.column("wavelet").to_pylist(), batch.column("shard_start").to_pylist()):
            docs, sizes, matrix = open_shard(blob)
            ids = matrix.all().astype("<u4")
            ends = np.cumsum(sizes, dtype=np.int64)
            starts = ends - sizes
            yield base.batch_of(
                doc_id=pa.array(docs, pa.int64(), mask=docs == -(1 << 63)), start=pa.array(starts + start, pa.int64()),
                n_tokens=pa.array(sizes.astype(np.int64)),
                ids_crc32=pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64()),
            )


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard_part, before): ids in the parts before each part, one row for each part of the range partitioning."""
    parts = shards.groupBy("shard_part").agg(F.sum("n_tokens").alias("part_tokens"))
    earlier = Window.orderBy("shard_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("shard_part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: place of its first id among all ids, number of ids, CRC of the ids.

    A shard knows what stands before it in its part, so only the parts' starts are joined, and no shard moves.
    """
    placed = shards.join(F.broadcast(shard_starts(shards)), "shard_part")  # as many rows as range partitions
    return placed.select((F.col("before") + F.col("part_start")).alias("shard_start"), "wavelet").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
