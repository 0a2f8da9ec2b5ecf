"""Media columns: texts stored as progressive JPEG payloads, and JPEG columns decoded to RGB tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base, jpeg

UNIT = 192
#: bytes of text encoded and of media decoded at a time: decoding gains from many intervals in step
ENCODE_CHUNK, DECODE_CHUNK = 512 << 10, 2 << 20


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, limit=ENCODE_CHUNK):
            texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
            media = jpeg.encode_payloads([padded(t) for t in texts], [struct.pack(">Q", len(t)) for t in texts])
            yield base.batch_of(doc_id=rows.column("doc_id"), media=pa.array(media, pa.binary()))


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as a progressive JPEG; a null text is stored as an empty one."""
    base.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, "media", DECODE_CHUNK):
            media = rows.column("media").to_pylist()
            images = [jpeg.parse(m) for m in media]
            out = []
            found = jpeg.decode_coefficients(images)
            for blob, image, components, tensor in zip(media, images, found, jpeg.rgb_tensors(images, found)):
                (size,) = struct.unpack(">Q", image.note)
                payload = jpeg.payload_of(components, max(UNIT, -(-size // UNIT) * UNIT))
                sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                feature = f"{image.width}x{image.height}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(tensor):08x}"
                out.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob),
                            hashlib.sha256(blob).hexdigest(), feature))
            if out:
                names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                yield base.batch_of(doc_id=rows.column("doc_id"), **{n: pa.array(c) for n, c in zip(names, zip(*out))})


def stored_features(media: DataFrame) -> DataFrame:
    """Per stored text: what is read back from its JPEG, and a feature string of its RGB tensor."""
    return media.mapInArrow(
        _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, "media", DECODE_CHUNK):
            images, out = [], []
            for blob in rows.column("media").to_pylist():
                try:
                    images.append(jpeg.parse(blob) if blob else None)
                except (ValueError, IndexError, struct.error):
                    images.append(None)
            found = iter(jpeg.decode_coefficients([i for i in images if i]))
            for image in images:
                tensor = jpeg.rgb_tensor(image, next(found)) if image else None
                out.append((image and image.height, image and image.width, None if tensor is None else tensor.tobytes()))
            height, width, rgb = zip(*out)
            yield base.batch_of(
                key=rows.column("key"), height=pa.array(height, pa.int32()), width=pa.array(width, pa.int32()), rgb=pa.array(rgb, pa.binary()))


def decode_column(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, height, width, rgb) of a column of progressive JPEGs; null, empty or other bytes give null tensors.

    The key may be of any type and need not be unique; other columns are left out.
    """
    base.ship_code(media.sparkSession)
    rows = media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("media"))
    return rows.mapInArrow(_tensors, base.schema_of(rows, ["key"], "height int, width int, rgb binary"))
